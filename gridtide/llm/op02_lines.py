"""Line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity of candidates, one of each connected group stays.

1. Texts are split at newlines. Every line that is not blank takes part by its real form: lower case (A-Z), digits and marks, white space as single
   spaces. Equal real forms fall together by a 128-bit hash.
2. Lines of MIN_WORDS words or more get keys of their normal form (words in lower case, digits as 0): the pieces of its SimHash, and further keys for edits
   that SimHash does not bear, see line_keys. A character of a script of three-byte characters counts as a word. Lines that share a key meet; a hot key
   is dealt in tiles, all pairs still meet.
3. Only the texts that hold a first place of a candidate line are fetched. Within a tile lines are joined into a forest by edit similarity (1 -
   Levenshtein / longer length of the real forms) of at least SIMILARITY. Counts of two- and three-character runs bound the distance from below, so most
   unlike pairs are put aside by array operations, without a miss. A pair already connected is not compared again, so a group of m near copies costs
   few comparisons a line and yields m - 1 edges, not m^2. Distances of many pairs are computed together (edit_distance).
4. Connected groups keep their first line; all others go from their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import ne

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import edit_distance, line_keys, shared

MIN_WORDS = 5
SIMILARITY = 0.8
#: Pairs of lines of LONG characters or more are compared if their SimHashes differ in RADIUS bits at most; the edit distance of shorter ones is cheap.
RADIUS, LONG = 20, 80
TILE_LIMIT = 500
#: Buckets that runs of characters are counted in; lines of tiles that are taken together; pairs filtered at once, and pairs that wait for comparison.
RUN_BUCKETS, LINES_AT_ONCE, PAIRS_AT_ONCE, OPEN_PAIRS = 128, 24576, 8192, 16384
#: Characters of such lines (fewer lines are taken together where they are long), and of those whose runs are counted at once.
CHARACTERS_AT_ONCE, COUNTED_AT_ONCE = 12_000_000, 250_000
#: Bytes of text whose lines are hashed at once: a number for each byte stays in the cache.
HASHED_AT_ONCE = 250_000

_WORDS = shared.byte_classes(symbols=False)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD_TABLE = bytes(_FOLD)
_SPACES = bytes(b if _WORDS[b] else 32 for b in range(256))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[:33] = 32
_LOWER[10] = 10
_LOWER_TABLE = bytes(_LOWER)
#: First byte of UTF-8 characters of three bytes or more. In whole dedup each begins a word, so scripts without spaces have words too.
_WIDE = 0xE0
#: Whatever stands between white space.
_RUNS = (np.arange(256) > 32).astype(np.uint8)


def normal_form(line: str) -> str:
    return b" ".join(line.encode().translate(_FOLD_TABLE).translate(_SPACES).split()).decode(errors="replace")


def real_form(line: str) -> str:
    """The line in lower case (A-Z) with its digits and marks, white space as single spaces."""
    return b" ".join(line.encode().translate(_LOWER_TABLE).split()).decode(errors="replace")


def _line_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of all lines of a slice of texts that have a byte (a line feed counts), and the number of bytes."""
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.union1d(offsets[:-1], breaks)
    return np.concatenate((starts[starts < len(data)], [len(data)]))


def _hashed_lines(batches: Iterator[pa.RecordBatch], keys: bool) -> Iterator[pa.RecordBatch]:
    """128-bit hash of the real form of lines: with doc_id, text_hash and line number of each line that is not blank, or with the candidate keys of the
    normal form of each line with MIN_WORDS words or more."""
    for batch in batches:
        for first, rows, data, offsets in shared.text_slices(batch.column(2), HASHED_AT_ONCE):
            if not len(data):
                continue
            real, data = _LOWER[data], _FOLD[data]
            bounds = _line_starts(data, offsets)
            whole, starts = shared.hashed_words(real, bounds, _RUNS)
            runs = np.bincount(shared.per_row(bounds, starts), minlength=len(bounds) - 1)
            lines = np.flatnonzero(runs)
            if not len(lines):
                continue
            a, b = line_keys.line_hashes(whole, np.cumsum(runs[lines]) - runs[lines], runs[lines])
            if keys:
                words, starts = shared.hashed_words(data, bounds, _WORDS, _WIDE)
                count = np.bincount(shared.per_row(bounds, starts), minlength=len(bounds) - 1)
                long_enough = np.flatnonzero(count >= MIN_WORDS)
                if not len(long_enough):
                    continue
                words, a, count_of = words[np.repeat(count >= MIN_WORDS, count)], a[count[lines] >= MIN_WORDS], count[long_enough]
                found = line_keys.keys_of(data, bounds, long_enough, words, np.cumsum(count_of) - count_of, count_of)
                columns = [a, *found.T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in columns], names=["node", *line_keys.NAMES])
                continue
            doc = shared.per_row(offsets, bounds[lines])
            # lines before it in the slice less those before its text
            number = (lines - np.searchsorted(bounds, offsets[doc])).astype(np.int32)
            take = pa.array(first + doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(number), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                names=["doc_id", "text_hash", "line", "ha", "hb"],
            )


#: Words left out on either side where two lines are brought together again, in the order of trial.
_STEPS = ((1, 1), (0, 1), (1, 0), (2, 2), (1, 2), (2, 1), (0, 2), (2, 0))


def _replacing(a: list[str], b: list[str]) -> int:
    """Edits that turn words a into words b: letter by letter where their numbers agree, else out and in."""
    if len(a) != len(b):
        return sum(len(w) + 1 for w in a) + sum(len(w) + 1 for w in b)
    return sum(sum(map(ne, x, y)) if len(x) == len(y) else max(len(x), len(y)) for x, y in zip(a, b))


def surely_within(a: str, b: str, most: int) -> bool:
    """True only if an edit script of `most` edits at most is found by going along the words of both lines; cheap for lines that mostly agree."""
    x, y, i, j, edits = a.split(" "), b.split(" "), 0, 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for p, q in _STEPS:
            if i + p < len(x) and j + q < len(y) and x[i + p] == y[j + q]:
                break
        else:
            p = q = 1
        edits += _replacing(x[i : i + p], y[j : j + q])
        if edits > most:
            return False
        i, j = i + p, j + q
    return edits + sum(len(w) + 1 for w in x[i:]) + sum(len(w) + 1 for w in y[j:]) <= most


def similar(a: str, b: str) -> bool:
    longer = max(len(a), len(b))
    most = int(longer * (1 - SIMILARITY) + 1e-9)
    return abs(len(a) - len(b)) <= most and (surely_within(a, b, most) or bool(edit_distance.within([(a, b, most)])[0]))


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by block and tile (block, tile, node): those whose tile has another row."""
    names = ["block", "tile", "node"]
    last, met = None, False  # the row that waits for the next batch, and whether a row before it is of its tile
    for batch in batches:
        now = [np.asarray(c) for c in batch.columns]
        if last is not None:
            now = [np.concatenate(x) for x in zip(last, now)]
        if not len(now[0]):
            continue
        same = (now[0][1:] == now[0][:-1]) & (now[1][1:] == now[1][:-1])
        hit = np.concatenate(([met], same)) | np.concatenate((same, [False]))
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][hit[:-1]]) for x in now], names=names)
        last, met = [x[-1:] for x in now], bool(hit[-1])
    if met:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], names=names)


def _once(close: DataFrame) -> DataFrame:
    """Of tiles (block, tile, node) that hold the same lines one stays, with the blocks of all of them: block, tile, blocks, node. A tile's list is bounded
    as the tile is, and a line has no more blocks than keys."""
    met = close.groupBy("block", "tile").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    once = met.groupBy("nodes").agg(F.min(F.struct("block", "tile")).alias("at"), F.collect_set("block").alias("blocks"))
    return once.select("at.block", "at.tile", "blocks", F.explode("nodes").alias("node"))


def run_counts(forms: list[str]) -> np.ndarray:
    """For each line how often its runs of two characters, and those of three, fall into each of RUN_BUCKETS buckets."""
    parts, at = [], 0
    ends = np.cumsum([len(f) for f in forms])
    while at < len(forms):
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUNTED_AT_ONCE, "right")))
        parts.append(_run_counts(forms[at:last]))
        at = last
    return np.concatenate(parts)


def _run_counts(forms: list[str]) -> np.ndarray:
    c = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    line = np.repeat(np.arange(len(forms)), [len(f) for f in forms])
    parts, runs = [], c
    for size in (2, 3):
        runs = runs[:-1] * 31 + c[size - 1 :]
        inside = line[: len(runs)] == line[size - 1 :]
        place = line[: len(runs)][inside] * RUN_BUCKETS + runs[inside] % RUN_BUCKETS
        parts.append(np.bincount(place, minlength=len(forms) * RUN_BUCKETS).reshape(len(forms), RUN_BUCKETS))
    return np.hstack(parts).astype(np.int32)


def may_be_similar(counts: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether lines i can be within `most` edits of lines j: an edit changes at most two runs of two characters, and three of three, so it takes away
    and adds that many at most. Never false for a pair within `most`."""
    apart = np.abs(counts[i] - counts[j])
    return (apart[:, :RUN_BUCKETS].sum(1) <= 4 * most) & (apart[:, RUN_BUCKETS:].sum(1) <= 6 * most)


def _joined(forms: list[str], most: np.ndarray, group: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
    """The edges that join lines i with lines j (the pairs of a line follow one another, likeliest first); group: a label of each line, kept up to date.

    In rounds: each line takes its next pairs, one, then two, then four, that are not connected by then; distances of a round are computed together.
    """
    row, paired = np.zeros(len(forms), np.int64), np.union1d(i, j)
    row[paired] = np.arange(len(paired))
    counts = run_counts([forms[x] for x in paired.tolist()])

    def joined(a: int, b: int) -> bool:
        x, y = group[a], group[b]
        if x != y:
            group[group == x] = y
        return x != y

    take = 1
    while len(i):
        apart = group[i] != group[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return
        first = np.flatnonzero(np.diff(i, prepend=-1))
        now = np.arange(len(i)) - np.repeat(first, np.diff(first, append=len(i))) < take
        quick = take == 1  # the likeliest pair of a line is mostly a near copy
        a, b, i, j, take = i[now], j[now], i[~now], j[~now], 2 * take
        parts = (slice(x, x + PAIRS_AT_ONCE) for x in range(0, len(a), PAIRS_AT_ONCE))
        may = np.concatenate([may_be_similar(counts, row[a[p]], row[b[p]], most[a[p]]) for p in parts])
        open_pairs = []
        for x, y in zip(a[may].tolist(), b[may].tolist()):
            if group[x] != group[y]:
                if quick and surely_within(forms[x], forms[y], int(most[x])):
                    joined(x, y)
                    yield x, y
                else:
                    open_pairs.append((x, y))
        open_pairs = [(x, y) for x, y in open_pairs if group[x] != group[y]]
        for (x, y), near in zip(open_pairs, edit_distance.within([(forms[x], forms[y], int(most[x])) for x, y in open_pairs])):
            if near and joined(x, y):
                yield x, y


def links(forms: list[str], runs: np.ndarray, keys: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of forests that join all lines of a run which a chain of similar lines connects. Lines follow one another by run, then length.

    Lines that share several keys meet in each of their blocks, and are compared in that of the smallest key that they share. Pairs of long lines
    must be within RADIUS bits of SimHash. Pairs are filtered PAIRS_AT_ONCE at a time; those left, nearest SimHash first, are compared when there are
    OPEN_PAIRS of them.
    keys: those of each line, and its SimHash as last column. block: the block of each line's run, or a row of blocks where several hold the same lines.
    """
    block = block.reshape(len(forms), -1)
    sims, keys = np.ascontiguousarray(keys[:, -1]).view(np.uint64), keys[:, :-1]
    length = np.array([len(f) for f in forms])
    most = (length * (1 - SIMILARITY) + 1e-9).astype(np.int64)
    first = np.searchsorted(runs, runs, "left")
    # the first line of the run that is long enough for this one: lengths ascend within a run
    offset = runs.astype(np.int64) * (int(length.max()) + 1)
    least = np.maximum(first, np.searchsorted(offset + length, offset + length - most, "left"))
    before = np.arange(len(forms)) - least
    group, ends, at = np.arange(len(forms)), np.cumsum(before), 0
    waiting, size = [], 0
    while at < len(forms):
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        own, at = np.arange(at, last), last
        i = np.repeat(own, before[own])
        j = i - 1 - (np.arange(len(i)) - np.repeat(np.cumsum(before[own]) - before[own], before[own]))
        bits = np.bitwise_count(sims[i] ^ sims[j])
        open_pair = (group[i] != group[j]) & ((length[j] < LONG) | (bits <= RADIUS))
        i, j, bits = i[open_pair], j[open_pair], bits[open_pair]
        if len(i):
            here = (np.where(keys[i] == keys[j], keys[i], np.iinfo(np.int64).max).min(1)[:, None] == block[i]).any(1)
            waiting.append((i[here], j[here], bits[here]))
            size += int(here.sum())
        if size >= OPEN_PAIRS or (at == len(forms) and size):
            i, j, bits = (np.concatenate(x) for x in zip(*waiting))
            order = np.lexsort((bits, i))
            yield from _joined(forms, most, group, i[order], j[order])
            waiting, size = [], 0


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest edges between the lines of a tile of candidate keys that have enough edit similarity."""

    def edges(group: list[list[tuple]]) -> pa.RecordBatch:
        rows = [r for run in group for r in sorted(run, key=lambda r: (len(r[1]), r[0]))]
        keys = np.frombuffer(b"".join(r[2] for r in rows), np.int64).reshape(len(rows), -1)
        runs = np.repeat(np.arange(len(group)), [len(run) for run in group])
        most = max(len(r[3]) for r in rows)
        blocks = np.array([r[3] + r[3][:1] * (most - len(r[3])) for r in rows], np.int64)
        found = list(links([r[1] for r in rows], runs, keys, blocks))
        left, right = ([rows[x][0] for x in side] for side in (zip(*found) if found else ([], [])))
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    group, size, wide = [], 0, 0
    for run in shared.grouped_runs(batches, ["block", "tile"], ["node", "form", "keys", "blocks"]):
        group.append(run)
        size += len(run)
        wide += sum(len(r[1]) for r in run)
        if size >= LINES_AT_ONCE or wide >= CHARACTERS_AT_ONCE:
            yield edges(group)
            group, size, wide = [], 0, 0
    if group:
        yield edges(group)


#: A line's place in the corpus, in the order that decides which line of a group stays.
_PLACE = ("doc_id IS NULL AS none", "doc_id", "text_hash", "line")


def _doc_key(doc_id: str = "doc_id", text_hash=None):
    return F.xxhash64(F.col(doc_id).isNull(), F.coalesce(doc_id, F.lit(0)), F.col("text_hash") if text_hash is None else text_hash)


def _texts_of(texts: DataFrame, lines: DataFrame, close: DataFrame) -> DataFrame:
    """node, form, keys: the forms and keys of candidate lines, each from the first text that has it. Texts that certainly hold none are not shuffled."""
    wanted = close.select(F.col("node").alias("ha")).distinct()
    place = F.struct(*[F.expr(p) for p in _PLACE])
    maybe = shared.may_hold(lines, F.col("ha"), shared.key_filter(wanted, "ha"), "held").where("held")
    first = maybe.groupBy("ha").agg(F.min(place).alias("p")).join(wanted, "ha")
    by_text = first.groupBy("p.none", "p.doc_id", "p.text_hash").agg(F.collect_list(F.struct("p.line", "ha")).alias("want"))
    by_text = shared.checkpointed(by_text.select("want", _doc_key(text_hash=F.col("text_hash")).alias("key"), F.col("doc_id").alias("i"), F.col("text_hash").alias("h")))
    held = shared.may_hold(texts.withColumn("key", _doc_key()), F.col("key"), shared.key_filter(by_text, "key"), "held").where("held")
    forms = held.join(by_text, "key").where("doc_id <=> i AND text_hash = h").select("text", "want")
    return forms.mapInPandas(_forms, "node long, form string, keys binary").groupBy("node").agg(F.min(F.struct("form", "keys")).alias("r")).select("node", "r.*")


def _later_lines(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, text_hash, line of all but the first line of each group of equal or linked lines."""
    place = F.struct(*[F.expr(p) for p in _PLACE])
    groups = shared.connected_components(edges).withColumnRenamed("node", "ha")

    # equal lines share (ha, hb), linked ones their component
    placed = lines.join(groups, "ha", "left").select(
        F.coalesce("component", "ha").alias("g"), F.when(F.col("component").isNull(), F.col("hb")).otherwise(0).alias("g2"), place.alias("p")
    )
    placed = shared.checkpointed(placed)
    heads = placed.groupBy("g", "g2").agg(F.min("p").alias("head"), F.count("*").alias("lines")).where("lines > 1").drop("lines")
    heads = shared.checkpointed(heads)
    key = F.xxhash64("g", "g2")
    repeated = shared.may_hold(placed, key, shared.key_filter(heads.select(key.alias("key")), "key"), "held").where("held")
    return repeated.join(heads, ["g", "g2"]).where("p <> head").select("p.doc_id", "p.text_hash", "p.line")


def _repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line (from 0) of every line that repeats an earlier one, exactly or nearly. Lines are told apart and compared by their real form;
    the normal form only makes candidates."""
    n = shared.shuffle_partitions(docs.sparkSession)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    lines = shared.checkpointed(texts.mapInArrow(lambda rows: _hashed_lines(rows, False), "doc_id long, text_hash long, line int, ha long, hb long"))
    keys = texts.mapInArrow(lambda rows: _hashed_lines(rows, True), ", ".join(f"{k} long" for k in ["node", *line_keys.NAMES]))
    nodes = shared.checkpointed(keys.groupBy("node").agg(*[F.min(k).alias(k) for k in line_keys.NAMES]))
    keyed = nodes.select(F.explode(F.array_distinct(F.array(*line_keys.NAMES))).alias("block"), "node")
    tiles = shared.tiled(keyed, "block", "node", TILE_LIMIT).select("block", "tile", "node").repartition(n, "block", "tile")
    close = shared.checkpointed(_once(tiles.sortWithinPartitions("block", "tile").mapInArrow(_several, "block long, tile int, node long")))
    ready = close.join(_texts_of(texts, lines, close), "node").repartition(n, "block", "tile").sortWithinPartitions("block", "tile")
    return _later_lines(lines, ready.select("block", "tile", "blocks", "node", "form", "keys").mapInArrow(_linked, "a long, b long"))


def _forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        nodes, forms, plain = [], [], []
        for text, want in zip(frame["text"], frame["want"]):
            lines = text.split("\n")
            for w in want:
                nodes.append(w["ha"])
                forms.append(real_form(lines[w["line"]]))
                plain.append(lines[w["line"]])
        ends, at = np.cumsum([len(x) for x in plain]), 0
        while at < len(nodes):
            last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HASHED_AT_ONCE // 2, "right")))
            keys = line_keys.keys_of_forms([normal_form(x) for x in plain[at:last]], _WORDS, _WIDE).view(np.int64)
            yield pd.DataFrame({"node": nodes[at:last], "form": forms[at:last], "keys": [k.tobytes() for k in keys]})
            at = last


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns are the text and the numbers of the lines to take out; they become text, lines before and lines taken out."""
    for batch in batches:
        texts, drops = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        before = pc.fill_null(pc.add(pc.count_substring(texts, "\n"), 1), 0).cast(pa.int32())
        gone = pc.fill_null(pc.list_value_length(drops), 0).cast(pa.int32())
        loses, left = pc.greater(gone, 0), []
        for text, drop in zip(texts.filter(loses).to_pylist(), drops.filter(loses).to_pylist()):
            drop = set(drop)
            left.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop))
        if left:
            texts = pc.replace_with_mask(texts, loses, pa.array(left, texts.type))
        arrays = [*batch.columns[:-2], texts, before, gone]
        yield pa.RecordBatch.from_arrays(arrays, names=[str(i) for i in range(len(arrays))])


def dedup_lines(docs: DataFrame, counts: bool = True) -> DataFrame:
    """docs with repeated lines taken out of text and, with counts, n_lines and n_removed (lines before, lines taken out; they replace columns of
    these names).

    Of each group of near-equal lines the first stays: smallest doc_id (NULL ids last), then the text's hash, then line number. All other columns
    and all rows stay. A NULL text stays NULL with 0 lines; an empty text has one line. A row that repeats another row's doc_id and text counts as
    the same place, so both keep the same lines. Texts of any length take part whole; a text may become empty.

    Equal lines of any length go, blank ones stay; lines of MIN_WORDS words or more (a character of a script of three-byte characters counts as one) are
    compared with their digits and marks where they share a key.
    """
    if counts:
        docs = docs.drop("n_lines", "n_removed")
    drop, own_key, held, key, i, h = shared.own_names(docs, "drop", "own_key", "held", "key", "i", "h")
    gone = _repeats(docs).groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias(drop))  # at most the lines of one text
    gone = shared.checkpointed(gone.select(drop, _doc_key().alias(key), F.col("doc_id").alias(i), F.col("text_hash").alias(h)))
    others = [c for c in docs.columns if c != "text"]
    cols = [*[F.col(f"`{c}`") for c in others], "text"]
    rows = docs.withColumn(own_key, _doc_key(text_hash=F.xxhash64("text")))
    rows = shared.may_hold(rows, F.col(own_key), shared.key_filter(gone, key), held)
    match = (F.col(own_key) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h))
    # only texts that may lose a line are shuffled
    changed = rows.where(F.col(held)).join(gone, match, "left").select(*cols, drop)
    same = rows.where(~F.col(held)).select(*cols, F.lit(None).cast("array<int>").alias(drop))
    lines, removed = ("n_lines", "n_removed") if counts else shared.own_names(docs, "n_lines", "n_removed")
    done = changed.unionAll(same).mapInArrow(_without, shared.schema_of(docs, others, "text string", f"{lines} int", f"{removed} int"))
    return done.select(*shared.columns_of(docs), *[lines, removed] * counts)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
