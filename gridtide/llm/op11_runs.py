"""Periodic runs of words, found on a grammar: Re-Pair compresses the word ids, each nonterminal's boundary is searched once.

A run is a longest stretch of consecutive words with a smallest period q (words q apart are equal) of LEAST words and LEAST_POWERS periods at least.

1. Words get ids of their own text (exact, by a dictionary). A run holds no window of GRAM words that occurs once only, so texts are cut to the
   stretches that repeated windows cover; a run lies in one stretch. Most prose has none.
2. Re-Pair in rounds: pairs of neighbours that occur twice or more in their text are ranked by frequency; an occurrence is replaced by the pair's
   nonterminal unless it overlaps one of higher rank. When no pair repeats, neighbours are joined until each stretch is one symbol, so the tree stays
   flat. Every replacement is a derivation position of its nonterminal.
3. A run crosses the boundary of the lowest nonterminal that derives it. For each nonterminal, once: a period q at a boundary shows as a window of
   GRAM words beside the boundary that occurs again q words away, and matches to both sides give the run. Matches are measured by prefix hashes and
   the runs then compared word by word, so no run rests on a hash.
4. Runs are translated to all derivation positions; those of one period that overlap by a period are one run, whose ends are then the furthest.

Texts of a batch go through these steps together, as arrays. Work is about n log n of the repeated stretches, memory in proportion to a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LEAST, LEAST_POWERS = 24, 3
#: A window of so many words within a run occurs again a period away (see `stretches`).
GRAM = LEAST // LEAST_POWERS
#: Words of texts that are searched together (a longer single text is searched alone).
WORDS_AT_ONCE = 200_000
#: Candidate periods that are measured together.
PERIODS_AT_ONCE = 500_000

_EVEN = np.uint64(0x9E3779B97F4A7C15)


def _hash_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return shared.mixed(a * _EVEN + shared.mixed(b))


def window_hashes(ids: np.ndarray) -> np.ndarray:
    """A hash of the GRAM = 8 ids from each position on (as many as fit)."""
    h = shared.mixed(ids.astype(np.uint64) + _EVEN)
    step = 1
    while step < GRAM:
        h = _hash_pairs(h[:-step], h[step:])
        step *= 2
    return h


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint (start, end) of LEAST words or more that windows of GRAM words cover which occur twice; every run lies in one.

    A window of GRAM words in a run of period q and L >= max(24, 3q) words has a copy q words before or after it within the run: else L < 2q + 8,
    so q < 8 and L < 24. Coinciding hashes only add stretches.
    """
    if len(ids) < LEAST:
        return []
    h = window_hashes(ids)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    if not len(at):
        return []
    # windows that overlap or touch cover one stretch
    first = np.flatnonzero(np.diff(at, prepend=at[0] - GRAM - 1) > GRAM)
    starts, ends = at[first], at[np.append(first[1:], len(at)) - 1] + GRAM
    long = ends - starts >= LEAST
    return list(zip(starts[long].tolist(), ends[long].tolist()))


# ---------------------------------------------------------------- the grammar


class Grammar:
    """Nonterminals of a word sequence and where each is derived.

    node, start, left, size: one entry a derivation position: the nonterminal, its first word, words of its left part, all its words.
    """

    def __init__(self, words: np.ndarray, group: np.ndarray):
        """words: ids; group: number of the stretch of each word (ascending). Ids of different texts differ, so a pair belongs to one text."""
        self._symbol, self._start, self._group = words.astype(np.int64), np.arange(len(words)), group
        self._size = np.ones(len(words), np.int64)
        self._next = int(words.max()) + 1 if len(words) else 0
        self._made: list[tuple[np.ndarray, ...]] = []
        while self._repair_round():
            pass
        while self._join_round():
            pass
        parts = [np.concatenate(p) for p in zip(*self._made)] if self._made else [np.zeros(0, np.int64)] * 4
        self.node, self.start, self.left, self.size = parts

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions i whose neighbour i + 1 is of the same stretch, number of each one's pair)."""
        at = np.flatnonzero(self._group[1:] == self._group[:-1])
        key = self._symbol[at] * np.int64(self._next) + self._symbol[at + 1]
        return at, key

    def _repair_round(self) -> bool:
        """Replace the occurrences of repeated pairs that overlap none of higher rank; False when no pair repeats."""
        at, key = self._pairs()
        if not len(at):
            return False
        _, number, count = np.unique(key, return_inverse=True, return_counts=True)
        if count.max() < 2:
            return False
        order = np.lexsort((shared.mixed(np.arange(len(count), dtype=np.uint64)), count))
        rank = np.empty(len(count), np.int64)
        rank[order] = np.arange(1, len(count) + 1)
        rank[count < 2] = 0
        here = np.zeros(len(self._symbol) + 2, np.int64)  # rank of the pair that starts at i - 1
        here[at + 1] = rank[number]
        middle = here[1:-1]
        # a stretch of one pair (a a a ...) takes every other place from its left end
        same = (middle > 0) & (middle == here[:-2])
        since = np.arange(len(middle)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(middle))))
        in_row = (middle == here[:-2]) | (middle == here[2:])
        below_left = (here[:-2] > middle) & ~same
        below_right = (here[2:] > middle) & (middle != here[2:])
        take = (middle > 0) & ~below_left & ~below_right & (~in_row | (since % 2 == 0))
        self._replace(np.flatnonzero(take))
        return True

    def _join_round(self) -> bool:
        """Join neighbours two by two within each stretch; False when each is one symbol."""
        first = np.flatnonzero(np.diff(self._group, prepend=-1) != 0)
        place = np.arange(len(self._group)) - np.repeat(first, np.diff(first, append=len(self._group)))
        at = np.flatnonzero((self._group[1:] == self._group[:-1]) & (place[:-1] % 2 == 0))
        if not len(at):
            return False
        self._replace(at)
        return True

    def _replace(self, at: np.ndarray) -> None:
        """Put nonterminals for the pairs that start at `at` (no two overlap)."""
        key = self._symbol[at] * np.int64(self._next) + self._symbol[at + 1]
        kinds, number = np.unique(key, return_inverse=True)
        left, size = self._size[at], self._size[at] + self._size[at + 1]
        self._made.append((self._next + number, self._start[at], left, size))
        self._symbol[at], self._size[at] = self._next + number, size
        self._next += len(kinds)
        keep = np.ones(len(self._symbol), bool)
        keep[at + 1] = False
        self._symbol, self._start, self._size, self._group = self._symbol[keep], self._start[keep], self._size[keep], self._group[keep]
        if self._next >= 1 << 31:
            raise ValueError("too many symbols for keys of two")


# ---------------------------------------------------------------- runs at boundaries


#: Two primes under 2^31, so that products of two remainders fit 64 bits.
_PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
_BASES = (np.uint64(1103515249), np.uint64(1736459287))


def _powers(base: np.uint64, prime: np.uint64, count: int) -> np.ndarray:
    """base^0 .. base^(count - 1) modulo the prime, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < count:
        out = np.concatenate((out, out * (out[-1] * base % prime) % prime))
    return out[:count]


class Matches:
    """Longest matches between places of a word sequence, by prefix hashes modulo two primes (never too short)."""

    def __init__(self, words: np.ndarray):
        self.words = words
        value = shared.mixed(words.astype(np.uint64) + _EVEN)
        self.parts = []
        for base, prime in zip(_BASES, _PRIMES):
            power = _powers(base, prime, len(words) + 1)
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(value % prime * power[:-1] % prime, out=sums[1:])
            self.parts.append((prime, power, sums))

    def _equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i and from j on (i < j) have equal hashes."""
        ok = np.ones(len(i), bool)
        for prime, power, sums in self.parts:
            ok &= (sums[i + n] - sums[i]) % prime * power[j - i] % prime == (sums[j + n] - sums[j]) % prime
        return ok

    def forward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Greatest n <= most such that the n words from i and from j on are equal."""
        low, high = np.zeros(len(i), np.int64), np.maximum(most, 0)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            ok = self._equal(i[open_], j[open_], middle)
            low[open_] = np.where(ok, middle, low[open_])
            high[open_] = np.where(ok, high[open_], middle - 1)
        return low

    def backward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Greatest n <= most such that the n words before i and before j are equal."""
        low, high = np.zeros(len(i), np.int64), np.maximum(most, 0)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            ok = self._equal(i[open_] - middle, j[open_] - middle, middle)
            low[open_] = np.where(ok, middle, low[open_])
            high[open_] = np.where(ok, high[open_], middle - 1)
        return low

    def holds(self, start: int, end: int, period: int) -> bool:
        return bool((self.words[start : end - period] == self.words[start + period : end]).all())


def boundary_runs(words: np.ndarray, start: np.ndarray, left: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nonterminal's number, start, end, period) of the runs that cross the boundary of each given nonterminal, within what it derives.

    Right side: the words from the boundary on hold a whole period, so the word before the boundary occurs again q words later, and so does the
    window of GRAM words that starts there or that ends there, as the run has 16 such pairs in a row at least. The left side is its mirror image.
    """
    empty = np.zeros(0, np.int64)
    which = np.flatnonzero(size >= LEAST)
    if not len(which):
        return empty, empty, empty, empty
    _, window = np.unique(window_hashes(words), return_inverse=True)
    order = np.argsort(window, kind="stable")
    place = np.empty(len(window), np.int64)
    place[order] = np.arange(len(window))
    stop = np.searchsorted(window[order], np.arange(window.max() + 1), "right")
    begin = np.searchsorted(window[order], np.arange(window.max() + 1), "left")
    low, border, high = start[which], start[which] + left[which], start[which] + size[which]
    most = size[which] // LEAST_POWERS
    matches, found = Matches(words), []
    for right in (True, False):
        for anchor in (border - 1, border - GRAM) if right else (border, border - GRAM + 1):
            ok = np.flatnonzero((anchor >= low) & (anchor + GRAM <= high))
            a, n = anchor[ok], most[ok]
            at, kind = place[a], window[a]
            # copies of the anchor's window within `most` words to the right (left) stand next to it in `order`
            if right:
                upto = _last_within(order, at, stop[kind], a + n)
                count = upto - at - 1
            else:
                upto = _first_within(order, begin[kind], at, a - n)
                count = at - upto
            for k in _chunks(count, PERIODS_AT_ONCE):
                own = np.repeat(np.arange(len(k)), count[k])
                if not len(own):
                    continue
                step = np.arange(len(own)) - np.repeat(np.cumsum(count[k]) - count[k], count[k]) + 1
                other = order[at[k][own] + step] if right else order[at[k][own] - step]
                q = np.abs(other - a[k][own])
                node = ok[k][own]
                b, lo, hi = border[node], low[node], high[node]
                i, j = (b, b + q) if right else (b - q, b)
                fits = (i >= lo) & (j <= hi)
                node, q, i, j, lo, hi = node[fits], q[fits], i[fits], j[fits], lo[fits], hi[fits]
                back, ahead = matches.backward(i, j, i - lo), matches.forward(i, j, hi - j)
                s, e = i - back, j + ahead
                crosses = (s < border[node]) & (e > border[node])
                good = crosses & (e - s >= LEAST) & (e - s >= LEAST_POWERS * q)
                found.append((node[good], s[good], e[good], q[good]))
    node, s, e, q = (np.concatenate(p) for p in zip(*found)) if found else (empty,) * 4
    # one stretch of many periods: the smallest counts, and was a candidate too
    pick = np.lexsort((q, e, s, node))
    node, s, e, q = node[pick], s[pick], e[pick], q[pick]
    first = np.ones(len(node), bool)
    first[1:] = (node[1:] != node[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    node, s, e, q = node[first], s[first], e[first], q[first]
    true = np.array([matches.holds(*r) for r in zip(s.tolist(), e.tolist(), q.tolist())], bool)
    if not true.all():
        raise ArithmeticError("two different stretches of words have one hash")
    return which[node], s, e, q


def _chunks(count: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Consecutive numbers whose counts add to about `most` (a larger single one alone)."""
    total = np.cumsum(count)
    at = 0
    while at < len(count):
        last = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield np.arange(at, last)
        at = last


def _last_within(order: np.ndarray, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """First index in (low, high] whose order value exceeds limit (order ascends there), or high."""
    low, high = low + 1, high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        ok = order[middle] <= limit[open_]
        low[open_] = np.where(ok, middle + 1, low[open_])
        high[open_] = np.where(ok, high[open_], middle)
    return low


def _first_within(order: np.ndarray, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """First index in [low, high) whose order value is limit at least, or high."""
    low, high = low.copy(), high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        ok = order[middle] < limit[open_]
        low[open_] = np.where(ok, middle + 1, low[open_])
        high[open_] = np.where(ok, high[open_], middle)
    return low


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text (an array of word ids), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    pieces, base, owner = [], 0, []
    for t, ids in enumerate(texts):
        for a, b in stretches(ids):
            pieces.append(ids[a:b].astype(np.int64) + base)
            owner.append((t, a))
        base += int(ids.max()) + 1 if len(ids) else 0
    if not pieces:
        return out
    lengths = np.array([len(p) for p in pieces])
    group = np.repeat(np.arange(len(pieces)), lengths)
    ends = np.cumsum(lengths)
    # ids without gaps; a border word between stretches keeps windows and matches inside them
    _, dense = np.unique(np.concatenate(pieces), return_inverse=True)
    words = np.full(len(dense) + len(pieces), -1, np.int64)
    at = np.arange(len(dense)) + group
    words[at] = dense
    words[ends + np.arange(len(pieces))] = dense.max() + 1 + np.arange(len(pieces))
    grammar = Grammar(dense, group)
    node, first = np.unique(grammar.node, return_index=True)
    start = at[grammar.start]
    number, s, e, q = boundary_runs(words, start[first], grammar.left[first], grammar.size[first])
    if not len(number):
        return out
    # translate each nonterminal's runs to all places where it is derived
    places = np.argsort(grammar.node, kind="stable")
    begin, many = np.searchsorted(grammar.node[places], node[number], "left"), np.searchsorted(grammar.node[places], node[number], "right")
    times = many - begin
    own = np.repeat(np.arange(len(number)), times)
    occurrence = places[np.repeat(begin, times) + np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)]
    shift = start[occurrence] - start[first][number][own]
    s, e, q = s[own] + shift, e[own] + shift, q[own]
    for s, e, q in merged(s, e, q):
        k = int(np.searchsorted(ends + np.arange(len(pieces)), s, "right"))
        t, a = owner[k]
        offset = a - (int(ends[k]) - int(lengths[k]) + k)
        out[t].append((s + offset, e - s, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def merged(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> list[tuple[int, int, int]]:
    """Intervals of one period that overlap by a period at least are parts of one run: their unions."""
    order = np.lexsort((s, q))
    out: list[list[int]] = []
    for a, b, p in zip(s[order].tolist(), e[order].tolist(), q[order].tolist()):
        if out and out[-1][2] == p and a <= out[-1][1] - p:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, p])
    return [tuple(r) for r in out]


# ---------------------------------------------------------------- the operator


def find(docs: DataFrame, carried: list[str], runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """The carried columns of docs (column text), every run of the text, and the text without the repeats.

    runs: array of (start, length, period) in words, by start, then period. collapsed: the words that no run holds after its first period, joined
    by single spaces. Words are [^\\x20\\x09-\\x0D]+. NULL and empty texts have no runs and an empty collapsed text. Repeated rows stay; each row
    is searched alone, so no key can be hot.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def searched(words: list[list[bytes]], ids: list[np.ndarray]) -> Iterator[tuple[list[dict], bytes]]:
        for row, numbers, found in zip(words, ids, runs_of(ids)):
            if found:
                change = np.zeros(len(row) + 1, np.int64)
                for start, length, period in found:
                    change[start + period] += 1
                    change[start + length] -= 1
                row = [row[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
            yield [{"start": a, "length": n, "period": p} for a, n, p in found], b" ".join(row)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(carried)).cast(pa.large_binary())
            found, kept, words, ids, waiting = [], [], [], [], 0
            for i in range(len(texts)):
                row = (texts[i].as_py() or b"").split()
                number: dict[bytes, int] = {}
                words.append(row)
                ids.append(np.fromiter((number.setdefault(w, len(number)) for w in row), np.int64, len(row)))
                waiting += len(row)
                if waiting >= WORDS_AT_ONCE or i == len(texts) - 1:
                    for r, c in searched(words, ids):
                        found.append(r)
                        kept.append(c)
                    words, ids, waiting = [], [], 0
            text = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(found, pa.list_(run)), text], names=[*carried, runs, collapsed])

    schema = shared.schema_of(docs, carried, f"`{runs}` array<struct<start: bigint, length: bigint, period: bigint>>", f"`{collapsed}` string")
    return docs.select(*[F.col(f"`{c}`") for c in carried], "text").mapInArrow(work, schema)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """docs whose text has a periodic tail where crc32(doc_id as text) is divisible by 10 (NULL doc_id: no change).

    With g = crc32 / 10 and n > 0 words, each word i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8), whole numbers.
    """
    h, words, a, p = shared.own_names(docs, "_h", "_words", "_a", "_p")
    n = F.size(words).cast("long")
    rest = (n - F.col(a)).cast("int")
    g = F.floor(F.col(h) / 10).cast("long")
    out = docs.withColumn(h, F.crc32(F.col("doc_id").cast("string").cast("binary")))
    split = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    out = out.withColumn(words, F.when(F.col(h) % 10 == 0, split))
    out = out.withColumn(a, F.when(n > 0, g % n).cast("int"))
    out = out.withColumn(p, F.floor(1 + F.floor(rest / (3 + g % 8))).cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, F.col(a) + 1, F.col(p)), F.ceil(rest / F.col(p)).cast("int"))), 1, rest)
    made = F.array_join(F.concat(F.slice(words, F.lit(1), F.col(a)), tail), " ")
    return out.withColumn("text", F.when(F.col(a).isNotNull(), made).otherwise(F.col("text"))).drop(h, words, a, p)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of documents after planting, as counts, the run of most periods, and digests."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(with_planted_periods(docs), ["doc_id"])
    # periods in a run as an exact fraction: a is before b if a.length * b.period is greater
    first = lambda a, b: F.when(
        a["length"].cast("decimal(19,0)") * b["period"] > b["length"].cast("decimal(19,0)") * a["period"], F.lit(-1)
    ).when(a["length"].cast("decimal(19,0)") * b["period"] < b["length"].cast("decimal(19,0)") * a["period"], F.lit(1)).when(
        a["start"] != b["start"], F.when(a["start"] < b["start"], F.lit(-1)).otherwise(F.lit(1))
    ).otherwise(F.when(a["period"] < b["period"], F.lit(-1)).when(a["period"] > b["period"], F.lit(1)).otherwise(F.lit(0)))
    found = found.withColumn("_best", F.get(F.array_sort("runs", first), F.lit(0)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
