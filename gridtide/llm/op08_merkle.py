"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces; roots test equality, differing branches locate edits.

A text's leaves are short pieces of paragraphs. Where a piece or a section ends is decided by the bytes before the end alone, so an edit changes
the tree around itself and nowhere else. Paragraphs end at newlines; a section ends at a blank line or at a paragraph whose hash says so. Two trees
are compared from the top: branches with equal hashes match whole, only the others are entered.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: One in so many word ends ends a piece; one in so many paragraphs ends a section (powers of two).
PIECE_WORDS = 4
SECTION_PARAGRAPHS = 8
#: Ranges of doc_id that one shuffle partition gets, on average; more make the partitions more even.
RANGES_PER_PARTITION = 4


@dataclass(frozen=True)
class Node:
    digest: bytes
    size: int
    children: tuple[Node, ...] = ()


def _branch(children: list[Node], level: bytes) -> Node:
    return Node(hashlib.sha256(level + b"".join(c.digest for c in children)).digest(), sum(c.size for c in children), tuple(children))


def tree(text: str | None) -> Node:
    """Root over sections over paragraphs over pieces; sizes are bytes of text. A NULL or empty text is a root without children."""
    data = (text or "").encode()
    raw = np.frombuffer(data, np.uint8)
    spaces = np.flatnonzero(raw == 32)
    spaces = spaces[spaces >= 3]
    before = raw[spaces - 1].astype(np.uint32) * np.uint32(0x9E3779B1) + raw[spaces - 2] * np.uint32(0x85EBCA77) + raw[spaces - 3] * np.uint32(0xC2B2AE3D)
    cuts = spaces[(before >> np.uint32(20)) % PIECE_WORDS == 0] + 1
    breaks = np.flatnonzero(raw == 10) + 1
    ends = np.union1d(np.concatenate((cuts, breaks)), [len(data)]) if len(data) else np.zeros(0, np.int64)
    closes = np.isin(ends, breaks).tolist() if len(breaks) else [False] * len(ends)
    sections, paragraphs, pieces, start = [], [], [], 0
    sha = hashlib.sha256
    for end, closed in zip(ends.tolist(), closes):
        pieces.append(Node(sha(b"\0" + data[start:end]).digest(), end - start))
        if closed or end == len(data):
            paragraphs.append(_branch(pieces, b"\1"))
            blank = len(pieces) == 1 and end - start == 1 and closed
            if blank or paragraphs[-1].digest[0] % SECTION_PARAGRAPHS == 0 or end == len(data):
                sections.append(_branch(paragraphs, b"\2"))
                paragraphs = []
            pieces = []
        start = end
    return _branch(sections, b"\3")


def _matched(a: list[Node], b: list[Node]) -> int:
    """Bytes of a's branches that b has too, as multisets; unmatched branches of both are opened together."""
    have = Counter(n.digest for n in b)
    size, open_a = 0, []
    for node in a:
        if have[node.digest] > 0:
            have[node.digest] -= 1
            size += node.size
        else:
            open_a.append(node)
    open_b = []
    for node in b:
        if have[node.digest] > 0:
            have[node.digest] -= 1
            open_b.append(node)
    below_a, below_b = [c for n in open_a for c in n.children], [c for n in open_b for c in n.children]
    return size + (_matched(below_a, below_b) if below_a and below_b else 0)


def likeness(a: Node, b: Node) -> float:
    """Twice the matched bytes over all bytes: 1 for equal trees (also two empty ones), 0 for nothing in common."""
    if a.digest == b.digest:
        return 1.0
    return 2 * _matched(list(a.children), list(b.children)) / max(1, a.size + b.size)


def differing_spans(a: Node, b: Node) -> list[tuple[int, int]]:
    """Byte spans (start, end) of a's text whose pieces b does not have at the level where the branches differ; neighbours are merged."""
    spans: list[tuple[int, int]] = []

    def walk(x: list[Node], y: list[Node], at: list[int]) -> None:
        have = Counter(n.digest for n in y)
        opened, places = [], []
        for node, place in zip(x, at):
            if have[node.digest] > 0:
                have[node.digest] -= 1
            elif node.children:
                opened += node.children
                places += np.cumsum([place, *(c.size for c in node.children)])[:-1].tolist()
            else:
                spans.append((place, place + node.size))
        if opened:
            walk(opened, [c for n in y if have[n.digest] > 0 for c in n.children], places)

    walk(list(a.children), list(b.children), np.cumsum([0, *(c.size for c in a.children)])[:-1].tolist())
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and merged[-1][1] >= start:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with fingerprint (root, 64 hex digits) in place of text; NULL counts as empty; repeated rows get equal fingerprints; other columns stay."""
    others = [c for c in docs.columns if c not in ("text", "fingerprint")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [tree(t.as_py()).digest.hex() for t in batch.column(len(others))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(roots, pa.string())], names=[*others, "fingerprint"])

    return docs.select(*[F.col(f"`{c}`") for c in others], "text").mapInArrow(run, shared.schema_of(docs, others, "fingerprint string"))


# ---------------------------------------------------------------- each text against the next one and its own edit

_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _compared(doc_id: int | None, text: str, own: Node, next_text: str, next_tree: Node) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + next_text[:half]
    changed = tree(edited)
    sha = hashlib.sha256(edited.encode()).hexdigest()
    return doc_id, len(text), sha, own.digest.hex(), changed.digest.hex(), likeness(own, changed), likeness(own, next_tree)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and order; the row after a row of the same range is its next. A range ends with a copy of the next range's first row."""
    last = None  # range, doc_id, text, tree of the row before; range None after a copy
    out: list[tuple] = []
    for batch in batches:
        for number, copy, doc_id, text in zip(*(batch.column(i) for i in range(4))):
            number, copy, doc_id, text = number.as_py(), copy.as_py(), doc_id.as_py(), text.as_py() or ""
            if copy and (last is None or last[0] != number):
                continue
            own = tree(text)
            if last is not None and last[0] == number:
                out.append(_compared(last[1], last[2], last[3], text, own))
            last = None if copy else (number, doc_id, text, own)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _OUT.types)], schema=_OUT)
            out = []


def _at_or_below(limits: list[float]):
    """Number of sorted limits at or below doc_id, 0 for NULL: first by the last limits of equal chunks, then within a chunk."""
    if not limits:
        return F.lit(0)
    step = math.isqrt(len(limits)) + 1
    count = lambda a: F.size(F.filter(a, lambda x: x <= F.col("doc_id")))
    every, lasts = (F.array(*[F.lit(int(x)) for x in part]).cast("array<long>") for part in (limits, limits[step - 1 :: step]))
    whole = count(lasts) * F.lit(step)
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(whole + count(F.slice(every, whole + 1, F.lit(step)))).cast("int")


def edits_and_neighbours(docs: DataFrame) -> DataFrame:
    """For each row: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (see the query).

    Order: doc_id descending, NULL ids last, rows of one id by the text's hash descending; the last row's next is the first; a single row is its own next.
    NULL texts count as empty. Repeated rows stay; each has the next row, which may be its equal. Other columns are ignored.

    The texts are shuffled once, into ranges of doc_id; each range is read as a stream and needs one row from outside, a copy of the first row of the
    range after it. Only range limits and range heads (a fixed number a partition) pass the driver or are broadcast.
    """
    spark = docs.sparkSession
    ranges = RANGES_PER_PARTITION * shared.shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    limits = sorted(set(rows.select("doc_id").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    numbered = rows.select(_at_or_below(limits).alias("range"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text_hash")
    heads = numbered.groupBy("range").agg(F.max(order).alias("head")).collect()  # one row for each range
    heads = sorted(((r["range"], r["head"]["doc_id"], r["head"]["text_hash"]) for r in heads), reverse=True)
    # the range before (higher ids) gets a copy of this range's head; the lowest range gets that of the highest
    copies = [(heads[i - 1][0], heads[i][1], heads[i][2]) for i in range(len(heads))]
    copies = spark.createDataFrame(copies, "to_range int, head_id long, head_hash long")
    match = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("text_hash") == F.col("head_hash"))
    dealt = numbered.join(F.broadcast(copies), match, "left")
    places = F.array(F.struct("range", F.lit(0).alias("copy")), F.struct(F.col("to_range").alias("range"), F.lit(1).alias("copy")))
    dealt = dealt.select(F.explode(F.filter(places, lambda p: p["range"].isNotNull())).alias("p"), "doc_id", "text_hash", "text")
    dealt = dealt.select("p.range", "p.copy", "doc_id", "text_hash", "text").repartition(shared.shuffle_partitions(spark), "range")
    dealt = dealt.sortWithinPartitions("range", "copy", F.desc_nulls_last("doc_id"), F.desc("text_hash"))
    return dealt.select("range", "copy", "doc_id", "text").mapInArrow(
        _neighbours, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op8_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits_and_neighbours(shared.table(spark, sf_dir, "documents"))
