"""Byte-level BPE encoding and decoding as a tree reduction over a monoid.

A piece of text (one match of the split pattern) is cut into halves until a leaf has few bytes; leaves are encoded by plain merging. Two encoded
neighbours are joined by encoding a window of tokens around their border anew. The window grows (doubling, on the side that is not settled) until
the tokens next to it are stable. That is provable: an id sequence is the encoding of its bytes exactly if every two neighbouring ids, taken
alone, encode to themselves; so only the two borders of the new window need a test. Decoding concatenates up the same kind of tree.

Equal pieces are encoded once per worker: a bounded table keeps them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LEAF_BYTES = 4
#: Nodes of the tree up to so many bytes are kept, so that equal parts of different pieces are encoded once.
KEPT_BYTES = 8
#: Windows over so many bytes are merged with a heap.
LONG_BYTES = 64
#: Entries of each of a worker's tables: pieces, tree nodes, window results.
PIECES_KEPT = 400_000
#: Ids of a text are gathered in chunks of so many pieces.
CHUNK_PIECES = 50_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class TreeBpe:
    """Encoder and decoder of one vocabulary; ranks must hold every single byte."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        if array("I").itemsize != 4 or np.array([1], "=u4").tobytes() != np.array([1], "<u4").tobytes():
            raise RuntimeError("ids are packed as little-endian 32-bit integers")
        self.vocabulary = [self.tokens.get(i, b"") for i in range(max(self.tokens, default=-1) + 1)]
        self._nodes: dict[bytes, tuple[int, ...]] = {}
        self._windows: dict[tuple[int, ...], tuple[int, ...]] = {}
        self._packed: dict[str, bytes] = {}

    # ------------------------------------------------------------ one piece

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Plain merging: the neighbours whose union has the lowest rank (the first, if several) become one, until none has a rank."""
        if len(data) > LONG_BYTES:
            return self._merged_long(data)
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        joins = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best = min((r for r in joins if r is not None), default=None)
            if best is None:
                return tuple(ranks[p] for p in parts)
            i = joins.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            joins[i : i + 1] = []
            if i < len(joins):
                joins[i] = ranks.get(parts[i] + parts[i + 1])
            if i:
                joins[i - 1] = ranks.get(parts[i - 1] + parts[i])

    def _merged_long(self, data: bytes) -> tuple[int, ...]:
        """The same for long data: a linked list of parts and a heap of (rank, place), stale entries skipped."""
        ranks, n = self.ranks, len(data)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at a place
        joined = lambda i: ranks.get(data[i : ends[ends[i]]]) if ends[i] < n else None
        now = [joined(i) for i in range(n)]
        heap = [(r, i) for i, r in enumerate(now) if r is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if now[i] != rank:
                continue
            second = ends[i]
            ends[i], now[second] = ends[second], None
            if ends[i] < n:
                before[ends[i]] = i
            for k in (i, before[i]):
                if k >= 0:
                    now[k] = joined(k)
                    if now[k] is not None:
                        heapq.heappush(heap, (now[k], k))
        ids, at = [], 0
        while at < n:
            ids.append(ranks[data[at : ends[at]]])
            at = ends[at]
        return tuple(ids)

    def _window(self, ids: tuple[int, ...]) -> tuple[int, ...]:
        found = self._windows.get(ids)
        if found is None:
            found = self.merged(b"".join(map(self.vocabulary.__getitem__, ids)))
            if len(ids) <= 4:
                if len(self._windows) >= PIECES_KEPT:
                    self._windows.clear()
                self._windows[ids] = found
        return found

    def _stable(self, a: int, b: int) -> bool:
        return self._window((a, b)) == (a, b)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of two neighbours' bytes from their encodings."""
        if not left or not right:
            return left + right
        if self._stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            middle = self._window(left[-i:] + right[:j])
            low = i >= len(left) or self._stable(left[-i - 1], middle[0])
            high = j >= len(right) or self._stable(middle[-1], right[j])
            if low and high:
                return left[: len(left) - i] + middle + right[j:]
            i = i if low else min(len(left), 2 * i)
            j = j if high else min(len(right), 2 * j)

    def tree(self, data: bytes) -> tuple[int, ...]:
        if len(data) > KEPT_BYTES:
            half = len(data) // 2
            return self.join(self.tree(data[:half]), self.tree(data[half:]))
        found = self._nodes.get(data)
        if found is None:
            if len(data) <= LEAF_BYTES:
                found = self.merged(data)
            else:
                half = len(data) // 2
                found = self.join(self.tree(data[:half]), self.tree(data[half:]))
            if len(self._nodes) >= PIECES_KEPT:
                self._nodes.clear()
            self._nodes[data] = found
        return found

    def piece(self, data: bytes) -> tuple[int, ...]:
        """Ids of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self.tree(data)

    # ------------------------------------------------------------ texts

    def _bytes_of_ids(self, piece: str) -> bytes:
        found = array("I", self.piece(piece.encode())).tobytes()
        if len(piece) <= 24:
            if len(self._packed) >= PIECES_KEPT:
                self._packed.clear()
            self._packed[piece] = found
        return found

    def encode_chunks(self, text: str) -> Iterator[bytes]:
        """Ids of a whole text as little-endian unsigned 32-bit integers, in bounded chunks; pieces are encoded separately."""
        kept, make = self._packed, self._bytes_of_ids
        pieces = self.pattern.findall(text) if len(text) < 1_000_000 else (m.group() for m in self.pattern.finditer(text))
        chunk = []
        for piece in pieces:
            chunk.append(kept.get(piece) or make(piece))
            if len(chunk) >= CHUNK_PIECES:
                yield b"".join(chunk)
                chunk = []
        yield b"".join(chunk)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.encode_chunks(text or "")), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: halves are decoded and concatenated up the tree; a leaf joins the bytes of up to CHUNK_PIECES ids."""
        if len(ids) <= CHUNK_PIECES:
            return b"".join(map(self.vocabulary.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _in_workers(spark: SparkSession, ranks_path: str, pattern: str) -> Callable[[], TreeBpe]:
    """The vocabulary file is read here and sent once to each executor (its size is fixed); a worker builds one encoder."""
    sent = spark.sparkContext.broadcast(read_ranks(ranks_path))
    made: list[TreeBpe] = []

    def get() -> TreeBpe:
        if not made:
            made.append(TreeBpe(sent.value, pattern))
        return made[0]

    return get


def encoded(docs: DataFrame, ranks_path: str, pattern: str, digests: bool = False) -> DataFrame:
    """docs with ids (array<int>) in place of text; with digests also n_tokens and decoded_sha256 (of the bytes that the ids decode to).

    A NULL or empty text has no ids. Each row is encoded on its own: repeated rows give equal ids. Other columns stay.
    """
    get = _in_workers(docs.sparkSession, ranks_path, pattern)
    made = ["ids", *["n_tokens", "decoded_sha256"] * digests]
    others = [c for c in docs.columns if c not in ("text", *made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = get()
        for batch in batches:
            for first, rows, _, _ in shared.text_slices(batch.column(len(others))):
                part = batch.slice(first, rows)
                ids = [bpe.encode(t.as_py()) for t in part.column(len(others))]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
                arrays = [*part.columns[: len(others)], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))]
                if digests:
                    decoded = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
                    arrays += [pa.array([len(x) for x in ids], pa.int64()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*others, *made])

    schema = shared.schema_of(docs, others, "ids array<int>", *["n_tokens long, decoded_sha256 string"] * digests)
    return docs.select(*[F.col(f"`{c}`") for c in others], "text").mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, carried: list[str]) -> DataFrame:
    """The carried columns with n_tokens, ids_sha256 and decoded_sha256 of each row (ids as little-endian unsigned 32-bit integers; the decoded
    bytes). A NULL text counts as empty. Digests are made where the ids are, so no ids travel."""
    get = _in_workers(docs.sparkSession, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = get()
        for batch in batches:
            counts, ids_hex, decoded_hex = [], [], []
            for text in batch.column(len(carried)):
                count, ids_hash, decoded_hash = 0, hashlib.sha256(), hashlib.sha256()
                for chunk in bpe.encode_chunks(text.as_py() or ""):
                    count += len(chunk) // 4
                    ids_hash.update(chunk)
                    decoded_hash.update(bpe.decode(np.frombuffer(chunk, "<u4")))
                counts.append(count)
                ids_hex.append(ids_hash.hexdigest())
                decoded_hex.append(decoded_hash.hexdigest())
            arrays = [*batch.columns[: len(carried)], pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(decoded_hex, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carried, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = shared.schema_of(docs, carried, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(*[F.col(f"`{c}`") for c in carried], "text").mapInArrow(run, schema)


def default_vocabulary() -> tuple[str, str]:
    """(rank file, split pattern) that the query uses; the operator takes any."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = default_vocabulary()
    return round_trip(shared.table(spark, sf_dir, "documents"), path, pattern, ["doc_id"])
