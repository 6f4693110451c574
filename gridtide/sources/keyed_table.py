"""Keyed tables with snapshots: upserts that rewrite only what a batch touches and become visible all at once.

Layout below the table's folder:

    data/<version>-<unique>/_p=<partition>/_b=<bucket>/...parquet     files, never changed once written
    manifests/<version>.json                                         one snapshot: where each group's rows are, and what has been applied

Rows are in groups: a partition value and a bucket of the key's hash. An upsert stores the batch by group, merges it with the stored rows of the groups that
it touches into new files, and commits by renaming one manifest into place, which fails if another writer has committed that version before. A reader
takes the newest manifest and then reads only files that nobody changes, so it never sees half a write. A write that dies before its rename leaves
unreferenced files, no rows. The manifest also carries the last batch of each source, so a replayed batch changes nothing, and marks (how far each
source has been loaded), which therefore move with the rows they cover or not at all.

A manifest holds one line a group; choose partition and buckets so that groups have millions of rows, and it stays small.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import keep_last


class Conflict(RuntimeError):
    """Another writer has committed this version; read again and repeat."""


@dataclass(frozen=True)
class Snapshot:
    version: int
    schema: str
    keys: list[str]
    order: str
    partition: str | None
    buckets: int
    groups: dict[str, str] = field(default_factory=dict)  # group -> folder of its files below data
    applied: dict[str, int] = field(default_factory=dict)  # source -> last batch
    marks: dict[str, str] = field(default_factory=dict)  # source -> how far it has been loaded


class KeyedTable:
    """The table at a path (any Hadoop file system). keys, order (the later row of a key wins), partition and buckets are fixed by the first write."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, partition: str | None = None, buckets: int = 8):
        self.spark, self.path = spark, path.rstrip("/")
        self.made = Snapshot(0, "", list(keys), order, partition, buckets)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)
        self._jvm = jvm

    # ------------------------------------------------------------ snapshots

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def snapshot(self, version: int | None = None) -> Snapshot | None:
        """The newest snapshot, or a given one; None for a table that has no rows yet."""
        found = self.versions()
        if version is not None and version not in found:
            raise ValueError(f"no version {version}")
        if not found:
            return None
        stream = self._fs.open(self._path(self._manifest(found[-1] if version is None else version)))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(**json.loads(text))

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def _commit(self, snapshot: Snapshot) -> None:
        """Write the manifest beside its place and rename it there; a rename onto an existing version fails."""
        hidden, place = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._path(self._manifest(snapshot.version))
        out = self._fs.create(hidden, False)
        try:
            out.write(bytearray(json.dumps(snapshot.__dict__).encode()))
        finally:
            out.close()
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self._conf)
        try:
            context.rename(hidden, place, options)
        except Exception as error:
            self._fs.delete(hidden, False)
            if self._fs.exists(place):
                raise Conflict(f"version {snapshot.version} of {self.path} exists") from error
            raise

    # ------------------------------------------------------------ reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a snapshot."""
        snapshot = self.snapshot(version)
        if snapshot is None:
            raise ValueError(f"{self.path} has no rows yet")
        return self._rows(snapshot, list(snapshot.groups))

    def _rows(self, snapshot: Snapshot, groups: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(snapshot.schema))
        folders = [f"{self.path}/data/{snapshot.groups[g]}/{g}" for g in groups]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def mark(self, source: str) -> str | None:
        snapshot = self.snapshot()
        return snapshot.marks.get(source) if snapshot else None

    # ------------------------------------------------------------ writing

    def _placed(self, df: DataFrame, of: Snapshot) -> DataFrame:
        part = F.col(of.partition).cast("string") if of.partition else F.lit("all")
        return df.withColumns({"_p": F.coalesce(part, F.lit("null")), "_b": F.pmod(F.xxhash64(*of.keys), F.lit(of.buckets))})

    def _store(self, kept: DataFrame, version: int) -> str:
        """Write rows by group: the new folder."""
        folder = f"{version:012d}-{uuid.uuid4().hex}"
        kept.write.partitionBy("_p", "_b").parquet(f"{self.path}/data/{folder}")
        return folder

    def _groups(self, folder: str) -> set[str]:
        found = self._fs.globStatus(self._path(f"{self.path}/data/{folder}/_p=*/_b=*")) or []
        return {f"{s.getPath().getParent().getName()}/{s.getPath().getName()}" for s in found}

    def upsert(self, batch: DataFrame, source: str = "", batch_id: int | None = None, marks: dict[str, str] | None = None) -> bool:
        """Merge a batch; False if this batch of the source has been applied before. The batch is computed once.

        Of rows with equal keys the one with the greatest order value stays, a stored row against an equal one of the batch gives way. The partition
        of a key must not change. Columns must be those of the first write.
        """
        now = self.snapshot()
        of = now or replace(self.made, schema=batch.schema.json())
        if batch_id is not None and of.applied.get(source, -1) >= batch_id:
            return False
        version = of.version + 1
        names = T.StructType.fromJson(json.loads(of.schema)).fieldNames()
        group = ["_p", "_b"]
        # a batch may hold very many rows of a key: they are reduced before they are dealt to groups
        last = keep_last(self._placed(batch.select(*names), of), [*group, *of.keys], [F.col(of.order)])
        folder = self._store(last.repartition(*group), version)
        touched = self._groups(folder)
        groups = {**of.groups, **dict.fromkeys(touched, folder)}
        old = sorted(touched & of.groups.keys())
        if old:
            staged = replace(of, groups=dict.fromkeys(old, folder))
            both = self._rows(of, old).withColumn("_age", F.lit(0)).unionAll(self._rows(staged, old).withColumn("_age", F.lit(1)))
            # at most two rows a key: dealt to groups at once, and compared there
            merged = keep_last(self._placed(both, of).repartition(*group), [*group, *of.keys], [F.col(of.order), F.col("_age")])
            groups |= dict.fromkeys(old, self._store(merged.drop("_age"), version))
        applied = of.applied if batch_id is None else {**of.applied, source: batch_id}
        self._commit(replace(of, version=version, groups=groups, applied=applied, marks={**of.marks, **(marks or {})}))
        return True

    def expire(self, keep: int = 2) -> int:
        """Delete the manifests before the newest `keep`, and the groups' folders that no kept one names; the number of those.

        Run it when no write is under way: what a write has stored but not committed is not named either.
        """
        versions = self.versions()
        kept = {(f, g) for v in versions[-keep:] for g, f in self.snapshot(v).groups.items()}
        for v in versions[:-keep]:
            self._fs.delete(self._path(self._manifest(v)), False)
        gone = [(s.getPath().getName(), g) for s in self._fs.listStatus(self._path(f"{self.path}/data")) for g in self._groups(s.getPath().getName())]
        gone = [x for x in gone if x not in kept]
        for folder, group in gone:
            self._fs.delete(self._path(f"{self.path}/data/{folder}/{group}"), True)
        return len(gone)


def _micros(c: Column, kind: str) -> Column:
    """A time as microseconds; a wall time as if it were UTC, whatever the session's zone."""
    if kind != "timestamp_ntz":
        return F.unix_micros(c)
    seconds = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def _literal(micros: int, kind: str) -> Column:
    """The time of _micros, as a constant of the column's type."""
    at = datetime.fromtimestamp(0, UTC) + timedelta(microseconds=micros)
    return F.lit(at.strftime("%Y-%m-%d %H:%M:%S.%f") + ("" if kind == "timestamp_ntz" else "+00:00")).cast(kind)


def after_marks(rows: DataFrame, marks: dict[str, int], key: str, t: str, default_days: int = 7) -> DataFrame:
    """Rows of sources with a mark that are newer than it, and of others those of the `default_days` before their newest row.

    The least mark is a literal in the filter, so it reaches the scan, which skips files and row groups before it.
    """
    kind = rows.schema[t].dataType.simpleString()
    named = F.col(key).cast("string")
    fresh = rows
    if marks:
        own = F.create_map(*[F.lit(x) for pair in marks.items() for x in pair])
        fresh = rows.filter(F.col(t) > _literal(min(marks.values()), kind)).filter(_micros(F.col(t), kind) > F.try_element_at(own, named))
    strangers = rows.filter(F.col(key).isNotNull() & ~named.isin(*marks)) if marks else rows.filter(F.col(key).isNotNull())
    newest = strangers.groupBy(F.col(key).alias("_key")).agg((F.max(_micros(F.col(t), kind)) - default_days * 86_400_000_000).alias("_from"))
    late = strangers.join(newest, F.col(key) == F.col("_key")).filter(_micros(F.col(t), kind) > F.floor(F.col("_from") / 1_000_000) * 1_000_000)
    late = late.drop("_key", "_from")
    return fresh.unionAll(late) if marks else late


def load_new(table: KeyedTable, rows: DataFrame, key: str, t: str, default_days: int = 7) -> bool:
    """Load what each source (a value of `key`) has after its stored mark; False if there is nothing.

    The new marks are the newest times among the rows taken and are committed with them: a failed load leaves both as they were, and rows that arrive
    meanwhile wait for the next load. The driver sees one row a source.
    """
    now = table.snapshot()
    fresh = after_marks(rows, {k: int(v) for k, v in now.marks.items()} if now else {}, key, t, default_days)
    kind = rows.schema[t].dataType.simpleString()
    newest = fresh.groupBy(F.col(key).cast("string").alias("k")).agg(F.max(_micros(F.col(t), kind)).alias("m")).collect()
    if not newest:
        return False
    upto = F.create_map(*[F.lit(x) for r in newest for x in (r["k"], r["m"])])
    taken = fresh.filter(_micros(F.col(t), kind) <= F.try_element_at(upto, F.col(key).cast("string")))
    return table.upsert(taken, marks={r["k"]: str(r["m"]) for r in newest})
