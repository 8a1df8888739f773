"""Change feeds applied to a bucketed copy-on-write table.

A table is a folder of Parquet files, each holding one hash bucket of the keys in order of the keys, and a manifest that
names the files of every bucket. Applying a batch of changes routes them to their buckets in one shuffle, merges each
touched bucket's sorted rows with its sorted changes where the changes are, writes replacement files and then publishes
a new manifest under the next number; readers see one version or the next. Rows of the table are never shuffled and
buckets without changes are not read. Deleted keys stay as tombstones with their sequence, so a change that arrives
late, after a newer one was applied, is recognised as outdated.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.sources.store import FileExists, open_uri, publish, qualified

BUCKET_ROWS = 1_000_000  # rows aimed at in a bucket
GROUP_ROWS = 131_072  # rows of a bucket that are merged at a time
STEPS = 4  # batches in which a whole feed is applied
INSERTS = ("I", "INSERT", "U", "UPDATE", "UPSERT")
DELETES = ("D", "DELETE")


class CommitConflict(Exception):
    """Another writer published the same version first."""


def is_insert(action: Column) -> Column:
    """True, False or, for anything unknown, null; case and white space do not matter."""
    plain = F.upper(F.regexp_replace(action, r"\s+", ""))
    return F.when(plain.isin(*INSERTS), True).when(plain.isin(*DELETES), False)


def sorted_rows(rows: pa.Table, keys: list[str], sequence: str) -> pa.Table:
    """Rows by key, the one that counts of each key first: greatest sequence, kept before deleted, greatest remaining columns.

    Nested columns cannot be ordered and do not take part.
    """
    rest = [f.name for f in rows.schema if f.name not in (*keys, sequence, "_deleted") and not pa.types.is_nested(f.type)]
    order = [*[(k, "ascending") for k in keys], (sequence, "descending"), ("_deleted", "ascending"), *[(c, "descending") for c in rest]]
    return rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_end"))


def first_of_each(rows: pa.Table, keys: list[str]) -> pa.Table:
    """The first row of each key of a table in order of the keys."""
    if rows.num_rows < 2:
        return rows
    fresh = None
    for k in keys:
        column = rows.column(k).combine_chunks()
        differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
        fresh = differs if fresh is None else pc.or_(fresh, differs)
    return rows.filter(pa.concat_arrays([pa.array([True]), fresh.combine_chunks() if isinstance(fresh, pa.ChunkedArray) else fresh]))


def keys_through(rows: pa.Table, keys: list[str], last: tuple) -> int:
    """How many rows of a table in order of the keys have a key up to `last`."""
    low, high = 0, rows.num_rows
    while low < high:
        at = (low + high) // 2
        if tuple(rows.column(k)[at].as_py() for k in keys) <= last:
            low = at + 1
        else:
            high = at
    return low


def merged_groups(base: Iterator[pa.Table], changes: pa.Table, keys: list[str], sequence: str) -> Iterator[pa.Table]:
    """A bucket's rows (groups in order of the keys) merged with its changes, group by group."""
    for group in base:
        if not group.num_rows:
            continue
        n = keys_through(changes, keys, tuple(group.column(k)[group.num_rows - 1].as_py() for k in keys))
        near, changes = changes.slice(0, n), changes.slice(n)
        yield first_of_each(sorted_rows(pa.concat_tables([group, near], promote_options="default"), keys, sequence), keys) if n else group
    if changes.num_rows:
        yield changes


class BucketedTable:
    """A keyed table in hash buckets. keys and sequence are column names; `_deleted` and `_bucket` are reserved.

    A key's bucket is Spark's own partition number of it, so the exchange that finds the last change of each key has
    also routed it to its bucket.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sequence: str, buckets: int):
        self.spark, self.path, self.keys, self.sequence, self.buckets = spark, path.rstrip("/"), keys, sequence, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest published version, 0 for a new table."""
        folder = self._path(f"{self.path}/_manifest")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max([0, *(int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith("."))])

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "buckets": {}, "schema": None}
        stream = self._fs.open(self._path(f"{self.path}/_manifest/{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        try:
            publish(self.spark, f"{self.path}/_manifest/{manifest['version']:020d}.json", json.dumps(manifest).encode())
        except FileExists as e:
            raise CommitConflict(f"version {manifest['version']} exists") from e

    def _files(self, manifest: dict) -> list[str]:
        return [f for files in manifest["buckets"].values() for f in files]

    def apply(self, changes: DataFrame, inserted: str) -> int:
        """Apply changes (keys, sequence, boolean `inserted`, payload columns); returns the version that holds them.

        The greatest sequence of a key wins, over the batch and the table; equal sequences are one change, an insert
        before a delete, then the greatest payload. Rows with a null key, sequence or kind are ignored. Without changes
        nothing is published.
        """
        payload = [c for c in changes.columns if c not in (*self.keys, self.sequence, inserted)]
        known = changes.where(F.greatest(*[F.col(c).isNull().cast("int") for c in (*self.keys, self.sequence, inserted)], F.lit(0)) == 0)
        # Last change per key, combined on the map side: a key with any number of changes sends one row per task.
        last = known.groupBy(*self.keys).agg(F.max(F.struct(self.sequence, inserted, *payload)).alias("_c"))
        width = self._width()
        routed = last.repartition(width, *self.keys).select(
            F.pmod(F.hash(*self.keys), F.lit(self.buckets)).cast("int").alias("_bucket"),
            *self.keys, f"_c.{self.sequence}", (~F.col(f"_c.{inserted}")).alias("_deleted"), *[F.col(f"_c.{p}").alias(p) for p in payload],
        ).sortWithinPartitions("_bucket")
        before = self.manifest()
        plain = routed.drop("_bucket").schema
        schema = plain
        if before["version"]:
            held = T.StructType.fromJson(json.loads(before["schema"]))
            schema = T.StructType([*held.fields, *[f for f in plain if f.name not in held.names]])
        written = self._merge(routed, before, schema)
        if before["version"] and not written:
            return before["version"]
        version = before["version"] + 1
        buckets = before["buckets"] | {str(b): [path] for b, path in written}
        if len({b for b, _ in written}) < len(written):
            raise RuntimeError("a bucket was merged by two tasks")
        self._publish({"version": version, "buckets": buckets, "schema": schema.json()})
        return version

    def _width(self) -> int:
        """Partitions of the routing shuffle: the session's number if every one then has whole buckets, else a divisor."""
        wanted = min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return next(n for n in range(wanted, 0, -1) if self.buckets % n == 0)

    def _merge(self, routed: DataFrame, before: dict, schema: T.StructType) -> list[tuple[int, str]]:
        """(bucket, replacement file) of every touched bucket; one small row per bucket reaches the driver.

        A task that is repeated writes files of other names; only those it reports are ever named by a manifest.
        """
        folder = qualified(self.spark, f"{self.path}/data/{before['version'] + 1:020d}")
        old, keys, sequence = before["buckets"], self.keys, self.sequence
        names = schema.names

        def write(bucket: int, changes: pa.Table) -> str:
            import pyarrow.parquet as pq

            def base() -> Iterator[pa.Table]:
                for uri in old.get(str(bucket), []):
                    where, name = open_uri(uri)
                    with where.open_input_file(name) as source:
                        for batch in pq.ParquetFile(source).iter_batches(GROUP_ROWS):
                            yield pa.Table.from_batches([batch])

            path = f"{folder}/bucket-{bucket:06d}-{uuid.uuid4().hex}.parquet"
            where, name = open_uri(path)
            where.create_dir(name.rsplit("/", 1)[0], recursive=True)
            writer = None
            for rows in merged_groups(base(), first_of_each(sorted_rows(changes, keys, sequence), keys), keys, sequence):
                if writer is None:
                    # Columns that only the table or only the changes have are null for the others.
                    kinds = {f.name: f.type for f in [*rows.schema, *changes.schema]}
                    out = pa.schema([pa.field(n, kinds[n]) for n in names if n in kinds])
                    writer = pq.ParquetWriter(name, out, filesystem=where, compression="zstd")
                columns = [rows.column(f.name).cast(f.type) if f.name in rows.column_names else pa.nulls(rows.num_rows, f.type) for f in out]
                writer.write_table(pa.table(columns, schema=out))
            writer.close()
            return path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, parts = None, []
            done: list[tuple[int, str]] = []
            for batch in batches:
                of = batch.column(0).to_numpy()
                edges = [0, *((of[1:] != of[:-1]).nonzero()[0] + 1).tolist(), len(of)] if len(of) else [0]
                rows = batch.select(batch.schema.names[1:])
                for a, b in zip(edges, edges[1:]):
                    if parts and int(of[a]) != at:
                        done.append((at, write(at, pa.Table.from_batches(parts))))
                        parts = []
                    at = int(of[a])
                    parts.append(rows.slice(a, b - a))
            if parts:
                done.append((at, write(at, pa.Table.from_batches(parts))))
            yield pa.record_batch([pa.array([b for b, _ in done], pa.int32()), pa.array([p for _, p in done], pa.string())], names=["bucket", "path"])

        return [(r[0], r[1]) for r in routed.mapInArrow(run, "bucket int, path string").collect()]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows that exist at a version (default: the newest)."""
        manifest = self.manifest(version)
        if not manifest["schema"]:
            raise ValueError(f"{self.path} has no version yet")
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        files = self._files(manifest)
        rows = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        return rows.where(~F.col("_deleted")).drop("_deleted")


# The parallel arrays of a batch and the names of their elements.
ELEMENTS = {"actions": "action", "row_ids": "row_id", "sequences": "sequence", "is_updates": "is_update", "txn_ids": "txn_id", "commit_ts_values": "commit_ts", "statuses": "status", "quantities": "quantity"}


def explode_batches(batches: DataFrame) -> DataFrame:
    """One row per delivered change: (table_id, row_id, sequence, inserted) and the change's other values.

    The parallel arrays are taken element by element; an element that one of them lacks is null. Commit times have
    clock errors, so they are kept as values and sequences alone give the order.
    """
    there = {a: e for a, e in ELEMENTS.items() if a in batches.columns}
    one = batches.where("table_id is not null").select("table_id", F.explode(F.arrays_zip(*there)).alias("c"))
    values = [F.col(f"c.{a}").alias(e) for a, e in there.items() if e != "action"]
    return one.select("table_id", *values, is_insert(F.col("c.actions")).alias("inserted"))


def rebuild(batches: DataFrame, path: str, steps: int = STEPS) -> BucketedTable:
    """Apply a whole feed of change batches to a new bucketed table keyed by (table_id, row_id).

    Batches are applied as they arrived, in `steps` parts of about equal numbers of batches, each to the table that the
    parts before it left; batches without a time of arrival come last. The parts do not change the result.
    """
    spark = batches.sparkSession
    cuts = [F.percentile_approx("arrived_at", [i / steps for i in range(1, steps)]).alias("cuts")] if "arrived_at" in batches.columns and steps > 1 else [F.lit(None).alias("cuts")]
    changes, found = batches.agg(F.sum(F.coalesce(F.size("sequences"), F.lit(0))), *cuts).first()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = BucketedTable(spark, path, ["table_id", "row_id"], "sequence", width * (int(changes or 0) // (BUCKET_ROWS * width) + 1))
    edges = sorted(set(found or []))
    parts = [batches] if not edges else [
        batches.where(F.col("arrived_at") <= edges[0]),
        *[batches.where((F.col("arrived_at") > a) & (F.col("arrived_at") <= b)) for a, b in zip(edges, edges[1:])],
        batches.where(F.col("arrived_at").isNull() | (F.col("arrived_at") > edges[-1])),
    ]
    for part in parts:
        table.apply(explode_batches(part), "inserted")
    return table
