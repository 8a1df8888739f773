"""Streams: the changes of a table after an offset, previewed or consumed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.errors import StreamConcurrentConsume, StreamPayloadMissing, StreamStale
from sedimenta.sources.store import FileExists, Store
from sedimenta.sources.table import ROW_ID, VersionedTable, footer_stats

# Metadata columns of a stream.
METADATA = ("METADATA$ACTION", "METADATA$ISUPDATE", "METADATA$ROW_ID", "METADATA$TXN_ID", "METADATA$COMMIT_TS", "METADATA$SEQUENCE")
CHECKED_FILES = 256  # payload files whose presence and length the driver verifies itself; tasks verify the others, so many each


class Offset:
    """A stream's committed sequence; moved by creating the next numbered file, so one of two consumers wins."""

    def __init__(self, store: Store, stream_id: str):
        self.store, self.folder = store, f"streams/{stream_id}"

    def get(self) -> tuple[int, int]:
        """(number of the move, committed sequence)."""
        move = self.store.latest(self.folder)
        return move, self.store.read(f"{self.folder}/{move:020d}.json")["sequence"] if move else 0

    def advance(self, move: int, sequence: int) -> None:
        try:
            self.store.create(f"{self.folder}/{move + 1:020d}.json", {"sequence": sequence})
        except FileExists:
            raise StreamConcurrentConsume("the stream's offset was moved by another consumer") from None


def records(table: VersionedTable, after: int, through: int | None = None) -> list[dict]:
    """Change records with a sequence in (after, through], in order."""
    found = [c | {"txn_id": e["txn_id"], "commit_ts": e["commit_ts"]} for e in table.entries_after_sequence(after) for c in e["changes"]]
    return [c for c in found if c["seq_end"] > after and (through is None or c["seq_start"] <= through)]


def payload_fault(path: str, rows: int) -> str | None:
    """What is wrong with a payload file: that it is not there or has fewer rows than recorded."""
    try:
        return f"{path} is short" if footer_stats(path, [])["rows"] < rows else None
    except FileNotFoundError:
        return path


def first_fault(spark: SparkSession, found: list[dict]) -> str | None:
    """A fault of the first faulty one of the files, whose footers are read by tasks; one row reaches the driver."""
    if not found:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            faults = [payload_fault(path, rows) for path, rows in zip(batch.column("path").to_pylist(), batch.column("rows").to_pylist())]
            yield pa.record_batch([batch.column("at"), pa.array(faults, pa.string())], names=["at", "fault"])

    listed = spark.createDataFrame([(i, c["path"], c["rows"]) for i, c in enumerate(found)], "at long, path string, rows long").repartition(-(-len(found) // CHECKED_FILES), "at")
    return listed.mapInArrow(run, "at long, fault string").where("fault is not null").agg(F.min_by("fault", "at")).first()[0]


def changes(table: VersionedTable, after: int, through: int | None = None, verify: bool = True) -> DataFrame:
    """The table's current columns and METADATA of all changes with a sequence in (after, through].

    A row's sequence is its record's first one plus its place in the payload file, so nothing is sorted or shuffled.
    """
    head = table.head()
    through = head.sequence if through is None else through
    found = records(table, after, through)
    columns = head.columns
    out = T.StructType([*[T.StructField(c.name, c.spark_type) for c in columns], *[T.StructField(n, t) for n, t in zip(METADATA, (T.StringType(), T.BooleanType(), T.StringType(), T.LongType(), T.LongType(), T.LongType()))]])
    if not found:
        return table.spark.createDataFrame([], out)
    if verify:
        for record in found[:CHECKED_FILES]:
            if fault := payload_fault(record["path"], record["rows"]):
                raise StreamPayloadMissing(fault)
        if fault := first_fault(table.spark, found[CHECKED_FILES:]):
            raise StreamPayloadMissing(fault)
    keyed = [(c["path"].rsplit("/", 2)[1] + "/" + c["path"].rsplit("/", 1)[1], c["seq_start"], c["action"], c["is_update"], c["txn_id"], c["commit_ts"]) for c in found]
    about = table.spark.createDataFrame(keyed, "__key string, __start long, __action string, __update boolean, __txn long, __ts long")
    raw = table.spark.read.schema(head.stored_schema()).parquet(*[c["path"] for c in found])
    place = F.concat_ws(":", F.lit(table.table_id), F.regexp_replace("_metadata.file_name", r"\.parquet$", ""), F.col("_metadata.row_index"), F.lit("0"))
    rows = raw.select(*[F.col(c.stored).alias(c.name) for c in columns], F.coalesce(F.col(ROW_ID), place).alias("__row"), F.regexp_extract("_metadata.file_path", r"([^/]+/[^/]+)$", 1).alias("__key"), F.col("_metadata.row_index").alias("__place"))
    met = rows.join(about, "__key").withColumn("__sequence", F.col("__start") + F.col("__place"))
    met = met.where((F.col("__sequence") > after) & (F.col("__sequence") <= through))
    parts = ("__action", "__update", "__row", "__txn", "__ts", "__sequence")
    return met.select(*[F.col(f"`{c.name}`") for c in columns], *[F.col(p).alias(n) for p, n in zip(parts, METADATA)])


def check_retention(table: VersionedTable, after: int, purged_through: int) -> None:
    if after < purged_through:
        raise StreamStale(f"changes up to sequence {purged_through} are purged, the stream is at {after}")


def net_changes(table: VersionedTable, after: int, through: int | None = None) -> DataFrame:
    """Last change per row id in (after, through]: columns, ROW_ID and __alive."""
    all_ = changes(table, after, through, verify=False)
    names = [c.name for c in table.head().columns]
    last = all_.groupBy(F.col("`METADATA$ROW_ID`").alias(ROW_ID)).agg(F.max(F.struct(F.col("`METADATA$SEQUENCE`").alias("s"), (F.col("`METADATA$ACTION`") == "INSERT").alias("alive"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("r"))).alias("c"))
    return last.select(*[F.col(f"c.r.`{n}`").alias(n) for n in names], ROW_ID, F.col("c.alive").alias("__alive"))
