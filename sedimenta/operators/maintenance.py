"""Upkeep of versioned tables: statistics, compaction, garbage collection, backups."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedimenta.catalog import Catalog
from sedimenta.operators.dml import Edit
from sedimenta.sources.store import Store
from sedimenta.sources.table import Snapshot, VersionedTable, now_micros

MERGE_LEAST_FILES, MERGE_TARGET_ROWS = 8, 500_000
SLICE_ROWS, MOST_SLICES = 1_000_000, 1_000  # of a histogram's ranking
GRACE_MILLIS = 3_600_000  # a statement may still be about to commit what it wrote


def compact(table: VersionedTable, snapshot: Snapshot, least_files: int = MERGE_LEAST_FILES, target_rows: int = MERGE_TARGET_ROWS) -> Edit:
    """Merge files of fewer than half of target_rows into files near it; row ids and streams are not affected.

    Nothing happens below least_files files or with fewer than two small ones. Parquet files carry footers, so they are
    read and written; newline-delimited and zstandard files are joined without that by operators.compaction.
    """
    files = sorted(snapshot.files.values(), key=lambda f: (f["rows"], f["mp_id"]))
    small = [f for f in files if f["rows"] * 2 < target_rows]
    if len(files) < least_files or len(small) < 2:
        return Edit("compact")
    total = sum(f["rows"] for f in small)
    rows = table.scan(snapshot, small, row_ids=True)
    outputs = max(1, -(-total // target_rows))
    added = table.write(rows.coalesce(outputs) if outputs < 32 else rows.repartition(outputs), snapshot.columns, rows_per_file=target_rows)
    return Edit("compact", added, [f["mp_id"] for f in small], [], total)


def zone_maps(table: VersionedTable, snapshot: Snapshot) -> list[tuple]:
    """(file, rows, column, minimum, maximum, nulls) as text, one row per file and column."""
    names = {c.stored: c.name for c in snapshot.columns}
    return [(m, f["rows"], names[c], None if s["min"] is None else str(s["min"]), None if s["max"] is None else str(s["max"]), s["nulls"]) for m, f in sorted(snapshot.files.items()) for c, s in sorted(f["stats"].items()) if c in names]


def histogram(df: DataFrame, column: str, buckets: int, accuracy: int = 10_000) -> DataFrame:
    """(bucket, low, high, n): equi-height buckets of the non-null values, equal to ntile over all of them in order.

    Equal values are counted first. Slices of about SLICE_ROWS rows, cut at approximate quantiles of the given accuracy,
    are ranked apart and offset by the counts before; the accuracy moves the slices, not the result.
    """
    some = df.where(F.col(column).isNotNull())
    total = some.count()
    slices = min(MOST_SLICES, total // SLICE_ROWS + 1)
    cuts = some.agg(F.percentile_approx(column, [i / slices for i in range(1, slices)], accuracy)).first()[0] if slices > 1 else []
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("v"))) if cuts else F.lit(0)
    counted = some.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("slice", at)
    before = counted.groupBy("slice").agg(F.sum("c").alias("own")).withColumn("offset", F.sum("own").over(Window.orderBy("slice")) - F.col("own"))
    last = F.col("offset") + F.sum("c").over(Window.partitionBy("slice").orderBy("v"))
    ranked = counted.join(before, "slice").select("v", (last - F.col("c")).alias("first"), (last - 1).alias("last"))
    # The first total % buckets buckets have one value more; rank r counts from 0.
    each, more = divmod(total, buckets)
    edge = more * (each + 1)
    of = lambda r: F.when(r < edge, F.floor(r / (each + 1))).otherwise(more + F.floor((r - edge) / max(each, 1))).cast("int")
    start = lambda b: b.cast("long") * each + F.least(b, F.lit(more))
    parts = ranked.select("v", "first", "last", F.explode(F.sequence(of(F.col("first")), of(F.col("last")))).alias("b"))
    held = F.least(F.col("last") + 1, start(F.col("b") + 1)) - F.greatest("first", start(F.col("b")))
    return parts.groupBy((F.col("b") + 1).alias("bucket")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum(held).alias("n"))


def most_common(df: DataFrame, column: str, top: int) -> DataFrame:
    """(value, n) of the commonest values; ties go to the smaller value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)


def collect_garbage(spark: SparkSession, store: Store, catalog: Catalog, cutoff: int, offsets: dict[str, int]) -> int:
    """Delete files that no table shows any more and that left every table before cutoff (microseconds).

    Files that no commit ever named, left behind by failed statements, and old results of consumed streams go too.
    Clones share files, so a file stays while any table's newest snapshot has it, and while a registered backup names
    it. Payloads of changes after a stream's offset stay too; offsets has the least offset per table id. Dropped tables
    count as empty from when they were dropped. The number of deleted data files is returned. Each table's log is read
    from the version up to which everything that had left it was gone already.
    """
    dropped = {d["id"]: d["at"] for d in catalog.state()["dropped"]}
    ids = {e["id"] for _, e in catalog.objects("tables")} | set(dropped)
    backups = [path for path in catalog.state().get("backups", {}) if store.exists(path)]
    keep = {f["path"] for path in backups for t in store.read(path)["tables"].values() for f in t["snapshot"]["files"].values()}
    gone: dict[str, int] = {}
    left: dict[str, list[tuple[int, list[str]]]] = {}  # per table and version, what left it then
    for table_id in sorted(ids):
        table = VersionedTable(spark, store, table_id)
        start = table.at_version(settled(store, table_id))
        paths = {m: f["path"] for m, f in start.files.items()}
        removed: dict[str, int] = {}
        left[table_id] = []
        for entry in table.entries(start.version):
            paths |= {f["mp_id"]: f["path"] for f in entry["add"]}
            left[table_id].append((entry["version"], [*(paths[m] for m in entry["remove"]), *(c["path"] for c in entry["changes"] if not c["data"])]))
            removed |= {m: entry["commit_ts"] for m in entry["remove"]}
            for c in entry["changes"]:
                if table_id in offsets and c["seq_end"] > offsets[table_id]:
                    keep.add(c["path"])
                elif not c["data"]:
                    removed.setdefault(c["path"], entry["commit_ts"])
                    paths.setdefault(c["path"], c["path"])
        if table_id in dropped:
            removed = {m: dropped[table_id] for m in paths} | removed
        for m, path in paths.items():
            if m in removed and removed[m] < cutoff:
                gone[path] = removed[m]
            else:
                keep.add(path)
    doomed = [p for p in gone if p not in keep and store.exists(p)]
    for path in doomed:
        store.delete(path)
    for table_id, versions in left.items():
        through = settled(store, table_id)
        for version, paths_left in versions:
            if any(p not in gone or p in keep for p in paths_left):
                break
            through = version
        if through > settled(store, table_id):
            store.create(f"tables/{table_id}/_settled/{through:020d}.json", {})
    named = {p.rsplit("/", 1)[0].rsplit("/", 1)[1] for p in keep | set(gone)}
    for folder in [*(f"tables/{i}/{area}" for i in sorted(ids) for area in ("data", "cdc")), "results"]:
        for old in store.untouched(folder, cutoff // 1000 - GRACE_MILLIS):
            if old.rsplit("/", 1)[1] not in named:
                store.delete(old)
    return sum("/cdc/" not in path for path in doomed)


def settled(store: Store, table_id: str) -> int:
    """The version up to which all files that had left the table are deleted."""
    return store.latest(f"tables/{table_id}/_settled")


def backup(catalog: Catalog, tables: dict[str, tuple[VersionedTable, Snapshot]], since: dict[str, int] | None = None) -> dict[str, Any]:
    """A manifest of the tables' snapshots; with `since` (versions per table name) only tables that moved past them."""
    taken = {n: (t, s) for n, (t, s) in tables.items() if since is None or s.version > since.get(n, 0)}
    return {"created_at": now_micros(), "incremental": since is not None, "tables": {n: {"table_id": t.table_id, "snapshot": s.state()} for n, (t, s) in taken.items()}}


def missing_files(store: Store, manifest: dict[str, Any]) -> list[str]:
    """Files of a backup that are not there any more."""
    return [f["path"] for t in manifest["tables"].values() for f in t["snapshot"]["files"].values() if not store.exists(f["path"])]
