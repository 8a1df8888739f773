"""Differences between consecutive full snapshots by Merkle trees over hash ranges of the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sedimenta.operators.common import blank, staged

FANOUT_BITS = 4  # children of a tree node: 16
LEAF_ROWS = 32  # rows aimed at in one leaf
MOST_LEVELS = 15  # 60 bits of the hash


def merkle_levels(rows_in_largest_snapshot: int) -> int:
    """Tree depth so that the largest snapshot has about LEAF_ROWS rows in a leaf."""
    levels = 1
    while levels < MOST_LEVELS and (1 << FANOUT_BITS * levels) * LEAF_ROWS < rows_in_largest_snapshot:
        levels += 1
    return levels


def leaf_of(levels: int, *keys: str):
    """Hash range of a key: the top bits of its 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - FANOUT_BITS * levels)


def plain_parts(schema: T.StructType, columns: list[str]) -> list[Column]:
    """Columns in a form whose hashes tell everything apart.

    Spark's hashes step over nulls and over the bounds of arrays. So every column comes with a flag for null, arrays of
    plain values also with their length and, where they may hold nulls, with the places of these; other nested values
    are hashed as JSON texts with their nulls.
    """
    parts: list[Column] = []
    for name in columns:
        kind, column = schema[name].dataType, F.col(f"`{name}`")
        parts.append(column.isNull())
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.ArrayType, T.MapType, T.StructType)):
            parts += [F.size(column), column]
            if kind.containsNull:
                parts.append(F.transform(column, lambda x: x.isNull()))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            parts.append(F.to_json(F.struct(column), {"ignoreNullFields": "false"}))
        else:
            parts.append(column)
    return parts


def digests(schema: T.StructType, columns: list[str]) -> list[Column]:
    """128 bits of digest of a row as two numbers, a and b, that can be added up in any order."""
    parts = plain_parts(schema, columns)
    return [F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("second"), *parts).alias("b")]


def _sum64(column):
    """Sum modulo 2**64 without overflow errors: halves are added apart."""
    low, high = F.sum(column.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(column, 32))
    return F.struct(low.alias("low"), high.alias("high"))


def diff_snapshots(rows: DataFrame, pairs: DataFrame, series: str, snapshot: str, key: str, payload: list[str]) -> DataFrame:
    """(series, snapshot, key, change_kind) for every consecutive pair (series, previous, snapshot).

    rows has one row per (snapshot, key). Leaf digests are aggregated once per snapshot and rolled up to the root.
    From the root down only nodes whose digests differ between the two snapshots of a pair are followed; rows are
    compared only in leaves that differ. Snapshot names have to be unique over all series. Null payload values are
    values like any other; an empty snapshot is a tree without nodes, so all keys of its neighbour differ.
    """
    largest = rows.groupBy(snapshot).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    levels = merkle_levels(largest)
    # Written once: the tree, and then the rows of differing leaves, are both read from it.
    hashed = staged(rows.select(snapshot, key, leaf_of(levels, key).alias("node"), *digests(rows.schema, [key, *payload])), "merkle")
    tree = {levels: staged(hashed.groupBy(snapshot, "node").agg(_sum64(F.col("a")).alias("da"), _sum64(F.col("b")).alias("db"), F.count(F.lit(1)).alias("n")), "leaves")}
    for level in range(levels - 1, -1, -1):
        below = tree[level + 1]
        add = lambda c: F.struct(F.sum(f"{c}.low").alias("low"), F.sum(f"{c}.high").alias("high")).alias(c)
        tree[level] = below.withColumn("node", F.shiftrightunsigned("node", FANOUT_BITS) if level else F.lit(0).cast("long")).groupBy(snapshot, "node").agg(add("da"), add("db"), F.sum("n").alias("n"))

    # (previous, snapshot, node) still to be followed; the root of every pair first.
    open_nodes = pairs.select(series, "previous", snapshot, F.lit(0).cast("long").alias("node"))
    for level in range(levels + 1):
        now = tree[level].select(F.col(snapshot), "node", F.struct("da", "db", "n").alias("now"))
        old = tree[level].select(F.col(snapshot).alias("previous"), "node", F.struct("da", "db", "n").alias("old"))
        if level:
            children = F.explode(F.sequence(F.col("node") * (1 << FANOUT_BITS), F.col("node") * (1 << FANOUT_BITS) + (1 << FANOUT_BITS) - 1))
            open_nodes = open_nodes.select(series, "previous", snapshot, children.alias("node"))
        open_nodes = open_nodes.join(now, [snapshot, "node"], "left").join(old, ["previous", "node"], "left").where(~F.col("now").eqNullSafe(F.col("old"))).select(series, "previous", snapshot, "node")

    open_leaves = staged(open_nodes, "differing")
    side = lambda name, mark: hashed.select(F.col(snapshot).alias(name), "node", key, F.struct("a", "b").alias(mark))
    after = open_leaves.join(side(snapshot, "now"), [snapshot, "node"]).select(series, snapshot, key, F.lit(True).alias("later"), F.col("now").alias("d"))
    before = open_leaves.join(side("previous", "old"), ["previous", "node"]).select(series, snapshot, key, F.lit(False).alias("later"), F.col("old").alias("d"))
    both = after.unionByName(before).groupBy(series, snapshot, key).agg(F.max(F.when(F.col("later"), F.col("d"))).alias("now"), F.max(F.when(~F.col("later"), F.col("d"))).alias("old"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("old"), "changed")
    return both.withColumn("change_kind", kind).where("change_kind is not null").select(series, snapshot, key, "change_kind")


def consecutive(headers: DataFrame, series: str, order: str, snapshot: str) -> DataFrame:
    """(series, previous, snapshot) of a list of snapshots, skew-safe.

    Snapshots of one series are ordered inside monthly slices; the first of a slice follows the last of the nearest
    earlier slice. No task sorts a whole series, only one row per slice of it.
    """
    sliced = headers.withColumn("slice", F.date_trunc("month", order))
    within = Window.partitionBy(series, "slice").orderBy(order, snapshot)
    near = sliced.withColumn("previous", F.lag(snapshot).over(within))
    ends = sliced.groupBy(series, "slice").agg(F.max_by(snapshot, F.struct(order, snapshot)).alias("last"))
    carried = ends.withColumn("carried", F.lag("last").over(Window.partitionBy(series).orderBy("slice"))).select(series, "slice", "carried")
    linked = near.join(carried, near[series].eqNullSafe(carried[series]) & near["slice"].eqNullSafe(carried["slice"])).select(near[series], F.coalesce("previous", "carried").alias("previous"), snapshot)
    return linked.where("previous is not null")


def manifest_changes(manifests: DataFrame) -> DataFrame:
    """(db_id, backup_id, table_id, change_kind) between consecutive full manifests of each database.

    Current, full manifests with non-null tables take part; one with an empty list is a snapshot without tables. Names
    are compared without case and outer blanks, owners as they are and mp_ids as sets; a table listed twice is one
    entry with all its mp_ids and the smallest of its names and owners. Null ids in mp_ids and entries without a
    table_id are ignored.
    """
    newest = F.max(F.struct("loaded_at", "db_id", "created_at", "incremental_from", "tables")).alias("r")
    current = manifests.where("backup_id is not null").groupBy("backup_id").agg(newest).select("backup_id", "r.db_id", "r.created_at", "r.incremental_from", "r.tables")
    full = staged(current.where(blank(F.col("incremental_from")) & F.col("tables").isNotNull()).select("db_id", "backup_id", "created_at", "tables"), "manifests")
    entry = full.select("backup_id", F.explode("tables").alias("t")).where("t.table_id is not null")
    ids = entry.select("backup_id", F.col("t.table_id").alias("table_id"), F.lower(F.trim("t.name")).alias("name"), F.col("t.owner").alias("owner"), F.array_compact(F.coalesce("t.mp_ids", F.array().cast("array<bigint>"))).alias("mp_ids"))
    rows = ids.groupBy("backup_id", "table_id").agg(F.min("name").alias("name"), F.min("owner").alias("owner"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("mp_ids")))).alias("mp_ids"))
    pairs = consecutive(full.select("db_id", "created_at", "backup_id"), "db_id", "created_at", "backup_id")
    return diff_snapshots(rows, pairs, "db_id", "backup_id", "table_id", ["name", "owner", "mp_ids"])
