"""Helpers shared by the operators: scratch space, current rows, skew-safe joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.sources.store import qualified

# A key is heavy when it alone would fill more than this share of an average shuffle partition, times HEAVY_FACTOR.
HEAVY_FACTOR = 4


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where none is configured, a temporary one in local mode only.

    On a cluster every executor would write to a disk of its own, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sedimenta-")
        atexit.register(shutil.rmtree, root, True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return qualified(spark, root).rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared scratch folder, removed when the driver ends."""
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone already
        pass


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write a DataFrame once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; its files go when the DataFrame is garbage."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def current_rows(df: DataFrame, key: str, columns: list[str], version: str = "loaded_at") -> DataFrame:
    """One row per non-null key: the one with the greatest version; ties go to the greatest remaining columns.

    Only the named columns are carried, so the scan stays narrow. Rows with a null key have no identity and are left out.
    """
    rest = [c for c in columns if c not in (key, version)]
    newest = F.max(F.struct(version, *rest)).alias("_row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(newest).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns if c != key])


def heavy_keys(df: DataFrame, key: str, partitions: int | None = None) -> list:
    """Keys that hold over HEAVY_FACTOR / partitions of all rows: at most partitions / HEAVY_FACTOR values, so the list is bounded."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    if not total:
        return []
    most = max(HEAVY_FACTOR * total / n, 100_000)
    return [r[0] for r in counts.where((F.col("_n") > most) & F.col(key).isNotNull()).limit(n).collect()]


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join to a side with unique keys; rows of heavy keys meet a broadcast of just those keys' rows.

    The broadcasts hold one row per heavy key, at most one per shuffle partition. Everything else is a shuffled join.
    Keys may be of any type that can be compared, structs too.
    """
    heavy = heavy_keys(left, key)
    if not heavy:
        return left.join(right, key, how)
    hot = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in heavy], T.StructType([left.schema[key]])))
    few = F.broadcast(right.join(hot, key, "left_semi"))
    return left.join(hot, key, "left_semi").join(few, key, how).unionByName(left.join(hot, key, "left_anti").join(right, key, how))


def blank(column: Column) -> Column:
    """True for null, empty and white-space strings."""
    return column.isNull() | (F.length(F.trim(F.regexp_replace(column, r"\s+", " "))) == 0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
