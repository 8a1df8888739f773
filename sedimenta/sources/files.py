"""Plain files as tables: Parquet, ORC, CSV and JSON, and in-line values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sedimenta.errors import AnalysisError

FORMATS = ("parquet", "orc", "csv", "json")


def read_files(spark: SparkSession, path: str | list[str], kind: str, schema: T.StructType | None = None, **options: Any) -> DataFrame:
    """Files of a kind; text kinds want a schema, as inferring one reads everything twice."""
    if kind not in FORMATS:
        raise AnalysisError(f"unknown format {kind!r}")
    if kind in ("csv", "json") and schema is None:
        raise AnalysisError(f"{kind} files need a schema")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema is not None else reader).format(kind).load(path)


def write_files(df: DataFrame, path: str, kind: str, mode: str = "errorifexists", compression: str | None = None, rows_per_file: int = 0, partition_by: list[str] | None = None, **options: Any) -> None:
    if kind not in FORMATS:
        raise AnalysisError(f"unknown format {kind!r}")
    writer = df.write.mode(mode).options(**options).option("maxRecordsPerFile", rows_per_file)
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(kind).save(path)


def values(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    return spark.createDataFrame(rows, schema)
