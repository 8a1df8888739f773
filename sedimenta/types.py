"""Column types of the DDL and their Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from sedimenta.errors import AnalysisError

# Type names of the DDL. INT is 64 bits wide and FLOAT is a double.
SIMPLE = {
    "INT": T.LongType(), "INTEGER": T.LongType(), "BIGINT": T.LongType(),
    "SMALLINT": T.IntegerType(), "TINYINT": T.IntegerType(),
    "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "REAL": T.DoubleType(), "DOUBLE PRECISION": T.DoubleType(),
    "VARCHAR": T.StringType(), "CHAR": T.StringType(), "TEXT": T.StringType(), "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(), "BOOL": T.BooleanType(),
    "DATE": T.DateType(), "DATETIME": T.TimestampNTZType(), "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "BINARY": T.BinaryType(), "VARBINARY": T.BinaryType(),
}


def parse_type(text: str) -> T.DataType:
    """A DDL type as a Spark type; ARRAY, MAP and STRUCT are read by Spark itself."""
    plain = re.sub(r"\s+", " ", text.strip().upper())
    found = re.fullmatch(r"(DECIMAL|NUMERIC|NUMBER)(?: ?\( ?(\d+) ?(?:, ?(\d+) ?)?\))?", plain)
    if found:
        return T.DecimalType(int(found[2] or 38), int(found[3] or (0 if found[2] else 9)))
    base = re.sub(r" ?\(.*\)$", "", plain)
    if base in SIMPLE:
        return SIMPLE[base]
    if re.match(r"(ARRAY|MAP|STRUCT)\b", plain):
        return T.DataType.fromDDL(text.strip())
    raise AnalysisError(f"unknown type {text!r}")


def spark_ddl(dtype: T.DataType) -> str:
    return dtype.simpleString()
