"""Joins that Catalyst has no operator for, without comparing all rows of a key with each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.operators.common import staged
from sedimenta.operators.orphans import build_bloom, split_by_bloom

def asof_pairs(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], times: tuple[str, str], strict: bool = False) -> DataFrame:
    """(l, r): every left row with the latest right row of equal keys at or before its time (strict: before), null if there is none.

    Both sides are brought into one order of keys and time by a range exchange, which spreads a key over as many tasks
    as it fills, whatever its times are like. Each task carries the last right row forward; what it hands to the tasks
    behind it is one row, so the driver gets at most one per task. Of right rows at the same time the one with the
    greatest values counts. Null keys and times match nothing and are not exchanged.
    """
    spark = left.sparkSession
    l_kind, r_kind = T.StructType(left.schema.fields), T.StructType(right.schema.fields)
    whole_l, whole_r = F.struct(*[F.col(f"`{c}`") for c in left.columns]), F.struct(*[F.col(f"`{c}`") for c in right.columns])

    def side(df: DataFrame, n: int) -> DataFrame:
        named = [F.col(f"`{pair[n]}`").alias(f"__k{i}") for i, pair in enumerate(keys)]
        order = F.lit(1 if n == 0 else 2 if strict else 0)
        return df.select(*named, F.col(f"`{times[n]}`").alias("__t"), order.alias("__side"), (whole_l if n == 0 else F.lit(None).cast(l_kind)).alias("l"), (whole_r if n else F.lit(None).cast(r_kind)).alias("r"))

    names = [*[f"__k{i}" for i in range(len(keys))], "__t"]
    lost = F.greatest(*[F.col(n).isNull().cast("int") for n in names]) == 1
    lefts = side(left, 0)
    both = lefts.where(~lost).unionByName(side(right, 1).where(~lost))
    ordered = both.repartitionByRange(*names).sortWithinPartitions(*names, "__side", "r")
    key_names = names[:-1]
    side_right = 2 if strict else 0

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        n = table.num_rows
        fresh = np.zeros(n, bool)
        fresh[0] = True
        for k in key_names:
            column = table.column(k).chunk(0)
            fresh[1:] |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False), bool)
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(fresh, at, -1))
        of_right = table.column("__side").chunk(0).to_numpy() == side_right
        last = np.maximum.accumulate(np.where(of_right, at, -1))
        hit = last >= start
        l, r = table.column("l").chunk(0), table.column("r").chunk(0)
        mine = np.flatnonzero(~of_right)
        found = pa.array(np.where(hit, last, -1)[mine], pa.int64(), mask=~hit[mine])
        none_open = pa.array((start[mine] == 0) & ~hit[mine])
        keys_of = lambda i: [table.column(k).slice(i, 1).combine_chunks() for k in key_names]
        out = pa.schema([pa.field("l", l.type), pa.field("r", r.type), pa.field("part", pa.int32()), pa.field("open", pa.bool_()), *[pa.field(f"first{i}", table.column(k).type) for i, k in enumerate(key_names)], *[pa.field(f"last{i}", table.column(k).type) for i, k in enumerate(key_names)]])
        # What the tasks behind have to know: the first and last key, and the last right row of the last key.
        end = pa.array(last[-1:], pa.int64(), mask=~hit[-1:])
        columns = [pa.nulls(1, l.type), r.take(end), pa.array([part], pa.int32()), pa.nulls(1, pa.bool_()), *keys_of(0), *keys_of(n - 1)]
        yield pa.record_batch(columns, schema=out)
        for a in range(0, len(mine), 10_000):
            some = mine[a : a + 10_000]
            k = len(some)
            columns = [l.take(pa.array(some, pa.int64())), r.take(found.slice(a, k)), pa.array(np.full(k, part, np.int32)), none_open.slice(a, k), *[pa.nulls(k, out.field(j).type) for j in range(4, 4 + 2 * len(key_names))]]
            yield pa.record_batch(columns, schema=out)

    key_types = [both.schema[k].dataType for k in key_names]
    schema = T.StructType([T.StructField("l", l_kind), T.StructField("r", r_kind), T.StructField("part", T.IntegerType()), T.StructField("open", T.BooleanType()), *[T.StructField(f"first{i}", t) for i, t in enumerate(key_types)], *[T.StructField(f"last{i}", t) for i, t in enumerate(key_types)]])
    carried = staged(ordered.mapInArrow(carry, schema), "asof")
    ends = sorted(carried.where("open is null").collect(), key=lambda e: e["part"])
    handed, at_key, held = [], None, None
    for e in ends:
        first, last = tuple(e[f"first{i}"] for i in range(len(keys))), tuple(e[f"last{i}"] for i in range(len(keys)))
        if at_key == first and held is not None:
            handed.append((e["part"], held))
        if e["r"] is not None:
            held = e["r"]
        elif last != at_key:
            held = None
        at_key = last
    met = carried.where("not open").select("l", "r")
    more = spark.createDataFrame(handed, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("given", r_kind)]))
    opened = carried.where("open").select("l", "part").join(F.broadcast(more), "part", "left").select("l", F.col("given").alias("r"))
    return met.unionByName(opened).unionByName(lefts.where(lost).select("l", "r"))


def asof(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """Every left row with the values of the latest right row of its key at or before its time; see asof_pairs."""
    found = asof_pairs(left, right.select(key, time, *values), [(key, key)], (time, time))
    return found.select("l.*", *[F.col(f"r.`{v}`").alias(v) for v in values])


def band(left: DataFrame, right: DataFrame, keys: list[str], number: str, width: int) -> DataFrame:
    """Pairs of rows with equal keys whose whole numbers differ by at most width.

    Right rows are put into cells of that width and left rows look into their own cell and both neighbours, so the join
    is an equi-join. Columns other than the keys have to differ in name; the right number is dropped.
    """
    cell = F.floor(F.col(number) / width).cast("long")
    near = left.withColumn("__cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    there = right.withColumn("__cell", cell).withColumnRenamed(number, "__number")
    return near.join(there, [*keys, "__cell"]).where(F.abs(F.col(number) - F.col("__number")) <= width).drop("__cell", "__number")


def bloom_filtered(probe: DataFrame, build: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Inner or semi join in which a Bloom filter of the build side's keys drops rows of the probe side before the exchange.

    Worth it where few probe rows match; the filter is built and probed in blocks at any size. Null keys match nothing.
    """
    if how not in ("inner", "left_semi"):
        raise ValueError(f"rows without a match have to stay in a {how} join")
    asked = split_by_bloom(probe.where(F.col(key).isNotNull()), key, build_bloom(build, key))
    return asked.where("_maybe").drop("_maybe").join(build, key, how)


def salted(left: DataFrame, right: DataFrame, key: str, salts: int) -> DataFrame:
    """Inner join in which every key is spread over `salts` tasks: left rows by chance, right rows copied to each."""
    one = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    many = right.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return one.join(many, [key, "__salt"]).drop("__salt")
