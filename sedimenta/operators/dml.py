"""Copy-on-write INSERT, UPDATE, DELETE and MERGE on versioned tables.

Only files that hold a matching row are rewritten; files whose zone maps rule a match out are not even read. Every
operation yields an Edit: files to add and remove, and change records for the table's streams. Nothing is visible
before the edit is committed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.errors import AnalysisError
from sedimenta.operators.common import staged
from sedimenta.plans.prune import prune
from sedimenta.plans.relations import condition, equal_columns
from sedimenta.sources.table import ROW_ID, Snapshot, VersionedTable, plain_statistic

FILE = "__file"


@dataclass
class Edit:
    """What one statement does to a table."""

    kind: str
    add: list[dict] = field(default_factory=list)
    remove: list[str] = field(default_factory=list)
    changes: list[dict] = field(default_factory=list)
    rows: int = 0


def _records(files: list[dict], action: str, update: bool, data: bool) -> list[dict]:
    return [{"path": f["path"], "rows": f["rows"], "action": action, "is_update": update, "data": data} for f in files]


def conform(df: DataFrame, snapshot: Snapshot, names: list[str] | None = None) -> DataFrame:
    """Columns of df put, by position, into the table's columns (or the named ones); the others get their default or null.

    A null in a NOT NULL column fails when the rows are written.
    """
    wanted = names or [c.name for c in snapshot.columns]
    if len(df.columns) != len(wanted):
        raise AnalysisError(f"{len(df.columns)} values for {len(wanted)} columns")
    known = {c.name: c for c in snapshot.columns}
    if unknown := [n for n in wanted if n not in known]:
        raise AnalysisError(f"unknown columns {unknown}")
    given = df.toDF(*[f"__{i}" for i in range(len(wanted))])
    out = []
    for column in snapshot.columns:
        if column.name in wanted:
            value = F.col(f"__{wanted.index(column.name)}").cast(column.spark_type)
        else:
            value = F.expr(column.default).cast(column.spark_type) if column.default is not None else F.lit(None).cast(column.spark_type)
        if not column.nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"null in column {column.name}, which is NOT NULL")).cast(column.spark_type))
        out.append(value.alias(column.name))
    return given.select(*out)


def insert(table: VersionedTable, snapshot: Snapshot, df: DataFrame, names: list[str] | None = None) -> Edit:
    files = table.write(conform(df, snapshot, names), snapshot.columns)
    return Edit("insert", files, [], _records(files, "INSERT", False, True), sum(f["rows"] for f in files))


def candidates(table: VersionedTable, snapshot: Snapshot, where: str | None) -> list[dict]:
    """Files that may hold rows for which the text of a WHERE clause is true."""
    files = list(snapshot.files.values())
    if where is None:
        return files
    floating = {c.stored for c in snapshot.columns if isinstance(c.spark_type, (T.DoubleType, T.FloatType))}
    return prune(files, condition(table.spark, where), {c.name: c.stored for c in snapshot.columns}, floating)


def touched(table: VersionedTable, snapshot: Snapshot, where: str | None, alias: str) -> list[dict]:
    """Files with at least one matching row."""
    files = candidates(table, snapshot, where)
    if where is None or not files:
        return files
    hits = table.scan(snapshot, files, file_names=True).alias(alias).where(where).select(FILE).distinct().collect()
    names = {r[0].rsplit("/", 2)[1] + "/" + r[0].rsplit("/", 1)[1].removesuffix(".parquet") for r in hits}
    return [f for f in files if f["mp_id"] in names]


def _true(where: str | None):
    """The predicate in two-valued form: null is not true."""
    return F.lit(True) if where is None else F.coalesce(F.expr(where), F.lit(False))


def update(table: VersionedTable, snapshot: Snapshot, assignments: dict[str, str], where: str | None, alias: str) -> Edit:
    """Rows for which where is true get the assigned expressions, which see the old values; row ids are kept."""
    known = {c.name: c for c in snapshot.columns}
    if unknown := [n for n in assignments if n not in known]:
        raise AnalysisError(f"unknown columns {unknown}")
    files = touched(table, snapshot, where, alias)
    if not files:
        return Edit("update")
    old = table.scan(snapshot, files, row_ids=True).alias(alias).withColumn("__hit", _true(where))
    new = old.select(
        *[F.when(F.col("__hit"), _checked(F.expr(assignments[c.name]).cast(c.spark_type), c)).otherwise(F.col(f"`{c.name}`")).alias(c.name) if c.name in assignments else F.col(f"`{c.name}`") for c in snapshot.columns],
        ROW_ID,
        "__hit",
    )
    added = table.write(new, snapshot.columns)
    before = table.write(old.where("__hit"), snapshot.columns, "cdc")
    after = table.write(new.where("__hit"), snapshot.columns, "cdc")
    return Edit("update", added, [f["mp_id"] for f in files], _records(before, "DELETE", True, False) + _records(after, "INSERT", True, False), sum(f["rows"] for f in before))


def _checked(value, column):
    return value if column.nullable else F.coalesce(value, F.raise_error(F.lit(f"null in column {column.name}, which is NOT NULL")).cast(column.spark_type))


def delete(table: VersionedTable, snapshot: Snapshot, where: str | None, alias: str) -> Edit:
    """Rows for which where is true go; rows for which it is null stay."""
    files = touched(table, snapshot, where, alias)
    if not files:
        return Edit("delete")
    rows = table.scan(snapshot, files, row_ids=True).alias(alias).withColumn("__hit", _true(where))
    kept = table.write(rows.where("NOT __hit"), snapshot.columns) if where is not None else []
    gone = table.write(rows.where("__hit"), snapshot.columns, "cdc")
    return Edit("delete", kept, [f["mp_id"] for f in files], _records(gone, "DELETE", False, False), sum(f["rows"] for f in gone))


def overwrite(table: VersionedTable, snapshot: Snapshot, df: DataFrame) -> Edit:
    """All rows replaced by those of df, which may carry ROW_ID."""
    files = table.write(df, snapshot.columns)
    return Edit("replace", files, list(snapshot.files), [], sum(f["rows"] for f in files))


@dataclass
class Clause:
    """A WHEN clause of MERGE: action is update, delete or insert; assignments None means all columns by name."""

    matched: bool
    action: str
    condition: str | None = None
    assignments: dict[str, str] | None = None


def mergeable(table: VersionedTable, snapshot: Snapshot, source: DataFrame, on: str, target_alias: str, source_alias: str) -> list[dict]:
    """Files whose zone maps let them hold a row that `on` matches with a source row, by the ranges of the source's keys."""
    known = {c.name: c for c in snapshot.columns}
    pairs = []
    for one, other in equal_columns(table.spark, on):
        for t, s in ((one, other), (other, one)):
            # Times are left out: how they print depends on the session.
            if t[0] == target_alias and s[0] == source_alias and t[-1] in known and s[-1] in source.columns and not isinstance(known[t[-1]].spark_type, (T.TimestampType, T.TimestampNTZType)):
                pairs.append((t[-1], s[-1]))
    files = list(snapshot.files.values())
    if not pairs or not files:
        return files
    bounds = source.agg(*[f(F.col(f"`{s}`").cast(known[t].spark_type)) for t, s in pairs for f in (F.min, F.max)]).first()
    test: tuple | None = None
    for i, (t, _) in enumerate(pairs):
        low, high = (plain_statistic(v) for v in bounds[2 * i : 2 * i + 2])
        if bounds[2 * i] is None:  # no source row has this key, so nothing matches
            return []
        if low is None or high is None:
            continue
        both = ("and", ("cmp", ">=", t, low), ("cmp", "<=", t, high))
        test = both if test is None else ("and", test, both)
    floating = {c.stored for c in snapshot.columns if isinstance(c.spark_type, (T.DoubleType, T.FloatType))}
    return prune(files, test, {c.name: c.stored for c in snapshot.columns}, floating)


def merge(table: VersionedTable, snapshot: Snapshot, source: DataFrame, on: str, clauses: list[Clause], target_alias: str, source_alias: str) -> Edit:
    """Rows of source are matched by `on`; the first clause whose condition is true applies.

    A target row that several source rows would update, or update and delete, is an error; several deletes are one.
    Unmatched source rows are inserted by the first clause that applies, repeated ones repeatedly.
    """
    columns = snapshot.columns
    source = staged(source, "merge-source")
    matched = [c for c in clauses if c.matched]
    adding = [c for c in clauses if not c.matched]
    target = table.scan(snapshot, mergeable(table, snapshot, source, on, target_alias, source_alias), row_ids=True, file_names=True)
    t, s = target.alias(target_alias), source.withColumn("__there", F.lit(True)).alias(source_alias)

    def first_of(group: list[Clause]):
        number = F.lit(None).cast("int")
        for i, c in reversed(list(enumerate(group))):
            number = F.when(_true(c.condition), i).otherwise(number)
        return number

    def assigned(c: Clause, column) -> str | None:
        if c.assignments is None:
            return f"`{source_alias}`.`{column.name}`" if column.name in source.columns else None
        return c.assignments.get(column.name)

    edit = Edit("merge")
    if matched:
        pairs = t.join(s, F.expr(on), "inner").withColumn("__clause", first_of(matched)).where("__clause is not null")
        new = []
        for column in columns:
            old = F.col(f"`{target_alias}`.`{column.name}`")
            value = old
            for i, c in enumerate(matched):
                text = assigned(c, column) if c.action == "update" else None
                if text is not None:
                    value = F.when(F.col("__clause") == i, _checked(F.expr(text).cast(column.spark_type), column)).otherwise(value)
            new.append(value.alias(column.name))
        deleting = F.col("__clause").isin([i for i, c in enumerate(matched) if c.action == "delete"])
        acted = staged(pairs.select(*new, F.col(f"`{target_alias}`.{ROW_ID}").alias(ROW_ID), F.col(f"`{target_alias}`.{FILE}").alias(FILE), deleting.alias("__delete")), "merge-acted")
        per_row = acted.groupBy(ROW_ID).agg(F.count(F.when(~F.col("__delete"), 1)).alias("u"), F.count(F.when(F.col("__delete"), 1)).alias("d"))
        if per_row.where("u > 1 OR (u > 0 AND d > 0)").limit(1).count():
            raise AnalysisError("several source rows match one target row")
        names = {r[0].rsplit("/", 2)[1] + "/" + r[0].rsplit("/", 1)[1].removesuffix(".parquet") for r in acted.select(FILE).distinct().collect()}
        files = [f for f in snapshot.files.values() if f["mp_id"] in names]
        if files:
            rows = table.scan(snapshot, files, row_ids=True)
            hit = acted.select(ROW_ID, "__delete").distinct()
            updated = acted.where("NOT __delete").select(*[f"`{c.name}`" for c in columns], ROW_ID)
            kept = rows.join(hit, ROW_ID, "left_anti").select(updated.columns)
            edit.add += table.write(kept.unionByName(updated), columns)
            edit.remove = [f["mp_id"] for f in files]
            before = rows.join(hit, ROW_ID).select(*updated.columns, "__delete")
            edit.changes += _records(table.write(before.where("__delete"), columns, "cdc"), "DELETE", False, False)
            edit.changes += _records(table.write(before.where("NOT __delete"), columns, "cdc"), "DELETE", True, False)
            edit.changes += _records(table.write(updated, columns, "cdc"), "INSERT", True, False)
    if adding:
        loose = s.join(t, F.expr(on), "left_anti").withColumn("__clause", first_of(adding)).where("__clause is not null")
        values = []
        for column in columns:
            value = F.expr(column.default).cast(column.spark_type) if column.default is not None else F.lit(None).cast(column.spark_type)
            for i, c in enumerate(adding):
                text = assigned(c, column)
                if text is not None:
                    value = F.when(F.col("__clause") == i, F.expr(text).cast(column.spark_type)).otherwise(value)
            values.append(_checked(value, column).alias(column.name))
        fresh = table.write(loose.select(*values), columns)
        edit.add += fresh
        edit.changes += _records(fresh, "INSERT", False, True)
    edit.rows = sum(c["rows"] for c in edit.changes if c["action"] == "INSERT") + sum(c["rows"] for c in edit.changes if c["action"] == "DELETE" and not c["is_update"])
    return edit
