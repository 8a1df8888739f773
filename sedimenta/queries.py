"""The registered queries of the engine itself, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.errors import EngineError
from sedimenta.frontend import asof_join, rewrite_clauses
from sedimenta.operators import joins, maintenance
from sedimenta.operators.common import read, scratch_path
from sedimenta.plans.relations import relations
from sedimenta.session import Engine, Session
from sedimenta.sources.files import read_files, write_files
from sedimenta.sources.table import Column
from sedimenta.streaming import cdc, eventtime

Query = Callable[[SparkSession, str], DataFrame]


_STOCKED: dict[tuple[str, str], Session] = {}


def stocked(spark: SparkSession, d: str, tables: list[str]) -> Session:
    """A session on the warehouse of a folder, with the named tables of it; each is loaded once per application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STOCKED:
        _STOCKED[key] = Engine(spark, scratch_path(spark, "warehouse"), cache_entries=0).session()
    s = _STOCKED[key]
    for table in tables:
        full = s.full((table,))
        if s.engine.catalog.find("tables", full) is None:
            rows = read(spark, d, table)
            s.create_table(full, [Column(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(rows.schema)])
            # Files by ranges of the first column, so that zone maps tell them apart, and enough of them for all cores.
            parts = min(spark.sparkContext.defaultParallelism, rows.count() // 50_000 + 1)
            s.insert_frame(table, rows.repartitionByRange(parts, rows.columns[0]) if parts > 1 else rows)
    return s


def on_engine(text: str) -> Query:
    """A query text over versioned tables: bound, authorised, pruned and rewritten by a session, then run by Catalyst."""

    names: list[str] = []

    def run(spark: SparkSession, d: str) -> DataFrame:
        if not names:
            names.extend(sorted({n[-1] for n in relations_of(spark, text)}))
        return stocked(spark, d, names).sql(text)

    return run


def relations_of(spark: SparkSession, text: str) -> list[tuple[str, ...]]:
    """The tables that a text reads, in clauses that Spark's parser lacks too."""
    found: list[tuple[str, ...]] = []
    text = rewrite_clauses(text)
    while (join := asof_join(text)) is not None:
        found += [n for side in (join.left, join.right) for n in relations(spark, f"SELECT * FROM {side} AS t")]
        text = text[: join.start] + "__none" + text[join.end :]
    return [n for n in dict.fromkeys([*found, *relations(spark, text)]) if n != ("__none",)]


FLAGSHIP = """
SELECT n.n_name, CAST(COUNT(DISTINCT o.o_orderkey) AS BIGINT) AS orders,
       ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
JOIN lineitem l ON l.l_orderkey = o.o_orderkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
WHERE o.o_orderstatus = 'F' AND l.l_quantity > 10
GROUP BY n.n_name HAVING COUNT(*) > 5
ORDER BY revenue DESC, n.n_name LIMIT 10
"""

# Texts that Spark and the oracle read alike.
SHARED = {
    "flagship_revenue": FLAGSHIP,
    "scan_projection": "SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_totalprice FROM orders",
    "scan_duplicate_columns": "SELECT r_regionkey AS a, r_name, r_regionkey AS b FROM region",
    "filter_and_or": "SELECT o_orderkey FROM orders WHERE (o_totalprice > 100000 AND o_orderstatus = 'F') OR o_custkey < 50",
    "filter_like": "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1_' AND NOT c_mktsegment LIKE 'B%'",
    "filter_in": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)",
    "filter_between": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-12-31 00:00:00'",
    "filter_null": "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders WHERE nullif(o_orderstatus, 'F') IS NULL OR NOT (nullif(o_orderstatus, 'F') = 'O')",
    "distinct_status": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "count_star": "SELECT COUNT(*) AS n FROM lineitem",
    "count_col": "SELECT COUNT(nullif(l_returnflag, 'N')) AS n, COUNT(*) AS total FROM lineitem",
    "count_distinct": "SELECT COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS supps FROM lineitem",
    "sum_avg_min_max": "SELECT ROUND(SUM(o_totalprice), 2) AS s, ROUND(AVG(o_totalprice), 2) AS a, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders",
    "aggregate_of_nothing": "SELECT COUNT(*) AS n, MAX(o_orderkey) AS m FROM orders WHERE o_orderkey < 0",
    "group_by_having": "SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) > 500000",
    "group_by_multi": "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS price, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "group_by_all": "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer GROUP BY ALL",
    "rollup": "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)",
    "cube": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "agg_filter_clause": "SELECT l_returnflag, COUNT(*) FILTER (WHERE l_quantity > 25) AS big, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag",
    "agg_statistics": "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(CORR(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY l_returnflag",
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000",
    "join_right": "SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000",
    "join_full": "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey",
    "join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_3way": "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey",
    "join_semi": "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)",
    "join_anti": "SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 150000)",
    "join_theta": "SELECT a.s_suppkey, b.n_nationkey FROM supplier a JOIN nation b ON a.s_nationkey < b.n_nationkey",
    "order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 30",
    "sort_nulls": "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer ORDER BY seg NULLS LAST, c_custkey",
    "union_all": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect_distinct": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except_distinct": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "window_rank": "SELECT c_custkey, CAST(RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS d FROM customer",
    "window_lag_lead": "SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, LEAD(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders",
    "window_running_sum": "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running FROM orders",
    "window_frame_rows": "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS hi FROM orders",
    "window_frame_range": "SELECT s_suppkey, COUNT(*) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS n FROM supplier",
    "topk_per_group": "SELECT c_custkey, c_nationkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) t WHERE rn <= 3",
    "cte": "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE n > 12) SELECT c.c_name, t.n FROM top t JOIN customer c ON c.c_custkey = t.o_custkey",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)",
    "in_subquery": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "exists_correlated": "SELECT o.o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)",
    "correlated_scalar": "SELECT n.n_name, (SELECT COUNT(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS suppliers FROM nation n",
    "lateral_join": "SELECT n.n_name, t.c_custkey FROM nation n, LATERAL (SELECT c.c_custkey FROM customer c WHERE c.c_nationkey = n.n_nationkey ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 2) t",
    "derived_table_values": "SELECT v.a, n.n_name FROM (VALUES (1, 'x'), (2, NULL)) AS v(a, b) JOIN nation n ON n.n_nationkey = v.a",
    "fn_string": "SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_name) AS lo, CAST(length(c_name) AS BIGINT) AS len, substr(c_name, 3, 5) AS sub, trim('  x ') AS t, lpad(CAST(c_custkey AS VARCHAR(20)), 8, '0') AS pad, replace(c_name, '0', 'o') AS rep, split_part(c_name, '#', 2) AS part, concat_ws('-', c_name, c_mktsegment) AS cat, CAST(instr(c_name, '#') AS BIGINT) AS pos, c_name || '!' AS bang FROM customer",
    "fn_math": "SELECT o_orderkey, abs(-o_totalprice) AS a, ROUND(o_totalprice, 1) AS r, CAST(ceil(o_totalprice) AS BIGINT) AS c, CAST(floor(o_totalprice) AS BIGINT) AS f, ROUND(pow(o_totalprice / 100000, 2), 6) AS p, ROUND(sqrt(o_totalprice), 6) AS s, ROUND(ln(o_totalprice), 6) AS l, ROUND(exp(o_totalprice / 1000000), 6) AS e, o_orderkey % 7 AS m, greatest(o_orderkey, o_custkey) AS g, least(o_orderkey, o_custkey) AS le FROM orders",
    "fn_conditional": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'F'), 'done') AS st, nullif(o_custkey, 1) AS nk, CASE o_orderstatus WHEN 'O' THEN 1 ELSE 0 END AS open FROM orders",
    "fn_cast": "SELECT o_orderkey, CAST(o_custkey AS VARCHAR(20)) AS v, CAST(o_orderkey AS DOUBLE) AS d, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS day, try_cast(o_orderstatus AS INT) AS bad FROM orders",
}

# Texts that differ in function names or result types: (Spark, oracle).
PAIRS = {
    "join_range": (
        "SELECT o.o_orderkey, p.p_partkey FROM orders o JOIN part p ON p.p_retailprice BETWEEN o.o_totalprice / 100 - 0.02 AND o.o_totalprice / 100 + 0.02",
        "SELECT o.o_orderkey, p.p_partkey FROM orders o JOIN part p ON p.p_retailprice BETWEEN o.o_totalprice / 100 - 0.02 AND o.o_totalprice / 100 + 0.02",
    ),
    "fn_regexp": (
        "SELECT c_custkey, regexp_extract(c_name, '#0*([0-9]+)', 1) AS n, regexp_replace(c_name, '[0-9]+', '*') AS r, c_name RLIKE '5$' AS five FROM customer",
        "SELECT c_custkey, regexp_extract(c_name, '#0*([0-9]+)', 1) AS n, regexp_replace(c_name, '[0-9]+', '*', 'g') AS r, regexp_matches(c_name, '5$') AS five FROM customer",
    ),
    "fn_date": (
        "SELECT o_orderkey, CAST(date_trunc('MONTH', o_orderdate) AS TIMESTAMP_NTZ) AS m, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS mo, CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS d, CAST(datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS age, date_add(CAST(o_orderdate AS DATE), 30) AS later, add_months(CAST(o_orderdate AS DATE), 1) AS next, unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS us FROM orders",
        "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, year(o_orderdate) AS y, month(o_orderdate) AS mo, extract(DAY FROM o_orderdate) AS d, datediff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS age, CAST(o_orderdate AS DATE) + 30 AS later, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS next, epoch_us(o_orderdate) AS us FROM orders",
    ),
    "fn_array": (
        "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, CAST(element_at(embedding, 1) AS DOUBLE) AS first, array_contains(embedding, element_at(embedding, 3)) AS has, ROUND(CAST(aggregate(transform(embedding, x -> CAST(x AS DOUBLE)), CAST(0 AS DOUBLE), (a, x) -> a + x) AS DOUBLE), 4) AS total FROM embeddings",
        "SELECT vec_id, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS first, list_contains(embedding, embedding[3]) AS has, ROUND(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings",
    ),
    "fn_explode": (
        "SELECT vec_id, CAST(p AS BIGINT) AS pos, CAST(v AS DOUBLE) AS v FROM embeddings LATERAL VIEW posexplode(embedding) t AS p, v",
        "SELECT vec_id, generate_subscripts(e, 1) - 1 AS pos, CAST(unnest(e) AS DOUBLE) AS v FROM (SELECT vec_id, embedding AS e FROM embeddings)",
    ),
    "fn_map": (
        "SELECT n_nationkey, element_at(map_from_arrays(array('k', 'r'), array(n_nationkey, n_regionkey)), 'r') AS r, array_join(map_keys(map_from_arrays(array('k', 'r'), array(n_nationkey, n_regionkey))), ',') AS ks FROM nation",
        "SELECT n_nationkey, n_regionkey AS r, 'k,r' AS ks FROM nation",
    ),
    "fn_json": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, from_json(props, 'k BIGINT').k + 1 AS k1, to_json(named_struct('e', event_id)) AS j FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k1, '{\"e\":' || event_id || '}' AS j FROM events",
    ),
    "fn_hash": (
        "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s, lower(hex(c_mktsegment)) AS h FROM customer",
        "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, lower(hex(c_mktsegment)) AS h FROM customer",
    ),
    "agg_listagg": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_median": ("SELECT o_orderstatus, median(o_totalprice) AS m FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, median(o_totalprice) AS m FROM orders GROUP BY o_orderstatus"),
    "int_division": ("SELECT o_orderkey, o_orderkey div 7 AS q, ROUND(try_divide(o_custkey, o_orderkey % 3), 6) AS z FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, CASE WHEN o_orderkey % 3 <> 0 THEN ROUND(o_custkey / (o_orderkey % 3), 6) END AS z FROM orders"),
    "limit_by": (
        "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 2 BY o_custkey",
        "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= 2",
    ),
    "qualify": (
        "SELECT c_custkey, c_nationkey, c_acctbal AS bal FROM customer WHERE c_mktsegment <> 'BUILDING' QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2 AND bal > 0 ORDER BY c_custkey",
        "SELECT c_custkey, c_nationkey, c_acctbal AS bal FROM customer WHERE c_mktsegment <> 'BUILDING' QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2 AND c_acctbal > 0",
    ),
    "qualify_in_subquery": (
        "SELECT n.n_name, t.o_orderkey FROM nation n JOIN (SELECT o.o_orderkey, c.c_nationkey FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey QUALIFY rank() OVER (PARTITION BY c.c_nationkey ORDER BY o.o_totalprice DESC) = 1) t ON t.c_nationkey = n.n_nationkey",
        "SELECT n.n_name, t.o_orderkey FROM nation n JOIN (SELECT o.o_orderkey, c.c_nationkey FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey QUALIFY rank() OVER (PARTITION BY c.c_nationkey ORDER BY o.o_totalprice DESC) = 1) t ON t.c_nationkey = n.n_nationkey",
    ),
    "cross_apply": (
        "SELECT n.n_name, t.s_suppkey FROM nation n CROSS APPLY (SELECT s.s_suppkey FROM supplier s WHERE s.s_nationkey = n.n_nationkey ORDER BY s.s_acctbal DESC, s.s_suppkey LIMIT 3) t",
        "SELECT n.n_name, t.s_suppkey FROM nation n, LATERAL (SELECT s.s_suppkey FROM supplier s WHERE s.s_nationkey = n.n_nationkey ORDER BY s.s_acctbal DESC, s.s_suppkey LIMIT 3) t",
    ),
    "outer_apply": (
        "SELECT n.n_name, t.m FROM nation n OUTER APPLY (SELECT max(s.s_acctbal) AS m FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000 HAVING count(*) > 0) AS t",
        "SELECT n.n_name, t.m FROM nation n LEFT JOIN (SELECT s_nationkey, max(s_acctbal) AS m FROM supplier WHERE s_acctbal > 9000 GROUP BY s_nationkey) t ON t.s_nationkey = n.n_nationkey",
    ),
    "asof_join_sql": (
        "SELECT c.event_id AS event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = c.user_id AND v.ts <= c.ts",
        "SELECT c.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = c.user_id AND v.ts <= c.ts",
    ),
    "asof_join_match_condition": (
        "SELECT p.event_id AS event_id, v.event_id AS view_id, v.ts AS ts FROM events p ASOF JOIN events AS v MATCH_CONDITION (p.ts > v.ts) ON p.user_id = v.user_id AND p.event_type = v.event_type WHERE p.value > 0",
        "SELECT p.event_id, v.event_id AS view_id, v.ts FROM events p ASOF JOIN events v ON p.user_id = v.user_id AND p.event_type = v.event_type AND p.ts > v.ts WHERE p.value > 0",
    ),
    "approx_aggregates": (
        "SELECT l_returnflag, abs(approx_count_distinct(l_orderkey, 0.02) - count(DISTINCT l_orderkey)) < 0.1 * count(DISTINCT l_orderkey) AS near_count, abs(percentile_approx(l_quantity, 0.5, 10000) - percentile(l_quantity, 0.5)) <= 1 AS near_median FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, TRUE AS near_count, TRUE AS near_median FROM lineitem GROUP BY l_returnflag",
    ),
}


# Engine queries ----------------------------------------------------------------------------------------------------------

NATION = "CREATE TABLE nation (n_nationkey INT, n_name VARCHAR, n_regionkey INT)"
SUPPLIER = "CREATE TABLE supplier (s_suppkey INT, s_name VARCHAR, s_nationkey INT, s_acctbal DOUBLE)"
ORDERS = "CREATE TABLE orders (o_orderkey INT, o_custkey INT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR)"
CUSTOMER = "CREATE TABLE customer (c_custkey INT, c_name VARCHAR, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment VARCHAR)"
EVENTS = "CREATE TABLE events (event_id INT, ts TIMESTAMP, user_id INT, event_type VARCHAR, value DOUBLE, props VARCHAR)"


def warehouse(spark: SparkSession) -> Session:
    return Engine(spark, scratch_path(spark, "warehouse")).session()


def loaded(spark: SparkSession, d: str, *ddl: str) -> Session:
    """A new warehouse with the named tables, filled from the folder."""
    s = warehouse(spark)
    for text in ddl:
        s.sql(text)
        name = text.split()[2]
        s.insert_frame(name, read(spark, d, name))
    return s


def insert_values(spark, d):
    s = warehouse(spark)
    s.sql("CREATE TABLE t (id INT, name VARCHAR, amount DOUBLE, ok BOOLEAN)")
    s.sql("INSERT INTO t VALUES (1, 'a', -1.5, true), (2, NULL, 0.25, false); INSERT INTO t (name, id) VALUES ('c', 3)")
    return s.sql("SELECT * FROM t")


def insert_select(spark, d):
    s = loaded(spark, d, ORDERS)
    s.sql("CREATE TABLE f (k INT, p DOUBLE); INSERT INTO f SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
    return s.sql("SELECT * FROM f")


def update_cow(spark, d):
    s = loaded(spark, d, SUPPLIER)
    s.sql("UPDATE supplier SET s_name = 'changed' WHERE s_nationkey = 3")
    return s.sql("SELECT * FROM supplier")


def update_expr(spark, d):
    s = loaded(spark, d, ORDERS)
    s.sql("UPDATE orders SET o_totalprice = round(o_totalprice * 2, 2), o_orderpriority = NULL WHERE o_orderstatus IN ('O', 'P') AND o_custkey BETWEEN 10 AND 700")
    return s.sql("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")


def delete_cow(spark, d):
    s = loaded(spark, d, ORDERS)
    s.sql("DELETE FROM orders WHERE o_totalprice > 150000 OR o_orderstatus = 'P'")
    return s.sql("SELECT o_orderkey FROM orders")


def delete_all(spark, d):
    s = loaded(spark, d, NATION)
    s.sql("DELETE FROM nation")
    return s.sql("SELECT COUNT(*) AS n FROM nation")


def time_travel_before_update(spark, d):
    s = loaded(spark, d, SUPPLIER)
    then = s._table(("supplier",), "SELECT")[1].head().commit_ts
    s.sql("UPDATE supplier SET s_acctbal = 0; DELETE FROM supplier WHERE s_suppkey < 10")
    return s.sql(f"SELECT * FROM supplier AT(TIMESTAMP => {then})")


def time_travel_after_delete(spark, d):
    s = loaded(spark, d, NATION)
    table = s._table(("nation",), "SELECT")[1]
    s.sql("DELETE FROM nation")
    gone = table.head().version
    s.sql("INSERT INTO nation VALUES (1, 'late', 1)")
    return s.sql(f"SELECT (SELECT COUNT(*) FROM nation VERSION AS OF {gone}) AS after_delete, (SELECT COUNT(*) FROM nation VERSION AS OF {gone - 1}) AS before_delete, (SELECT COUNT(*) FROM nation) AS now_")


def clone_isolated(spark, d):
    s = loaded(spark, d, NATION)
    s.sql("CREATE TABLE copy_ CLONE nation; UPDATE copy_ SET n_name = 'x' WHERE n_regionkey = 1; DELETE FROM nation WHERE n_regionkey = 2")
    return s.sql("SELECT 'clone' AS side, * FROM copy_ UNION ALL SELECT 'source', * FROM nation")


def clone_at_timestamp(spark, d):
    s = loaded(spark, d, NATION)
    then = s._table(("nation",), "SELECT")[1].head().commit_ts
    s.sql(f"DELETE FROM nation; CREATE TABLE copy_ CLONE nation AT(TIMESTAMP => {then})")
    return s.sql("SELECT * FROM copy_")


def txn_commit(spark, d):
    s = loaded(spark, d, NATION)
    s.sql("BEGIN; INSERT INTO nation VALUES (100, 'new', 9); DELETE FROM nation WHERE n_regionkey = 0; COMMIT")
    return s.sql("SELECT * FROM nation")


def txn_rollback(spark, d):
    s = loaded(spark, d, NATION)
    s.sql("BEGIN; DELETE FROM nation; INSERT INTO nation VALUES (100, 'new', 9); ROLLBACK")
    return s.sql("SELECT * FROM nation")


def txn_own_reads(spark, d):
    s = loaded(spark, d, NATION)
    other = s.engine.session()
    s.sql("BEGIN; UPDATE nation SET n_name = 'mine' WHERE n_regionkey = 0; DELETE FROM nation WHERE n_regionkey = 1")
    mine = s.sql("SELECT COUNT(*) AS n, COUNT(CASE WHEN n_name = 'mine' THEN 1 END) AS m FROM nation").first()
    theirs = other.sql("SELECT COUNT(*) AS n, COUNT(CASE WHEN n_name = 'mine' THEN 1 END) AS m FROM nation").first()
    return spark.createDataFrame([("mine", *mine), ("theirs", *theirs)], "side string, n long, m long")


def _stream(spark, d, *statements):
    s = loaded(spark, d, NATION)
    s.sql("CREATE STREAM s ON TABLE nation")
    for text in statements:
        s.sql(text)
    return s


CHANGES = "SELECT n_nationkey, n_name, METADATA$ACTION AS action, METADATA$ISUPDATE AS is_update FROM s"


def stream_insert(spark, d):
    return _stream(spark, d, "INSERT INTO nation SELECT n_nationkey + 100, n_name, n_regionkey FROM nation").sql(CHANGES)


def stream_update_pairs(spark, d):
    return _stream(spark, d, "UPDATE nation SET n_name = upper(n_name) || '!' WHERE n_regionkey = 1").sql(CHANGES)


def stream_delete(spark, d):
    return _stream(spark, d, "DELETE FROM nation WHERE n_regionkey = 3").sql(CHANGES)


def stream_consume_then_empty(spark, d):
    s = _stream(spark, d, "DELETE FROM nation WHERE n_regionkey = 3")
    first = s.sql("SELECT COUNT(*) AS n FROM s").first()[0]
    return spark.createDataFrame([(1, first), (2, s.sql("SELECT COUNT(*) AS n FROM s").first()[0])], "read int, n long")


def stream_preview_repeat(spark, d):
    s = _stream(spark, d, "DELETE FROM nation WHERE n_regionkey = 3")
    counts = [s.sql("SELECT COUNT(*) AS n FROM s WITH (COMMIT = FALSE)").first()[0] for _ in range(2)]
    return spark.createDataFrame(list(enumerate(counts, 1)), "read int, n long")


def stream_filtered_commits_all(spark, d):
    s = _stream(spark, d, "UPDATE nation SET n_regionkey = 9")
    s.sql("SELECT n_name FROM s WHERE n_nationkey = 2 LIMIT 1")
    return s.sql("SELECT COUNT(*) AS n FROM s")


def stream_has_data(spark, d):
    s = _stream(spark, d)
    seen = []
    for step in ("SELECT 1", "DELETE FROM nation WHERE n_nationkey = 1", "SELECT * FROM s WITH (COMMIT = FALSE)", "SELECT * FROM s"):
        s.sql(step)
        seen.append(s.sql("SELECT SYSTEM$STREAM_HAS_DATA('s')").first()[0])
    return spark.createDataFrame(list(enumerate(seen)), "step int, has string")


def stream_structured(spark, d):
    """A change feed read by Structured Streaming, exactly once per payload file."""
    s = loaded(spark, d, EVENTS)
    table = s._table(("events",), "SELECT")[1]
    out = scratch_path(spark, "stream-out")
    for _ in range(2):
        source = spark.readStream.schema(table.head().stored_schema()).option("recursiveFileLookup", "true").parquet(s.engine.store.uri(f"{table.folder}/data"))
        eventtime.run_available(source, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), f"{out}-state")
        s.sql("INSERT INTO events SELECT event_id + 1000000, ts, user_id, event_type, value, props FROM events WHERE event_type = 'click'")
    named = {c.stored: c.name for c in table.head().columns}
    return spark.read.parquet(out).withColumnsRenamed(named).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def dt_full_refresh(spark, d):
    s = loaded(spark, d, ORDERS)
    s.sql("CREATE DYNAMIC TABLE dt TARGET_LAG = '5 minutes' REFRESH_MODE = FULL AS SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
    s.sql("DELETE FROM orders WHERE o_custkey < 100; ALTER DYNAMIC TABLE dt REFRESH")
    return s.sql("SELECT * FROM dt")


def _incremental(spark, d, *statements):
    s = loaded(spark, d, ORDERS)
    s.sql("CREATE DYNAMIC TABLE dt TARGET_LAG = '5 minutes' REFRESH_MODE = INCREMENTAL AS SELECT o_orderkey AS k, o_totalprice / 2 AS half FROM orders WHERE o_orderstatus <> 'F'")
    for text in statements:
        s.sql(text + "; ALTER DYNAMIC TABLE dt REFRESH")
    return s.sql("SELECT * FROM dt")


def dt_incremental_append(spark, d):
    return _incremental(spark, d, "INSERT INTO orders SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_custkey < 300")


def dt_incremental_delete(spark, d):
    return _incremental(spark, d, "DELETE FROM orders WHERE o_custkey < 300", "UPDATE orders SET o_orderstatus = 'O' WHERE o_custkey = 301")


def dt_auto_join(spark, d):
    s = loaded(spark, d, ORDERS, CUSTOMER)
    s.sql("CREATE DYNAMIC TABLE dt TARGET_LAG = '5 minutes' AS SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey")
    s.sql("DELETE FROM customer WHERE c_nationkey > 4; ALTER DYNAMIC TABLE dt REFRESH")
    return s.sql("SELECT * FROM dt")


def dt_auto_agg(spark, d):
    s = loaded(spark, d, CUSTOMER)
    s.sql("CREATE DYNAMIC TABLE dt TARGET_LAG = '5 minutes' AS SELECT COUNT (*) AS n, MAX(c_custkey) AS m FROM customer")
    s.sql("DELETE FROM customer WHERE c_custkey > 100; ALTER DYNAMIC TABLE dt REFRESH")
    return s.sql("SELECT * FROM dt")


def dt_empty_refresh(spark, d):
    s = loaded(spark, d, NATION)
    s.sql("CREATE DYNAMIC TABLE dt TARGET_LAG = '5 minutes' REFRESH_MODE = FULL AS SELECT * FROM nation WHERE n_nationkey >= 0; DELETE FROM nation; ALTER DYNAMIC TABLE dt REFRESH")
    return s.sql("SELECT COUNT(*) AS n FROM dt")


def merge_upsert(spark, d):
    s = loaded(spark, d, SUPPLIER)
    s.sql("MERGE INTO supplier t USING (SELECT s_suppkey + 50 AS k, s_name AS name, s_acctbal AS bal FROM supplier) s ON t.s_suppkey = s.k WHEN MATCHED THEN UPDATE SET s_name = s.name WHEN NOT MATCHED THEN INSERT (s_suppkey, s_name, s_acctbal) VALUES (s.k, s.name, s.bal)")
    return s.sql("SELECT s_suppkey, s_name, s_nationkey FROM supplier")


def merge_delete_clause(spark, d):
    s = loaded(spark, d, SUPPLIER, NATION)
    s.sql("MERGE INTO supplier USING nation ON supplier.s_nationkey = nation.n_nationkey WHEN MATCHED AND nation.n_regionkey = 1 THEN DELETE WHEN MATCHED AND nation.n_regionkey = 2 THEN UPDATE SET s_name = nation.n_name")
    return s.sql("SELECT s_suppkey, s_name FROM supplier")


def merge_insert_only(spark, d):
    s = loaded(spark, d, NATION)
    s.sql("MERGE INTO nation t USING (SELECT n_nationkey + 20 AS n_nationkey, 'new' AS n_name FROM nation) s ON t.n_nationkey = s.n_nationkey WHEN NOT MATCHED THEN INSERT ALL BY NAME")
    return s.sql("SELECT * FROM nation")


def alter_add_column(spark, d):
    s = loaded(spark, d, NATION)
    s.sql("ALTER TABLE nation ADD COLUMN note VARCHAR; INSERT INTO nation VALUES (99, 'z', 1, 'n')")
    return s.sql("SELECT * FROM nation")


def alter_drop_column(spark, d):
    s = loaded(spark, d, NATION)
    s.sql("ALTER TABLE nation DROP COLUMN n_name; ALTER TABLE nation ADD COLUMN n_name VARCHAR")
    return s.sql("SELECT * FROM nation")


def zone_map_prune(spark, d):
    s = warehouse(spark)
    s.sql(ORDERS)
    s.insert_frame("orders", read(spark, d, "orders").repartitionByRange(4, "o_orderkey"))
    return s.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900 OR o_orderkey = 5")


def zone_map_stats(spark, d):
    s = loaded(spark, d, SUPPLIER)
    table = s._table(("supplier",), "SELECT")[1]
    rows = spark.createDataFrame(maintenance.zone_maps(table, table.head()), "file string, rows long, name string, low string, high string, nulls long")
    return rows.where("name = 's_suppkey'").groupBy("name").agg(F.min(F.col("low").cast("long")).alias("low"), F.max(F.col("high").cast("long")).alias("high"), F.sum("rows").alias("n"), F.sum("nulls").alias("nulls"))


def gc_keeps_active(spark, d):
    s = loaded(spark, d, SUPPLIER)
    s.sql("UPDATE supplier SET s_name = 'u' WHERE s_nationkey < 5; CREATE TABLE c CLONE supplier; DELETE FROM supplier WHERE s_nationkey > 20; GC 0")
    return s.sql("SELECT 'c' AS t, s_suppkey, s_name FROM c UNION ALL SELECT 's', s_suppkey, s_name FROM supplier")


def compact_preserves_rows(spark, d):
    s = warehouse(spark)
    s.sql(ORDERS)
    s.insert_frame("orders", read(spark, d, "orders").repartition(12))
    s.sql("UPDATE orders SET o_orderstatus = 'U' WHERE o_custkey < 50; OPTIMIZE orders")
    return s.sql("SELECT o_orderkey, o_orderstatus FROM orders")


def backup_restore(spark, d):
    s = loaded(spark, d, NATION)
    s.sql("BACKUP TO 'b.json'; DELETE FROM nation WHERE n_regionkey < 4; DROP TABLE nation; RESTORE FROM 'b.json'")
    return s.sql("SELECT * FROM nation")


def show_tables(spark, d):
    s = warehouse(spark)
    s.sql("CREATE TABLE b (id INT); CREATE TABLE a (id INT); CREATE TABLE gone (id INT); DROP TABLE gone")
    return s.sql("SHOW TABLES").toDF("name")


def show_streams(spark, d):
    s = warehouse(spark)
    s.sql("CREATE TABLE a (id INT); CREATE STREAM s1 ON TABLE a; CREATE STREAM x ON TABLE a")
    return s.sql("SHOW STREAMS LIKE 's_'").select("name", "source_table")


def show_dynamic_tables(spark, d):
    s = warehouse(spark)
    s.sql("CREATE TABLE a (id INT); CREATE DYNAMIC TABLE d TARGET_LAG = '10 minutes' AS SELECT id FROM a; ALTER DYNAMIC TABLE d SUSPEND")
    return s.sql("SHOW DYNAMIC TABLES").select("name", "refresh_mode", "target_lag_s", "status", "scheduler")


def show_grants(spark, d):
    s = warehouse(spark)
    s.sql("CREATE FUNCTION f(x INT) RETURNS INT LANGUAGE SQL AS 'x'; CREATE ROLE r; GRANT USAGE ON FUNCTION f(INT) TO ROLE r")
    return s.sql("SHOW GRANTS TO ROLE r")


def rbac_denied_then_granted(spark, d):
    s = loaded(spark, d, NATION)
    s.sql("CREATE ROLE analyst; CREATE USER bob; GRANT ROLE analyst TO USER bob")
    bob = s.engine.session("bob", "analyst")
    seen = []
    for grant in ("SELECT 1", "GRANT USAGE ON DATABASE main TO ROLE analyst; GRANT USAGE ON SCHEMA public TO ROLE analyst", "GRANT SELECT ON TABLE nation TO ROLE analyst"):
        s.sql(grant)
        try:
            seen.append(f"{bob.sql('SELECT COUNT(*) FROM nation').first()[0]} rows")
        except Exception as e:
            seen.append(type(e).__name__)
    return spark.createDataFrame(list(enumerate(seen)), "step int, seen string")


def _functions(spark, d):
    s = loaded(spark, d, NATION)
    s.sql("CREATE FUNCTION add_one(x INT) RETURNS INT LANGUAGE SQL AS 'x + 1'; CREATE FUNCTION add_one(x INT, y INT) RETURNS INT LANGUAGE SQL AS 'x * 10 + y'; CREATE FUNCTION half(x INT) RETURNS INT LANGUAGE SQL AS 'x / 2'")
    return s


def sql_udf_scalar(spark, d):
    return _functions(spark, d).sql("SELECT n_nationkey, add_one(n_nationkey) AS a, half(n_nationkey) AS h FROM nation")


def sql_udf_overload(spark, d):
    return _functions(spark, d).sql("SELECT n_nationkey, add_one(n_nationkey, n_regionkey) AS a, ADD_ONE(add_one(n_nationkey)) AS b FROM nation")


def sql_udf_in_where(spark, d):
    return _functions(spark, d).sql("SELECT n_name FROM nation WHERE add_one(n_regionkey) = 3")


def histogram_equi_height(spark, d):
    """Four buckets of order keys by exact ranks."""
    return maintenance.histogram(read(spark, d, "orders"), "o_orderkey", 4, accuracy=1_000_000)


def mcv_topn(spark, d):
    return maintenance.most_common(read(spark, d, "lineitem"), "l_suppkey", 10)


def join_asof(spark, d):
    events = read(spark, d, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "ts")
    return joins.asof(clicks, views, "user_id", "ts", ["view_id"]).select("event_id", "view_id")


def join_band(spark, d):
    a = read(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("a"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    b = read(spark, d, "events").where("event_type = 'view'").select(F.col("event_id").alias("b"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return joins.band(a, b, ["user_id"], "t", 3_600_000_000).select("a", "b")


def join_explicit_strategies(spark, d):
    n, s = read(spark, d, "nation"), read(spark, d, "supplier")
    parts = [s.hint(h).join(n, s.s_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count(F.lit(1)).alias("n")).select(F.lit(h).alias("strategy"), "n_name", "n") for h in ("broadcast", "merge", "shuffle_hash")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def join_salted(spark, d):
    """Lineitems with their suppliers' names, suppliers copied so that no key stays in one task."""
    return joins.salted(read(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_quantity"), read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name"), "k", 8).groupBy("s_name").agg(F.count(F.lit(1)).alias("n"))


def join_bloom(spark, d):
    """Lineitems of urgent orders, most others dropped by a filter of the orders' keys before the join."""
    urgent = read(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), "o_custkey")
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity")
    return joins.bloom_filtered(lines, urgent, "k").groupBy("o_custkey").agg(F.sum("l_quantity").alias("qty"))


def formats_round_trip(spark, d):
    customers = read(spark, d, "customer")
    out = None
    for kind in ("parquet", "orc", "csv", "json"):
        path = scratch_path(spark, kind)
        write_files(customers, path, kind)
        back = read_files(spark, path, kind, customers.schema).select(F.lit(kind).alias("kind"), "c_custkey", "c_name", "c_acctbal")
        out = back if out is None else out.unionByName(back)
    return out


def ev_tumbling(spark, d):
    return eventtime.tumbling(read(spark, d, "events"), "ts", "1 day", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("v")]).drop("window_end")


def ev_sliding(spark, d):
    return eventtime.sliding(read(spark, d, "events"), "ts", "2 hours", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")])


def ev_session(spark, d):
    return eventtime.sessions(read(spark, d, "events"), "ts", "1 hour", ["user_id"], [F.count(F.lit(1)).alias("n")])


def ev_dedup_watermark(spark, d):
    return eventtime.first_per_key(read(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), "ts", ["user_id", "event_type"], "1 hour")


def _steps(spark: SparkSession, *seen) -> DataFrame:
    return spark.createDataFrame([(i, str(x)) for i, x in enumerate(seen)], "step int, seen string")


def _said(s: Session, text: str) -> str:
    """The first value of a statement's result, or the kind of error that it raises."""
    try:
        row = s.sql(text).first()
        return str(row[0]) if row is not None else "nothing"
    except EngineError as e:
        return type(e).__name__


def _names(s: Session, text: str) -> str:
    return ",".join(str(r[0]) for r in s.sql(text).collect())


def databases_and_schemas(spark, d):
    s = warehouse(spark)
    s.sql("CREATE DATABASE d2; CREATE SCHEMA d2.s2; CREATE TABLE d2.s2.t (id INT)")
    shown = _names(s, "SHOW DATABASES"), _said(s, "DROP DATABASE d2"), _said(s, "DROP SCHEMA d2.s2")
    s.sql("DROP TABLE d2.s2.t")
    return _steps(spark, *shown, _said(s, "DROP SCHEMA d2.s2"), _said(s, "DROP DATABASE d2"), _said(s, "DROP DATABASE d2"), _said(s, "DROP DATABASE IF EXISTS d2"), _names(s, "SHOW SCHEMAS"), _names(s, "SHOW DATABASES"))


def use_and_settings(spark, d):
    s = warehouse(spark)
    s.sql("CREATE SCHEMA other; CREATE TABLE other.t (id INT); USE SCHEMA other")
    seen = _names(s, "SHOW TABLES"), _said(s, "USE missing"), _said(s, "SET autocommit = 1"), _said(s, "SHOW STATUS"), _said(s, "SELECT VERSION()").split("-")[1], _said(s, "SELECT @@version").split("-")[1]
    return _steps(spark, *seen)


def prepared_statement(spark, d):
    s = loaded(spark, d, NATION)
    s.sql("PREPARE p FROM 'SELECT n_name FROM nation WHERE n_regionkey = ? AND n_nationkey > ?'")
    return s.sql("EXECUTE p USING 2, 5")


def stream_metadata(spark, d):
    """All six metadata columns of an update and an insert."""
    s = _stream(spark, d, "UPDATE nation SET n_name = 'x' WHERE n_regionkey = 1", "INSERT INTO nation VALUES (100, 'new', 9)")
    return s.sql(
        "SELECT METADATA$ACTION AS action, METADATA$ISUPDATE AS is_update, COUNT(*) AS n, COUNT(DISTINCT METADATA$ROW_ID) AS ids, COUNT(DISTINCT METADATA$TXN_ID) AS txns, COUNT(DISTINCT METADATA$COMMIT_TS) AS times, "
        "MAX(METADATA$SEQUENCE) - MIN(METADATA$SEQUENCE) + 1 AS span FROM s GROUP BY ALL"
    )


def stream_row_ids_pair_up(spark, d):
    """A row keeps its id over an update and until it is deleted."""
    s = _stream(spark, d, "UPDATE nation SET n_name = 'x' WHERE n_regionkey = 1", "DELETE FROM nation WHERE n_regionkey = 1")
    return s.sql("SELECT n_nationkey, COUNT(*) AS changes, COUNT(DISTINCT METADATA$ROW_ID) AS ids FROM s GROUP BY n_nationkey")


def stream_describe_and_drop(spark, d):
    s = _stream(spark, d, "DELETE FROM nation WHERE n_regionkey = 3")
    about = s.sql("DESCRIBE STREAM s").first()
    s.sql("SELECT * FROM s")
    moved = s.sql("DESCRIBE STREAM s").first()["committed_sequence"] - about["committed_sequence"]
    return _steps(spark, about["name"], about["source_table"], about["stale_after"], moved, _said(s, "DROP STREAM s"), _said(s, "SELECT * FROM s"), _said(s, "DROP STREAM s"), _said(s, "DROP STREAM IF EXISTS s"))


def stream_one_consumer_wins(spark, d):
    s = _stream(spark, d, "DELETE FROM nation WHERE n_regionkey = 3")
    offset = cdc.Offset(s.engine.store, s.engine.catalog.find("streams", ("main", "public", "s"))["id"])
    move, sequence = offset.get()
    seen = []
    for _ in range(2):
        try:
            offset.advance(move, sequence + 1)
            seen.append("moved")
        except EngineError as e:
            seen.append(type(e).__name__)
    return _steps(spark, *seen, offset.get()[1] - sequence)


def stream_lost_payload(spark, d):
    """A payload that is gone fails the read and leaves the offset where it was."""
    s = _stream(spark, d, "DELETE FROM nation WHERE n_regionkey = 3")
    entry = s.engine.catalog.find("streams", ("main", "public", "s"))
    offset = cdc.Offset(s.engine.store, entry["id"])
    before = offset.get()
    s.engine.store.delete(cdc.records(s.engine.table(entry["table_id"]), before[1])[0]["path"])
    return _steps(spark, _said(s, "SELECT * FROM s"), offset.get() == before)


def stream_stale(spark, d):
    """A forced collection outdates a stream; made again, it starts from now."""
    s = _stream(spark, d, "DELETE FROM nation WHERE n_regionkey = 3", "GC 0")
    kept = _said(s, "SELECT COUNT(*) FROM s WITH (COMMIT = FALSE)")
    s.sql("GC 0 FORCE")
    stale = _said(s, "SELECT COUNT(*) FROM s")
    s.sql("CREATE OR REPLACE STREAM s ON TABLE nation; DELETE FROM nation WHERE n_regionkey = 1")
    return _steps(spark, kept, stale, _said(s, "SELECT COUNT(*) FROM s"))


def names_are_checked(spark, d):
    s = warehouse(spark)
    s.sql("CREATE TABLE t (id INT); CREATE STREAM t ON TABLE t")
    return _steps(spark, _said(s, "SELECT * FROM t"), _said(s, "SELECT * FROM nothing"), _said(s, "CREATE TABLE t (id INT)"), _said(s, "CREATE TABLE IF NOT EXISTS t (id INT)"), _said(s, "CREATE TABLE missing.s.t (id INT)"), _said(s, "SELEC 1"), _said(s, "CREATE TABLE x (a INT, A INT)"))


def dt_schedule_and_drop(spark, d):
    s = loaded(spark, d, NATION)
    s.sql("CREATE DYNAMIC TABLE dt TARGET_LAG = '1 minute' REFRESH_MODE = FULL AS SELECT COUNT(*) AS n FROM nation")
    at = s.engine.catalog.find("dynamic", ("main", "public", "dt"))["last_refresh"]
    soon, late = s.engine.tick(at + 59_000_000), s.engine.tick(at + 3_600_000_000)
    s.sql("ALTER DYNAMIC TABLE dt SUSPEND")
    return _steps(spark, soon, late, s.engine.tick(at + 9_000_000_000_000), _said(s, "DROP DYNAMIC TABLE dt"), _said(s, "SELECT * FROM dt"), _said(s, "DROP DYNAMIC TABLE IF EXISTS dt"), _names(s, "SHOW TABLES"))


def drop_function(spark, d):
    s = _functions(spark, d)
    s.sql("DROP FUNCTION half(INT)")
    return _steps(spark, _said(s, "SELECT add_one(1)"), _said(s, "SELECT half(4)"), _said(s, "DROP FUNCTION half(INT)"), _said(s, "DROP FUNCTION IF EXISTS half(INT)"), _names(s, "SHOW FUNCTIONS"))


def rbac_streams_and_creation(spark, d):
    s = _stream(spark, d, "DELETE FROM nation WHERE n_regionkey = 3")
    s.sql("CREATE ROLE analyst; CREATE USER bob; GRANT ROLE analyst TO USER bob; GRANT USAGE ON DATABASE main TO ROLE analyst; GRANT USAGE ON SCHEMA public TO ROLE analyst; GRANT SELECT ON STREAM s TO ROLE analyst")
    bob = s.engine.session("bob", "analyst")
    seen = [_said(bob, "SELECT COUNT(*) FROM s WITH (COMMIT = FALSE)"), _said(bob, "CREATE TABLE mine (id INT)"), _said(bob, "CREATE ROLE other"), _said(bob, "USE ROLE accountadmin")]
    s.sql("GRANT SELECT ON TABLE nation TO ROLE analyst; GRANT CREATE TABLE ON SCHEMA public TO ROLE analyst")
    return _steps(spark, *seen, _said(bob, "SELECT COUNT(*) FROM s"), _said(bob, "CREATE TABLE mine (id INT)"), _said(bob, "DROP TABLE nation"), _names(s, "SHOW ROLES"))


def result_cache(spark, d):
    """Hits and misses: a repeat hits, also spelt otherwise; a write, a volatile function and a stream do not."""
    s = loaded(spark, d, NATION)
    cache, seen = s.engine.cache, []
    for text in ("SELECT COUNT(*) AS n FROM nation", "select  count(*) as n from nation;", "DELETE FROM nation WHERE n_nationkey = 0", "SELECT COUNT(*) AS n FROM nation", "SELECT rand() FROM nation", "SELECT rand() FROM nation", "SELECT 'A' FROM nation", "SELECT 'a' FROM nation"):
        s.sql(text)
        seen.append(f"{cache.hits} {cache.misses}")
    return _steps(spark, *seen)


def counters(spark, d):
    s = loaded(spark, d, NATION)
    s.sql("SELECT 1; SELECT 2; DELETE FROM nation WHERE n_nationkey = 1")
    return _steps(spark, *[line for line in s.engine.metrics().splitlines() if "DELETE" in line or "SELECT" in line])


def task_graph(spark, d):
    s = loaded(spark, d, NATION)
    s.sql("CREATE TABLE log (what VARCHAR, n INT); CREATE TASK a SCHEDULE = '5 minutes' AS INSERT INTO log SELECT 'a', COUNT(*) FROM nation; CREATE TASK b AFTER a WHEN 1 = 1 AS INSERT INTO log SELECT 'b', MAX(n) FROM log; ALTER TASK a RESUME; ALTER TASK b RESUME")
    for at in (10**9, 10**9 + 1, 2 * 10**9):
        s.engine.tick(at)
    return s.sql("SELECT what, n, COUNT(*) AS runs FROM log GROUP BY ALL")


def backup_survives_gc(spark, d):
    s = loaded(spark, d, NATION)
    s.sql("BACKUP TO 'b.json'; DELETE FROM nation; GC 0; RESTORE FROM 'b.json'")
    return s.sql("SELECT * FROM nation")


def backup_catalogue(spark, d):
    s = loaded(spark, d, NATION, SUPPLIER)
    s.sql("BACKUP TO 'full.json'; DELETE FROM nation WHERE n_regionkey = 1; BACKUP TO 'more.json' INCREMENTAL FROM 'full.json'")
    shown = [f"{r['path']} {r['incremental']} {r['tables']}" for r in s.sql("SHOW BACKUPS").collect()]
    return _steps(spark, *shown, _said(s, "DROP BACKUP 'full.json'"), _said(s, "DROP BACKUP 'full.json'"), _names(s, "SHOW BACKUPS"))


def gc_deletes_files(spark, d):
    """Files on disk, not rows: replaced ones go, shown ones stay."""
    s = loaded(spark, d, SUPPLIER)
    table = s._table(("supplier",), "SELECT")[1]
    s.sql("UPDATE supplier SET s_name = 'u' WHERE s_nationkey < 5; UPDATE supplier SET s_name = 'v' WHERE s_nationkey < 5")
    paths = {f["path"] for e in table.entries() for f in e["add"]}
    before = sum(s.engine.store.exists(p) for p in paths) == len(paths)
    s.sql("GC 0")
    return _steps(spark, before, {p for p in paths if s.engine.store.exists(p)} == {f["path"] for f in table.head().files.values()}, len(paths) > len(table.head().files))


def compact_merges_files(spark, d):
    s = warehouse(spark)
    s.sql(ORDERS)
    s.insert_frame("orders", read(spark, d, "orders").repartition(12))
    table = s._table(("orders",), "SELECT")[1]
    before = len(table.head().files)
    s.sql("OPTIMIZE orders")
    return spark.createDataFrame([(before, len(table.head().files), sum(f["rows"] for f in table.head().files.values()))], "files_before int, files_after int, n long")


def files_scanned(df: DataFrame) -> int:
    """Number of files that the scans of a plan list."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(len(leaves.apply(i).relation().location().inputFiles()) for i in range(leaves.size()) if leaves.apply(i).getClass().getSimpleName().startswith("LogicalRelation"))


def zone_maps_prune_files(spark, d):
    """Files that the scan reads, of all four, for a range, a value in no file and no condition."""
    s = Engine(spark, scratch_path(spark, "warehouse"), cache_entries=0).session()
    s.sql(ORDERS)
    s.insert_frame("orders", read(spark, d, "orders").repartitionByRange(4, "o_orderkey"))
    top = s.sql("SELECT MAX(o_orderkey) FROM orders").first()[0]
    asked = ("o_orderkey <= 3", f"o_orderkey > {top}", "o_orderkey IS NOT NULL", f"o_orderkey IN (1, {top})")
    return spark.createDataFrame([(i, files_scanned(s.sql(f"SELECT o_custkey FROM orders WHERE {w}"))) for i, w in enumerate(asked)], "asked int, files int")


def table_history(spark, d):
    s = loaded(spark, d, NATION)
    s.sql("UPDATE nation SET n_name = 'x' WHERE n_nationkey = 1; DELETE FROM nation WHERE n_nationkey = 2; ALTER TABLE nation ADD COLUMN note VARCHAR; TRUNCATE TABLE nation")
    return s.sql("DESCRIBE HISTORY nation").select("version", "kind")


def txn_conflict(spark, d):
    s = loaded(spark, d, NATION)
    other = s.engine.session()
    s.sql("BEGIN; DELETE FROM nation WHERE n_nationkey = 1")
    other.sql("UPDATE nation SET n_name = 'theirs' WHERE n_nationkey = 2")
    lost = _said(s, "COMMIT")
    s.sql("BEGIN; INSERT INTO nation VALUES (100, 'n', 1)")
    other.sql("INSERT INTO nation VALUES (101, 'o', 1)")
    s.sql("COMMIT")
    return _steps(spark, lost, _said(s, "SELECT COUNT(*) FROM nation WHERE n_nationkey >= 100"), _said(s, "SELECT COUNT(*) FROM nation WHERE n_nationkey = 1"))


def undrop_table(spark, d):
    s = loaded(spark, d, NATION)
    s.sql("DROP TABLE nation; UNDROP TABLE nation")
    return s.sql("SELECT * FROM nation")


def python_functions(spark, d):
    """A scalar, an aggregate and a table function in Python, in one query."""
    import pandas as pd

    class Spread:
        def eval(self, low: int, high: int):
            for i in range(low, high):
                yield i, i * i

    s = loaded(spark, d, NATION)
    s.register("shout", lambda v: v.str.upper() + "!", "string")

    def width(v: pd.Series) -> int:
        return int(v.max() - v.min())

    s.register("width", width, "long", "aggregate")
    s.register("squares", Spread, "i int, square int", "table")
    return s.sql("SELECT shout(n.n_name) AS name, w.w, q.square FROM (SELECT n_regionkey, width(n_nationkey) AS w FROM nation GROUP BY n_regionkey) w JOIN nation n ON n.n_regionkey = w.n_regionkey JOIN squares(0, 4) q ON q.i = w.n_regionkey")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parquet*")


def stream_tumbling(spark, d):
    """Windows over a stream with a watermark; the last complete result."""
    out = scratch_path(spark, "windows")
    counted = eventtime.tumbling(_event_stream(spark, d), "ts", "1 day", ["event_type"], [F.count(F.lit(1)).alias("n"), F.max("value").alias("top")], late="1 hour")
    eventtime.run_available(counted, lambda df, n: df.write.mode("overwrite").parquet(out), f"{out}-state", "complete")
    return spark.read.parquet(out).drop("window_end")


def stream_dedup(spark, d):
    """One event per user and type within the watermark of a stream, whichever comes first."""
    out = scratch_path(spark, "firsts")
    firsts = eventtime.first_per_key(_event_stream(spark, d).select("user_id", "event_type", "ts"), "ts", ["user_id", "event_type"], "3650 days")
    eventtime.run_available(firsts, lambda df, n: df.write.mode("append").parquet(f"{out}/batch={n}"), f"{out}-state")
    return spark.read.parquet(out).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


ENGINE = [
    insert_values, insert_select, update_cow, update_expr, delete_cow, delete_all, time_travel_before_update, time_travel_after_delete, clone_isolated, clone_at_timestamp,
    txn_commit, txn_rollback, txn_own_reads, stream_insert, stream_update_pairs, stream_delete, stream_consume_then_empty, stream_preview_repeat, stream_filtered_commits_all, stream_has_data, stream_structured,
    dt_full_refresh, dt_incremental_append, dt_incremental_delete, dt_auto_join, dt_auto_agg, dt_empty_refresh, merge_upsert, merge_delete_clause, merge_insert_only, alter_add_column, alter_drop_column,
    zone_map_prune, zone_map_stats, gc_keeps_active, compact_preserves_rows, backup_restore, show_tables, show_streams, show_dynamic_tables, show_grants, rbac_denied_then_granted,
    sql_udf_scalar, sql_udf_overload, sql_udf_in_where, histogram_equi_height, mcv_topn, join_asof, join_band, join_explicit_strategies, join_salted, join_bloom, formats_round_trip, ev_tumbling, ev_sliding, ev_session, ev_dedup_watermark,
    databases_and_schemas, use_and_settings, prepared_statement, stream_metadata, stream_row_ids_pair_up, stream_describe_and_drop, stream_one_consumer_wins, stream_lost_payload, stream_stale, names_are_checked, dt_schedule_and_drop,
    drop_function, rbac_streams_and_creation, result_cache, counters, task_graph, backup_survives_gc, backup_catalogue, gc_deletes_files, compact_merges_files, zone_maps_prune_files, table_history, txn_conflict, undrop_table, python_functions, stream_tumbling, stream_dedup,
]

QUERIES: dict[str, Query] = {n: on_engine(t) for n, t in SHARED.items()} | {n: on_engine(s) for n, (s, _) in PAIRS.items()} | {f.__name__: f for f in ENGINE}

_N = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"
_S = "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier"
SQL: dict[str, str] = SHARED | {n: o for n, (_, o) in PAIRS.items()} | {
    "insert_values": "SELECT * FROM (VALUES (1::BIGINT, 'a', -1.5::DOUBLE, true), (2, NULL, 0.25, false), (3, 'c', NULL, NULL)) t(id, name, amount, ok)",
    "insert_select": "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderstatus = 'F'",
    "update_cow": "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 'changed' ELSE s_name END AS s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier",
    "update_expr": "SELECT o_orderkey, CASE WHEN hit THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS o_totalprice, CASE WHEN hit THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM (SELECT *, o_orderstatus IN ('O', 'P') AND o_custkey BETWEEN 10 AND 700 AS hit FROM orders)",
    "delete_cow": "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 150000 OR o_orderstatus = 'P')",
    "delete_all": "SELECT 0::BIGINT AS n",
    "time_travel_before_update": _S,
    "time_travel_after_delete": "SELECT 0::BIGINT AS after_delete, COUNT(*) AS before_delete, 1::BIGINT AS now_ FROM nation",
    "clone_isolated": f"SELECT 'clone' AS side, n_nationkey, CASE WHEN n_regionkey = 1 THEN 'x' ELSE n_name END AS n_name, n_regionkey FROM ({_N}) UNION ALL SELECT 'source', * FROM ({_N}) WHERE n_regionkey <> 2",
    "clone_at_timestamp": _N,
    "txn_commit": f"{_N} WHERE n_regionkey <> 0 UNION ALL SELECT 100, 'new', 9",
    "txn_rollback": _N,
    "txn_own_reads": "SELECT 'mine' AS side, COUNT(*) FILTER (WHERE n_regionkey <> 1) AS n, COUNT(*) FILTER (WHERE n_regionkey = 0) AS m FROM nation UNION ALL SELECT 'theirs', COUNT(*), 0 FROM nation",
    "stream_insert": "SELECT CAST(n_nationkey + 100 AS BIGINT) AS n_nationkey, n_name, 'INSERT' AS action, false AS is_update FROM nation",
    "stream_update_pairs": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, 'DELETE' AS action, true AS is_update FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, upper(n_name) || '!', 'INSERT', true FROM nation WHERE n_regionkey = 1",
    "stream_delete": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, 'DELETE' AS action, false AS is_update FROM nation WHERE n_regionkey = 3",
    "stream_consume_then_empty": "SELECT 1 AS read, COUNT(*) AS n FROM nation WHERE n_regionkey = 3 UNION ALL SELECT 2, 0",
    "stream_preview_repeat": "SELECT r AS read, n FROM (SELECT COUNT(*) AS n FROM nation WHERE n_regionkey = 3), (VALUES (1), (2)) v(r)",
    "stream_filtered_commits_all": "SELECT 0::BIGINT AS n",
    "stream_has_data": "SELECT * FROM (VALUES (0, 'false'), (1, 'true'), (2, 'true'), (3, 'false')) t(step, has)",
    "stream_structured": "SELECT event_type, COUNT(*) * CASE WHEN event_type = 'click' THEN 2 ELSE 1 END AS n FROM events GROUP BY event_type",
    "dt_full_refresh": "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_custkey >= 100 GROUP BY o_orderstatus",
    "dt_incremental_append": "SELECT o_orderkey AS k, o_totalprice / 2 AS half FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey + 10000000, o_totalprice / 2 FROM orders WHERE o_orderstatus <> 'F' AND o_custkey < 300",
    "dt_incremental_delete": "SELECT o_orderkey AS k, o_totalprice / 2 AS half FROM orders WHERE o_custkey >= 300 AND (o_orderstatus <> 'F' OR o_custkey = 301)",
    "dt_auto_join": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_nationkey <= 4",
    "dt_auto_agg": "SELECT COUNT(*) AS n, MAX(c_custkey) AS m FROM customer WHERE c_custkey <= 100",
    "dt_empty_refresh": "SELECT 0::BIGINT AS n",
    "merge_upsert": "SELECT t.s_suppkey, coalesce(s.s_name, t.s_name) AS s_name, CAST(t.s_nationkey AS BIGINT) AS s_nationkey FROM supplier t LEFT JOIN supplier s ON s.s_suppkey + 50 = t.s_suppkey UNION ALL SELECT s_suppkey + 50, s_name, NULL FROM supplier WHERE s_suppkey + 50 NOT IN (SELECT s_suppkey FROM supplier)",
    "merge_delete_clause": "SELECT s_suppkey, CASE WHEN n_regionkey = 2 THEN n_name ELSE s_name END AS s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 1",
    "merge_insert_only": f"{_N} UNION ALL SELECT n_nationkey + 20, 'new', NULL FROM nation WHERE n_nationkey + 20 NOT IN (SELECT n_nationkey FROM nation)",
    "alter_add_column": f"SELECT *, CAST(NULL AS VARCHAR) AS note FROM ({_N}) UNION ALL SELECT 99, 'z', 1, 'n'",
    "alter_drop_column": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(NULL AS VARCHAR) AS n_name FROM nation",
    "zone_map_prune": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900 OR o_orderkey = 5",
    "zone_map_stats": "SELECT 's_suppkey' AS name, MIN(s_suppkey) AS low, MAX(s_suppkey) AS high, COUNT(*) AS n, 0::BIGINT AS nulls FROM supplier",
    "gc_keeps_active": "SELECT 'c' AS t, s_suppkey, CASE WHEN s_nationkey < 5 THEN 'u' ELSE s_name END AS s_name FROM supplier UNION ALL SELECT 's', s_suppkey, CASE WHEN s_nationkey < 5 THEN 'u' ELSE s_name END FROM supplier WHERE s_nationkey <= 20",
    "compact_preserves_rows": "SELECT o_orderkey, CASE WHEN o_custkey < 50 THEN 'U' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "backup_restore": _N,
    "show_tables": "SELECT * FROM (VALUES ('a'), ('b')) t(name)",
    "show_streams": "SELECT 's1' AS name, 'main.public.a' AS source_table",
    "show_dynamic_tables": "SELECT 'd' AS name, 'AUTO' AS refresh_mode, 600::BIGINT AS target_lag_s, 'Success' AS status, 'disabled' AS scheduler",
    "show_grants": "SELECT 'r' AS role, 'FUNCTION' AS object_type, 'main.public.f(INT)' AS object_name, 'USAGE' AS privilege, false AS grant_option",
    "rbac_denied_then_granted": "SELECT * FROM (VALUES (0, 'PermissionDenied'), (1, 'PermissionDenied'), (2, (SELECT COUNT(*) || ' rows' FROM nation))) t(step, seen)",
    "sql_udf_scalar": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_nationkey + 1 AS BIGINT) AS a, CAST(n_nationkey // 2 AS BIGINT) AS h FROM nation",
    "sql_udf_overload": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_nationkey * 10 + n_regionkey AS BIGINT) AS a, CAST(n_nationkey + 2 AS BIGINT) AS b FROM nation",
    "sql_udf_in_where": "SELECT n_name FROM nation WHERE n_regionkey + 1 = 3",
    "histogram_equi_height": "SELECT CAST(b AS INT) AS bucket, MIN(o_orderkey) AS low, MAX(o_orderkey) AS high, COUNT(*) AS n FROM (SELECT o_orderkey, ntile(4) OVER (ORDER BY o_orderkey) AS b FROM orders) GROUP BY b",
    "mcv_topn": "SELECT l_suppkey AS value, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, value LIMIT 10",
    "join_asof": "SELECT c.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = c.user_id AND v.ts <= c.ts",
    "join_band": "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000",
    "join_explicit_strategies": "SELECT strategy, n_name, COUNT(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey CROSS JOIN (VALUES ('broadcast'), ('merge'), ('shuffle_hash')) h(strategy) GROUP BY strategy, n_name",
    "join_salted": "SELECT s_name, COUNT(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name",
    "formats_round_trip": "SELECT kind, c_custkey, c_name, c_acctbal FROM customer CROSS JOIN (VALUES ('parquet'), ('orc'), ('csv'), ('json')) k(kind)",
    "ev_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS v FROM events GROUP BY 1, 2",
    "ev_sliding": "SELECT w AS window_start, w + INTERVAL 2 HOUR AS window_end, event_type, COUNT(*) AS n FROM (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP - INTERVAL 1 HOUR * o AS w FROM events, (VALUES (0), (1)) x(o)) GROUP BY ALL",
    "ev_session": "SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 1 HOUR AS session_end, COUNT(*) AS n FROM (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s",
    "ev_dedup_watermark": "SELECT user_id, event_type, MIN(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type",
    "databases_and_schemas": "SELECT * FROM (VALUES (0, 'd2,information_schema,main,mysql,performance_schema,sys'), (1, 'NotEmpty'), (2, 'NotEmpty'), (3, 'SCHEMA DROPPED'), (4, 'DATABASE DROPPED'), (5, 'DatabaseNotFound'), (6, 'DATABASE DROPPED'), (7, 'public'), (8, 'information_schema,main,mysql,performance_schema,sys')) t(step, seen)",
    "use_and_settings": "SELECT * FROM (VALUES (0, 't'), (1, 'DatabaseNotFound'), (2, 'OK'), (3, 'nothing'), (4, 'sedimenta'), (5, 'sedimenta')) t(step, seen)",
    "prepared_statement": "SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5",
    "stream_metadata": "SELECT action, is_update, n, n AS ids, 1::BIGINT AS txns, 1::BIGINT AS times, n AS span FROM (SELECT a AS action, TRUE AS is_update, COUNT(*) AS n FROM nation, (VALUES ('INSERT'), ('DELETE')) v(a) WHERE n_regionkey = 1 GROUP BY a UNION ALL SELECT 'INSERT', FALSE, 1)",
    "stream_row_ids_pair_up": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 3::BIGINT AS changes, 1::BIGINT AS ids FROM nation WHERE n_regionkey = 1",
    "stream_describe_and_drop": "SELECT * FROM (VALUES (0, 's'), (1, 'main.public.nation'), (2, 'None'), (3, (SELECT COUNT(*)::VARCHAR FROM nation WHERE n_regionkey = 3)), (4, 'STREAM DROPPED'), (5, 'TableNotFound'), (6, 'StreamNotFound'), (7, 'NO STREAM')) t(step, seen)",
    "stream_one_consumer_wins": "SELECT * FROM (VALUES (0, 'moved'), (1, 'StreamConcurrentConsume'), (2, '1')) t(step, seen)",
    "stream_lost_payload": "SELECT * FROM (VALUES (0, 'StreamPayloadMissing'), (1, 'True')) t(step, seen)",
    "names_are_checked": "SELECT * FROM (VALUES (0, 'AmbiguousRelation'), (1, 'TableNotFound'), (2, 'AlreadyExists'), (3, 'TABLE EXISTS'), (4, 'DatabaseNotFound'), (5, 'UnsupportedStatement'), (6, 'AnalysisError')) t(step, seen)",
    "dt_schedule_and_drop": "SELECT * FROM (VALUES (0, '[]'), (1, '[''main.public.dt'']'), (2, '[]'), (3, 'DYNAMIC TABLE DROPPED'), (4, 'TableNotFound'), (5, 'NO DYNAMIC TABLE'), (6, 'nation')) t(step, seen)",
    "drop_function": "SELECT * FROM (VALUES (0, '2'), (1, 'AnalysisError'), (2, 'FunctionNotFound'), (3, 'NO FUNCTION'), (4, 'add_one(INT),add_one(INT,INT)')) t(step, seen)",
    "rbac_streams_and_creation": "SELECT * FROM (VALUES (0, 'PermissionDenied'), (1, 'PermissionDenied'), (2, 'PermissionDenied'), (3, 'AnalysisError'), (4, (SELECT COUNT(*)::VARCHAR FROM nation WHERE n_regionkey = 3)), (5, 'TABLE CREATED'), (6, 'PermissionDenied'), (7, 'accountadmin,analyst,public')) t(step, seen)",
    "result_cache": "SELECT * FROM (VALUES (0, '0 1'), (1, '1 1'), (2, '1 1'), (3, '1 2'), (4, '1 2'), (5, '1 2'), (6, '1 3'), (7, '1 4')) t(step, seen)",
    "counters": "SELECT * FROM (VALUES (0, 'sedimenta_statements_total{kind=\"DELETE\"} 1'), (1, 'sedimenta_statements_total{kind=\"SELECT\"} 2')) t(step, seen)",
    "task_graph": "SELECT 'a' AS what, COUNT(*) AS n, 2::BIGINT AS runs FROM nation UNION ALL SELECT 'b', COUNT(*), 2 FROM nation",
    "backup_survives_gc": _N,
    "backup_catalogue": "SELECT * FROM (VALUES (0, 'full.json False 2'), (1, 'more.json True 1'), (2, 'BACKUP DROPPED'), (3, 'AnalysisError'), (4, 'more.json')) t(step, seen)",
    "gc_deletes_files": "SELECT * FROM (VALUES (0, 'True'), (1, 'True'), (2, 'True')) t(step, seen)",
    "compact_merges_files": "SELECT 12::INTEGER AS files_before, 1::INTEGER AS files_after, COUNT(*) AS n FROM orders",
    "zone_maps_prune_files": "SELECT * FROM (VALUES (0, 1), (1, 0), (2, 4), (3, 2)) t(asked, files)",
    "table_history": "SELECT * FROM (VALUES (1::BIGINT, 'create'), (2, 'insert'), (3, 'update'), (4, 'delete'), (5, 'alter'), (6, 'delete')) t(version, kind)",
    "txn_conflict": "SELECT * FROM (VALUES (0, 'TransactionConflict'), (1, '2'), (2, '1')) t(step, seen)",
    "undrop_table": _N,
    "python_functions": "SELECT upper(n_name) || '!' AS name, CAST(max(n_nationkey) OVER (PARTITION BY n_regionkey) - min(n_nationkey) OVER (PARTITION BY n_regionkey) AS BIGINT) AS w, CAST(n_regionkey * n_regionkey AS INTEGER) AS square FROM nation WHERE n_regionkey < 4",
    "stream_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, COUNT(*) AS n, MAX(value) AS top FROM events GROUP BY 1, 2",
    "stream_dedup": "SELECT user_id, event_type, 1::BIGINT AS n FROM events GROUP BY ALL",
    "join_bloom": "SELECT o_custkey, SUM(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY o_custkey",
    "stream_stale": "SELECT 0 AS step, CAST(COUNT(*) AS VARCHAR) AS seen FROM nation WHERE n_regionkey = 3 UNION ALL SELECT 1, 'StreamStale' UNION ALL SELECT 2, CAST(COUNT(*) AS VARCHAR) FROM nation WHERE n_regionkey = 1",
}
