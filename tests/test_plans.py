import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta import dynamic
from sedimenta.cache import ResultCache, cacheable, normalized
from sedimenta.errors import AnalysisError
from sedimenta.frontend import Reader, like, quote_metadata, split_commas, split_script, travels
from sedimenta.functions import sqlfunctions
from sedimenta.plans import advisor
from sedimenta.plans.prune import may_match, prune
from sedimenta.plans.relations import condition, filters_by_relation, relations
from sedimenta.types import parse_type


def test_scripts_and_tokens():
    assert split_script("a; b 'x;y' -- c;d\n; /* e; */ ;f \";\"") == ["a", "b 'x;y' -- c;d", 'f ";"']
    assert split_commas("a, f(b, c), 'd,e'") == ["a", "f(b, c)", "'d,e'"] and split_commas(" ") == []
    assert quote_metadata("SELECT METADATA$ACTION, 'METADATA$X' FROM s") == "SELECT `METADATA$ACTION`, 'METADATA$X' FROM s"
    assert Reader("a.`b c`.d x").name() == ("a", "b c", "d")
    assert [(t.name, t.micros, t.version) for t in travels("SELECT * FROM a.b AT(TIMESTAMP => now() - 5) x JOIN c VERSION AS OF 3 ON 1=1")] == [(("a", "b"), "now() - 5", None), (("c",), None, 3)]
    assert like("a%_c", "axxbc") and not like("a_c", "abbc") and not like("A%", "abc")


def test_types(spark):
    assert [parse_type(t).simpleString() for t in ("INT", "smallint", "FLOAT", "VARCHAR(20)", "DECIMAL(10, 2)", "NUMERIC", "DATETIME", "ARRAY<INT>", "double precision")] == ["bigint", "int", "double", "string", "decimal(10,2)", "decimal(38,9)", "timestamp_ntz", "array<int>", "double"]
    with pytest.raises(AnalysisError):
        parse_type("INTERVAL")


def test_relations(spark):
    names = lambda q: sorted(".".join(n) for n in relations(spark, q))
    assert names("SELECT * FROM a JOIN b.c ON 1=1 WHERE x IN (SELECT y FROM d) AND EXISTS (SELECT 1 FROM e WHERE z > (SELECT max(q) FROM f))") == ["a", "b.c", "d", "e", "f"]
    assert names("WITH t AS (SELECT * FROM t), u AS (SELECT * FROM t) SELECT * FROM u, v") == ["t", "v"]
    assert names("SELECT * FROM a UNION SELECT * FROM (SELECT * FROM g) x") == ["a", "g"]
    assert names("SELECT 1") == []
    assert filters_by_relation(spark, "SELECT * FROM a WHERE x > 1 AND y = 'q'") == {("a",): ("and", ("cmp", ">", "x", 1), ("cmp", "=", "y", "q"))}
    assert filters_by_relation(spark, "SELECT * FROM a x JOIN a y ON x.i = y.i WHERE x.j > 1") == {}
    assert filters_by_relation(spark, "SELECT * FROM a WHERE x > 1 UNION ALL SELECT * FROM a") == {}
    with pytest.raises(AnalysisError):
        relations(spark, "SELECT * FROM t WHERE (")


def test_pruning_cases(spark):
    files = [{"mp_id": str(i), "rows": 10, "stats": {"c1": {"min": 100 * i, "max": 100 * i + 100, "nulls": 0 if i else 10}, "c2": {"min": "a", "max": "f", "nulls": 3}, "c3": {"min": "2024-01-01", "max": "2024-02-01", "nulls": 0}}} for i in range(3)]
    kept = lambda where: [f["mp_id"] for f in prune(files, condition(spark, where), {"id": "c1", "name": "c2", "day": "c3", "x": "c9"}, {"c9"})]
    assert kept("id > 150") == ["1", "2"] and kept("150 > id") == ["1"] and kept("id = 200") == ["1", "2"] and kept("ID >= 301") == []
    assert kept("id BETWEEN 210 AND 220") == ["2"] and kept("id IN (105, 250)") == ["1", "2"] and kept("id IS NULL") == ["0"]
    assert kept("id > 250 OR name = 'zz'") == ["2"] and kept("id > 250 OR length(name) = 1") == ["0", "1", "2"] and kept("NOT id > 150") == ["0", "1", "2"]
    assert kept("name > 'x'") == [] and kept("name = 5") == ["0", "1", "2"] and kept("name = NULL") == [] and kept("day < DATE '2023-05-05'") == []
    assert kept("id > -1") == ["1", "2"] and kept("id <> 150") == ["0", "1", "2"] and kept("x > 5") == ["0", "1", "2"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=8), st.sampled_from(["=", "<", "<=", ">", ">="]), st.integers(-6, 6), st.sampled_from(["and", "or"]), st.integers(-6, 6))
def test_pruned_files_never_match(values, op, a, both, b):
    known = [v for v in values if v is not None]
    stats = {"c": {"min": min(known, default=None), "max": max(known, default=None), "nulls": values.count(None)}}
    predicate = (both, ("cmp", op, "c", a), ("in", "c", [b, None]))
    one = {"=": lambda v: v == a, "<": lambda v: v < a, "<=": lambda v: v <= a, ">": lambda v: v > a, ">=": lambda v: v >= a}[op]
    matches = any((one(v) and v == b) if both == "and" else (one(v) or v == b) for v in known)
    assert may_match(predicate, len(values), stats) or not matches


def test_advisor():
    plan = advisor.join_order({"a": 1e6, "b": 1e3, "c": 10}, [("a", "b"), ("b", "c")])
    assert plan.tree == (("c", "b"), "a") and plan.cost > 1e6
    with pytest.raises(ValueError):
        advisor.join_order({"a": 1, "b": 1}, [])
    assert advisor.distribution(1 << 40, 1 << 20) == "broadcast_right" and advisor.distribution(1 << 40, 1 << 40) == "shuffle" and advisor.distribution(1, 1, True) == "colocated"
    assert math.isclose(advisor.selectivity("<", 50, [0, 25, 50, 75, 100]), 0.5) and advisor.selectivity("=", 7, [], [(7, 0.25)]) == 0.25 and advisor.selectivity("~", 1, []) == 0.33


def test_cache():
    assert normalized(" SELECT  A\nFROM t WHERE x = 'A  b' ; ") == "select a from t where x = 'A  b'"
    assert not cacheable("SELECT now()") and cacheable("SELECT 'now()' FROM t") and not cacheable("select Rand ( )")
    assert ResultCache(0).get(("x",)) is None


def test_dynamic_rules(spark):
    assert dynamic.parse_lag("10 minutes") == 600 and dynamic.parse_lag("1 second") == 60
    with pytest.raises(AnalysisError):
        dynamic.parse_lag("soon")
    assert dynamic.due(60, 0, None, None, True)
    assert not dynamic.due(60, 70_000_200, 100, 100, True) and dynamic.due(60, 70_000_200, 100, 200, True) and not dynamic.due(60, 50_000_000, 100, 200, True)
    assert dynamic.due(60, 60_000_100, 100, None, False) and not dynamic.due(60, 60_000_099, 100, None, False)
    source = lambda q: dynamic.incremental_source(spark, q)
    assert source("SELECT id, upper(x) FROM t WHERE id > 0") == ("t",) and source("SELECT * FROM s.t") == ("s", "t")
    for query in ("SELECT COUNT (*) FROM t", "SELECT DISTINCT id FROM t", "SELECT a.id FROM a JOIN b ON a.id = b.id", "SELECT id FROM t LIMIT 1", "SELECT id FROM t UNION ALL SELECT id FROM t", "SELECT id, sum(id) OVER () FROM t", "SELECT id FROM t WHERE id IN (SELECT id FROM u)", "WITH t AS (SELECT 1 AS id) SELECT id FROM t"):
        assert source(query) is None, query


def test_function_text():
    made = sqlfunctions.parse_create("CREATE OR REPLACE FUNCTION s.f(x INT, VARCHAR(10), y DECIMAL(5, 2) DEFAULT 1.5) RETURNS DOUBLE PRECISION LANGUAGE SQL IMMUTABLE STRICT AS 'x + ''a'''")
    assert made.name == ("s", "f") and [a["name"] for a in made.args] == ["x", "arg2", "y"] and made.strict and made.body == "x + 'a'" and made.returns == "DOUBLE PRECISION"
    assert sqlfunctions.signature("F", made.args) == "f(INT,VARCHAR(10),DECIMAL(5, 2))"
    assert [(n, c) for _, _, n, c in sqlfunctions.calls("SELECT f(a, g(b)), s.h() FROM t WHERE 'x(' = y")] == [(("f",), 2), (("g",), 1), (("s", "h"), 0)]
