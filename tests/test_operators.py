import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.operators import changefeed, common, hierarchy, joins, maintenance, orphans, outliers, snapshots
from sedimenta.sources.store import FileExists, arrow_uri, open_uri, publish
from tests.conftest import rows

DAY = datetime.timedelta(1)
TS = datetime.datetime(2025, 1, 1)

# Snapshots ---------------------------------------------------------------------------------------------------------------

TABLES = "backup_id string, db_id long, created_at timestamp, tables array<struct<table_id long, schema_id long, name string, owner long, version long, mp_ids array<long>, mp_count int>>, incremental_from string, loaded_at timestamp, node long"


def table(i, name="t", owner=1, ids=(1, 2)):
    return (i, 0, name, owner, 1, None if ids is None else list(ids), 1)


def manifests(spark, data):
    return spark.createDataFrame(data, TABLES)


def test_manifest_changes(spark):
    data = [
        ("a", 1, TS, [table(1), table(2), table(3)], None, TS, 1),
        ("a", 1, TS, [table(1)], None, TS - DAY, 1),  # cut short, replaced
        ("b", 1, TS + DAY, [table(1, " T ", ids=(2, 1, 1, None)), table(2, owner=2), table(4), table(4, ids=(7,)), (None, 0, "n", 1, 1, [1], 1)], "  ", TS, 1),
        ("i", 1, TS + DAY / 2, [table(9)], "a", TS, 1),
        ("n", 1, TS + DAY / 3, None, None, TS, 1),
        ("c", 1, TS + 40 * DAY, [], None, TS, 1),
        ("d", 1, TS + 90 * DAY, [table(1, ids=None)], None, TS, 1),
        ("z", 2, TS, [table(1)], None, TS, 1),
        ("z", 2, TS, [table(1)], None, TS, 1),
        (None, 1, TS, [table(1)], None, TS, 1),
    ]
    got = rows(snapshots.manifest_changes(manifests(spark, data)))
    assert got == sorted([(1, "b", 2, "changed"), (1, "b", 3, "removed"), (1, "b", 4, "added"), (1, "c", 1, "removed"), (1, "c", 2, "removed"), (1, "c", 4, "removed"), (1, "d", 1, "added")])
    assert rows(snapshots.manifest_changes(manifests(spark, []))) == []


def test_merkle_diff_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "LEAF_ROWS", 2)
    rnd = random.Random(3)
    versions = {}
    state = {k: 0 for k in range(300)}
    for v in range(5):
        versions[f"s{v}"] = dict(state)
        for k in rnd.sample(range(350), 12):
            if k in state and rnd.random() < 0.4:
                del state[k]
            else:
                state[k] = state.get(k, -1) + 1
    data = spark.createDataFrame([(s, k, v) for s, c in versions.items() for k, v in c.items()], "snap string, k long, v int")
    pairs = spark.createDataFrame([(1, f"s{i}", f"s{i + 1}") for i in range(4)], "series int, previous string, snap string")
    got = rows(snapshots.diff_snapshots(data, pairs, "series", "snap", "k", ["v"]))
    want = []
    for i in range(4):
        a, b = versions[f"s{i}"], versions[f"s{i + 1}"]
        want += [(1, f"s{i + 1}", k, "added" if k not in a else "removed" if k not in b else "changed") for k in a.keys() | b.keys() if a.get(k) != b.get(k)]
    assert got == sorted(want) and snapshots.merkle_levels(300) == 2


def test_nulls_and_array_bounds_are_changes(spark):
    kind = "snap string, k long, a string, b string, xs array<int>, ys array<int>, zs array<array<int>>"
    same = [(1, "x", None, [1], [2], [[1], None]), (2, None, "x", [1, None], [], None)]
    old = [*same, (3, None, "x", [], [], None), (4, "p", "q", [1, 2], [3], None), (5, "p", "q", [1, None], [3], None), (6, "p", "q", None, [3], None), (7, "p", "q", [1], [3], [[1, 2], [3]]), (8, "", None, [None, 1], [], None)]
    new = [*same, (3, "x", None, [], [], None), (4, "p", "q", [1], [2, 3], None), (5, "p", "q", [1], [3], None), (6, "p", "q", [], [3], None), (7, "p", "q", [1], [3], [[1], [2, 3]]), (8, None, "", [1, None], [], None)]
    data = spark.createDataFrame([("s0", *r) for r in old] + [("s1", *r) for r in new], kind)
    pairs = spark.createDataFrame([(1, "s0", "s1")], "series int, previous string, snap string")
    got = rows(snapshots.diff_snapshots(data, pairs, "series", "snap", "k", ["a", "b", "xs", "ys", "zs"]))
    assert got == [(1, "s1", k, "changed") for k in range(3, 9)]


# Change feed -------------------------------------------------------------------------------------------------------------


def test_feed_in_any_order_and_batches(spark, tmp_path):
    rnd = random.Random(5)
    changes = [(f"k{rnd.randrange(40)}", s, rnd.random() < 0.6, rnd.randrange(9)) for s in range(400)]
    want = {}
    for k, s, alive, v in changes:
        want[k] = (s, alive, v)
    shuffled = changes + rnd.sample(changes, 80)
    rnd.shuffle(shuffled)
    t = changefeed.BucketedTable(spark, f"file://{tmp_path}/t", ["k"], "s", 7)
    schema = "k string, s long, alive boolean, c int"
    for i in range(0, len(shuffled), 130):
        t.apply(spark.createDataFrame(shuffled[i : i + 130], schema), "alive")
    assert rows(t.read().select("k", "s", "c")) == sorted((k, s, v) for k, (s, alive, v) in want.items() if alive)
    version = t.version()
    before = t.manifest()
    late = [("k1", -5, True, 0), (None, 900, True, 1), ("k2", None, True, 1), ("k3", 901, None, 1), ("new", 902, True, 4)]
    assert t.apply(spark.createDataFrame(late, schema), "alive") == version + 1
    after = t.manifest()
    changed = [b for b in after["buckets"] if after["buckets"][b] != before["buckets"].get(b)]
    assert 1 <= len(changed) <= 2  # only the buckets of k1 and new
    assert rows(t.read(version).select("k")) == sorted((k,) for k, (_, alive, _) in want.items() if alive)
    assert t.apply(spark.createDataFrame([], schema), "alive") == version + 1
    with pytest.raises(changefeed.CommitConflict):
        t._publish({"version": version + 1})


def test_changes_are_shuffled_once_and_meet_sorted_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changefeed, "GROUP_ROWS", 7)
    t = changefeed.BucketedTable(spark, f"file://{tmp_path}/t", ["k", "n"], "s", 8)
    first = spark.range(0, 500).selectExpr("concat('k', id) AS k", "id AS n", "10L AS s", "true AS alive", "CAST(id AS INT) AS c")
    t.apply(first, "alive")
    kept = t.manifest()["buckets"]
    assert len(kept) == 8 and all(len(f) == 1 for f in kept.values())
    plans = []
    monkeypatch.setattr(changefeed.BucketedTable, "_merge", lambda self, routed, before, schema, run=changefeed.BucketedTable._merge: (plans.append(routed), run(self, routed, before, schema))[1])
    later = spark.createDataFrame([("k3", 3, 11, False, None, "new"), ("k3", 3, 9, True, 5, "old"), ("zz", 1, 1, True, 1, "new"), ("k7", 7, 10, True, 99, "same")], "k string, n long, s long, alive boolean, c int, note string")
    assert t.apply(later, "alive") == 2
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "parquet" not in plan.lower()
    touched = {str(r[0]) for r in later.selectExpr("pmod(hash(k, n), 8)").collect()}
    after = t.manifest()["buckets"]
    assert {b for b in after if after[b] != kept[b]} == touched and len(touched) < 8
    want = [(f"k{i}", i, 10, i, None) for i in range(500) if i not in (3, 7)] + [("k7", 7, 10, 99, "same"), ("zz", 1, 1, 1, "new")]
    assert rows(t.read().select("k", "n", "s", "c", "note")) == sorted(want, key=lambda r: r[:2])
    assert t.read(1).count() == 500


def test_feed_is_applied_in_steps_to_its_own_table(spark, tmp_path):
    rnd = random.Random(9)
    data = [(b, rnd.choice([1, 2, None]), TS + datetime.timedelta(minutes=rnd.randrange(999)) if b % 9 else None, ["I"] * 3 + ["D"], [f"r{rnd.randrange(30)}" for _ in range(4)], [b * 4 + i for i in range(4)], [b, None, 3, b]) for b in range(120)]
    batches = spark.createDataFrame(data, "batch_id long, table_id long, arrived_at timestamp, actions array<string>, row_ids array<string>, sequences array<long>, quantities array<int>")
    want = {}
    for _, t, _, actions, ids, sequences, quantities in data:
        for x in zip(sequences, actions, quantities, ids):
            if t is not None and (t, x[3]) not in want or t is not None and want[t, x[3]][0] < x[0]:
                want[t, x[3]] = x
    table = changefeed.rebuild(batches, f"file://{tmp_path}/s")
    assert table.version() == changefeed.STEPS
    assert rows(table.read().select("table_id", "row_id", "sequence", "quantity")) == sorted((t, r, x[0], x[2]) for (t, r), x in want.items() if x[1] == "I")


def test_uris_are_opened_as_hadoop_writes_them(tmp_path):
    (tmp_path / "x").write_text("1")
    for uri in (f"file:{tmp_path}/x", f"file://{tmp_path}/x"):
        where, name = open_uri(uri)
        assert where.get_file_info(name).size == 1
    assert arrow_uri("s3a://bucket/a/b") == "s3://bucket/a/b" and arrow_uri("hdfs://host/a") == "hdfs://host/a" and arrow_uri("file:/a:b") == "file:///a:b"


def test_a_torn_or_refused_publication(spark, tmp_path):
    t = changefeed.BucketedTable(spark, f"file://{tmp_path}/t", ["k"], "s", 2)
    frame = spark.createDataFrame([(1, 1, True)], "k long, s long, alive boolean")
    t.apply(frame, "alive")
    (tmp_path / "t/_manifest/.00000000000000000002.json.abc").write_text("")  # a writer that died
    assert t.version() == 1 and rows(t.read()) == [(1, 1)]
    assert t.apply(frame.withColumn("s", F.lit(2).cast("long")), "alive") == 2
    with pytest.raises(Exception) as refused:
        publish(spark, "file:///proc/no-such-place/x.json", b"{}")
    assert not isinstance(refused.value, FileExists)


def test_feed_batches_with_odd_arrays(spark, tmp_path):
    data = [(1, 5, [" insert", "D", "I", None, "x"], ["a", "a", "b", "c", "d"], [1, 2, 3, 4]), (2, None, ["I"], ["z"], [1]), (3, 5, None, None, None), (4, 5, [], [], []), (5, 5, ["DELETE"], ["b"], [2])]
    batches = spark.createDataFrame(data, "batch_id long, table_id long, actions array<string>, row_ids array<string>, sequences array<long>")
    assert rows(changefeed.rebuild(batches, f"file://{tmp_path}/f").read()) == [(5, "b", 3)]
    assert rows(changefeed.rebuild(batches.limit(0), f"file://{tmp_path}/g").read()) == []


# Hierarchies -------------------------------------------------------------------------------------------------------------


def brute_hierarchy(edges):
    parent = {(t, n): p for t, n, p in edges}
    out = []
    for t, n in parent:
        seen, at = [(t, n)], (t, n)
        while (up := (t, parent[at])) in parent and up not in seen:
            seen.append(up)
            at = up
        up = (t, parent[at])
        if up not in parent:
            root, depth, path, state = at[1], len(seen) - 1, "/".join(str(x[1]) for x in reversed(seen)), "rooted"
        else:
            ring = seen[seen.index(up) :]
            inside = seen.index(up)
            root, depth, path, state = min(x[1] for x in ring), inside, "", "on_cycle" if inside == 0 else "into_cycle"
        out.append([t, n, root, depth, path, state])
    reach = {}
    for t, n in parent:
        at, seen = (t, n), {(t, n)}
        while (up := (t, parent[at])) in parent and up not in seen:
            seen.add(up)
            at = up
        for x in seen - {(t, n)}:
            reach[x] = reach.get(x, 0) + 1
    return sorted((*r, reach.get((r[0], r[1]), 0)) for r in out)


@pytest.mark.parametrize("seed,chunk,local", [(1, 50_000, 1 << 17), (2, 7, 20), (3, 11, 0)])
def test_hierarchy_equals_brute_force(spark, monkeypatch, seed, chunk, local):
    monkeypatch.setattr(hierarchy, "CHUNK", chunk)
    monkeypatch.setattr(hierarchy, "LOCAL", local)
    monkeypatch.setattr(hierarchy, "SIBLINGS", 5)
    rnd = random.Random(seed)
    edges = [("a", n, rnd.choice([None, 1000, rnd.randrange(60), rnd.randrange(max(1, n))])) for n in range(60)]
    edges += [("b", n, n - 1 if n else None) for n in range(40)] + [("b", 100 + n, 3) for n in range(30)]
    edges += [("c", 1, 1), ("c", 2, 1), ("c", 5, 6), ("c", 6, 7), ("c", 7, 5), ("c", 8, 7), ("c", -4, None)]
    got = rows(hierarchy.hierarchy(spark.createDataFrame([*edges, ("c", None, 1), ("c", 2, 1)], "tree string, node long, parent long")))
    assert got == brute_hierarchy(edges)


def test_intervals_contain_descendants(spark):
    edges = [("a", n, [None, 0, 0, 1, 1, 2, 99][n]) for n in range(7)] + [("a", 20, 21), ("a", 21, 20), ("a", 22, 20)]
    got = {r[1]: r[2:] for r in rows(hierarchy.intervals(spark.createDataFrame(edges, "tree string, node long, parent long")))}
    inside = {n: {m for m, (r, a, b) in got.items() if r == root and enter < a and b < leave} for n, (root, enter, leave) in got.items()}
    assert inside == {0: {1, 2, 3, 4, 5}, 1: {3, 4}, 2: {5}, 3: set(), 4: set(), 5: set(), 6: set(), 20: {22}, 21: set(), 22: set()}
    assert got[0] == (0, 0, 11) and got[6] == (6, 0, 1)


def test_one_parent_with_most_children(spark):
    """An unpatched hot parent."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        edges = spark.range(0, 150_100).selectExpr("'a' AS tree", "id AS node", "IF(id = 0, NULL, IF(id < 150000, 0, id - 1)) AS parent")
        found = hierarchy.hierarchy(edges)
        assert rows(found.groupBy("link_state", "root_id").agg(F.count("node_id"), F.max("depth"), F.max("descendants"))) == [("rooted", 0, 150_100, 101, 150_099)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_hierarchy_of_nothing(spark):
    empty = spark.createDataFrame([], "tree string, node long, parent long")
    assert rows(hierarchy.hierarchy(empty)) == []
    assert rows(hierarchy.hierarchy(spark.createDataFrame([("a", 1, None)], empty.schema))) == [("a", 1, 1, 0, "1", "rooted", 0)]


# Orphans -----------------------------------------------------------------------------------------------------------------


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(0, 3000).withColumnRenamed("id", "k")
    bloom = orphans.build_bloom(keys, "k")
    asked = orphans.split_by_bloom(spark.range(0, 9000).withColumnRenamed("id", "k"), "k", bloom)
    assert asked.where("k < 3000 AND NOT _maybe").count() == 0
    assert asked.where("k >= 3000 AND _maybe").count() < 6000 * 0.05


@pytest.mark.parametrize("most", [1 << 26, 0])
def test_bloom_in_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(orphans, "BLOCK_KEYS", 100)
    monkeypatch.setattr(orphans, "MOST_BLOOM_BYTES", most)
    keys = spark.range(0, 3000).select(F.concat(F.lit("k"), "id").alias("k"))
    bloom = orphans.build_bloom(keys.unionByName(keys.limit(10)).unionByName(spark.createDataFrame([(None,)], "k string")), "k")
    assert bloom.blocks > 20 and len(bloom.paths) == bloom.blocks
    asked = orphans.split_by_bloom(spark.range(0, 9000).select(F.concat(F.lit("k"), "id").alias("k"), "id"), "k", bloom)
    assert asked.where("id < 3000 AND NOT _maybe").count() == 0
    assert asked.where("id >= 3000 AND _maybe").count() < 6000 * 0.05


@pytest.mark.parametrize("most", [1 << 26, 0])
def test_orphans(spark, monkeypatch, most):
    monkeypatch.setattr(orphans, "MOST_BLOOM_BYTES", most)
    parents = [(1, None, TS), (2, TS, TS - DAY), (3, None, TS + 2 * DAY), (4, TS + 5 * DAY, TS), (5, None, None)]
    refs = [("r", i, TS + DAY, "x") for i in (1, 2, 3, 4, 5, 6, None)] + [("q", 3, TS + 9 * DAY, "x"), ("q", 2, None, "x"), ("q", 7, None, "x")]
    got = orphans.find_orphans(spark.createDataFrame(refs, "ref string, k long, at timestamp, deleted_at string"), spark.createDataFrame(parents, "k long, deleted_at timestamp, created_at timestamp"), "k", "at")
    assert rows(got.select("ref", "k", "orphan_kind")) == [("q", 7, "missing"), ("r", 2, "deleted"), ("r", 3, "late"), ("r", 6, "missing")]
    empty = spark.createDataFrame([], "k long, deleted_at timestamp, created_at timestamp")
    assert orphans.find_orphans(spark.createDataFrame(refs, "ref string, k long, at timestamp, z string"), empty, "k", "at").count() == 9


def test_file_orphans_and_report(spark):
    data = [("a", 1, TS, [table(1, ids=(1, 2, 2)), table(2, ids=None)], None, TS, 1), ("a", 1, TS, [table(1, ids=(9,))], None, TS - DAY, 1), ("b", 1, TS, None, "a", TS, 1)]
    restores = spark.createDataFrame([("x", TS, [2, 2, 3]), ("y", TS, None), ("x", TS, [2, 2, 3])], "restore_id string, restored_at timestamp, mps_missing array<long>")
    files = spark.createDataFrame([(1, TS, None, TS - DAY), (3, TS, TS - DAY, TS - 2 * DAY)], "mp_id long, loaded_at timestamp, purged_at timestamp, commit_ts timestamp")
    found = orphans.file_orphans(manifests(spark, data), restores, files)
    assert rows(found.select("ref_table", "ref_id", "mp_id", "orphan_kind")) == [("backup_manifests", "a", 2, "missing"), ("restore_results", "x", 2, "missing"), ("restore_results", "x", 3, "deleted")]
    assert [r[2:] for r in rows(orphans.orphan_report(found))] == [("missing", 1, 1), ("deleted", 1, 1), ("missing", 1, 1)]


# Readings ----------------------------------------------------------------------------------------------------------------

BEATS = "heartbeat_id long, worker_id long, sent_at timestamp, cpu_usage double, memory_usage double, chunk string, rank int"


def series(worker, values, start=0, other=None):
    return [(start + i, worker, TS + datetime.timedelta(seconds=30 * i), v, other, "c", 1) for i, v in enumerate(values)]


def noisy(n, level, spread, seed):
    return [float(x) for x in np.round(level + spread * np.sin(np.arange(n) / 9) + np.random.default_rng(seed).normal(0, spread / 3, n), 4)]


@pytest.mark.parametrize("chunk", [20_000, 50])
def test_readings(spark, monkeypatch, chunk):
    monkeypatch.setattr(outliers, "CHUNK", chunk)
    a = noisy(300, 0.4, 0.03, 1)
    for i in range(200, 300):
        a[i] += 0.3  # a lasting change of level
    a[50], a[51], a[120], a[250] = 0.8, 0.81, 0.1, 0.2
    a[20], a[21], a[22] = 1.5, float("nan"), float("-inf")
    a[100:108] = [0.4123] * 8
    a[104] = None
    a[108] = 0.4123
    b = [100 * x for x in noisy(300, 0.5, 0.02, 2)]
    for i in range(300):
        b[i] += i % 60 * 0.4  # slow rises and their resets
    b[150], b[151] = 1.1, 100.5
    data = series(1, a) + series(2, b, 1000) + series(None, [0.1, 5.0], 5000) + series(3, [0.5], 6000) + series(4, [None, None], 7000)
    frame = spark.createDataFrame(data + data[:40], BEATS)
    got = {(r[0], r[1]): r[2] for r in outliers.flag_readings(frame, ["cpu_usage", "memory_usage"]).select("id", "metric", "reason").collect()}
    want = {20: "impossible", 21: "impossible", 22: "impossible", 50: "spike", 51: "spike", 120: "spike", 250: "spike", 1150: "spike", 1151: "impossible"} | {i: "stuck" for i in range(100, 109) if i != 104}
    assert got == {(i, "cpu_usage"): r for i, r in want.items()}


def hard_series():
    """Long stuck runs, steps, bursts and a wave, over several sources; no two readings at one time."""
    rnd = np.random.default_rng(4)
    data = []
    for worker in range(1, 7):
        n = 400
        v = 0.5 + 0.05 * np.sin(np.arange(n) / (6 + worker)) + rnd.normal(0, 0.01, n)
        v[60:] += 0.1 * (worker % 3)
        v[100 + 10 * worker : 160 + 10 * worker] = 0.4444  # a run of 60
        v[300:306] = 0.6123  # too short
        v[30], v[200 + 12 * worker], v[299] = 0.9, 0.1, 0.05
        v[250:253] = (np.nan, np.inf, 7.0)
        data += [(1000 * worker + i, worker, TS + datetime.timedelta(seconds=(i if i < 200 else 200 + (i - 200) * 0.001) * 30), None if i % 41 == 0 else float(x), float(x) * 0.9 if i < 50 else None, "c", 1) for i, x in enumerate(v)]
    return data


def test_cuts_between_tasks_make_no_difference(spark, monkeypatch):
    frame = spark.createDataFrame(hard_series(), BEATS).repartition(3)
    found = {}
    for chunk in (20_000, 100, 50, 9):
        monkeypatch.setattr(outliers, "CHUNK", chunk)
        found[chunk] = rows(outliers.flag_readings(frame, ["cpu_usage", "memory_usage"]).select("id", "metric", "reason"))
    assert found[20_000] == found[100] == found[50] == found[9]
    reasons = {}
    for i, metric, reason in found[9]:
        reasons.setdefault((reason, metric), []).append(i)
    assert {1030, 1212, 1299, 6030, 6272, 6299} <= set(reasons["spike", "cpu_usage"]) and len(reasons["spike", "cpu_usage"]) < 25
    assert {1110, 1169, 6160, 6219} <= set(reasons["stuck", "cpu_usage"]) and not {1109, 1170, 1300, 1305} & set(reasons["stuck", "cpu_usage"])


def test_sources_and_ids_of_any_type_and_missing_times(spark, monkeypatch):
    data = [(f"h{i}", f"w{w}", None if t is None or i % 50 == 0 else t, v, 1) for i, w, t, v, *_ in hard_series() if w < 4] + [(None, "w1", None, 5.0, 1), ("x", None, TS, 0.5, 1), ("y", "", None, None, 1)]
    frame = spark.createDataFrame(data, "heartbeat_id string, worker_id string, sent_at timestamp_ntz, cpu_usage double, m0 int")
    found = {}
    for chunk in (20_000, 60):
        monkeypatch.setattr(outliers, "CHUNK", chunk)
        found[chunk] = rows(outliers.flag_readings(frame, ["cpu_usage"]).select("id", "source", "metric", "reason"))
    assert found[20_000] == found[60] and (None, "w1", "cpu_usage", "impossible") in found[60] and len(found[60]) > 190


def test_one_source_with_most_readings(spark):
    """An unpatched hot source, spread over tasks by range."""
    beats = spark.range(0, 150_000).selectExpr("id AS heartbeat_id", "IF(id % 50 = 0, id % 1000, 7L) AS worker_id", "timestamp_micros(1735689600000000 + id * 1000000) AS sent_at", "0.5 + 0.05 * sin(id / 40) + 0.01 * (rand(3) - 0.5) + IF(id IN (777, 77777), 0.4, 0) AS cpu_usage")
    found = rows(outliers.flag_readings(beats, ["cpu_usage"]).select("id", "reason"))
    assert {(777, "spike"), (77777, "spike")} <= set(found) and len(found) < 20


def test_cutoffs_follow_the_risk_and_a_heavy_tail(monkeypatch):
    rnd = np.random.default_rng(1)

    def cut(values, risk):
        monkeypatch.setattr(outliers, "RISK", risk)
        excess, counts = np.unique(np.round(values[values > 1] - 1, 2) + 0.005, return_counts=True)
        return outliers.fit_tail(excess, counts.astype(float), (values > 1).mean())[0]

    light, heavy = abs(rnd.normal(0, 1, 200_000)), abs(rnd.standard_t(4, 200_000))
    cuts = [cut(light, r) for r in (1e-3, 1e-4, 1e-5, 1e-6)]
    assert cuts == sorted(cuts) and cuts[3] > cuts[0] + 0.7
    assert (light - 1 > cuts[1]).mean() < 5e-4
    assert cut(heavy, 1e-5) > 1.5 * cut(light, 1e-5)
    assert cut(np.r_[light, np.full(400, 30.0)], 1e-6) < 1.3 * cut(light, 1e-6)  # spikes do not hide each other


def test_season_is_found_and_removed():
    times = np.arange(600) * 60e6 + 1.7e15
    wave = 0.2 * np.sin(2 * np.pi * times / outliers.PERIOD[30]) + np.random.default_rng(2).normal(0, 0.01, 600) + 0.5
    m = outliers.measure(wave, outliers.Halo())
    tried = outliers.periods_tried(times[0], times[-1], 600)
    season = outliers.fit_season(outliers.season_sums(m, times, tried), tried, 600)
    assert abs(np.log(season[0] / outliers.PERIOD[30])) < 0.1
    assert abs(outliers.residuals(m, times, season)[2][20:-20]).mean() < abs(outliers.residuals(m, times, None)[2][20:-20]).mean()
    noise = outliers.measure(np.random.default_rng(2).normal(0.5, 0.01, 600), outliers.Halo())
    assert outliers.fit_season(outliers.season_sums(noise, times, tried), tried, 600) is None


def test_readings_of_nothing(spark):
    assert outliers.flag_readings(spark.createDataFrame([], BEATS), ["cpu_usage"]).count() == 0
    assert outliers.flag_readings(spark.createDataFrame(series(1, [0.5] * 9), BEATS), ["cpu_usage"]).count() == 9


# Joins and helpers -------------------------------------------------------------------------------------------------------


def test_asof_across_slices(spark):
    left = spark.createDataFrame([(1, "a", TS + 3 * DAY), (2, "a", TS - DAY), (3, "a", TS), (4, None, TS), (5, "a", None), (6, "b", TS)], "id long, k string, t timestamp")
    right = spark.createDataFrame([(10, "a", TS), (11, "a", TS + DAY), (12, "a", TS + 4 * DAY), (13, None, TS)], "v long, k string, t timestamp")
    assert rows(joins.asof(left, right, "k", "t", ["v"]).select("id", "v")) == [(1, 11), (2, None), (3, 10), (4, None), (5, None), (6, None)]


@pytest.mark.parametrize("strict", [False, True])
def test_asof_pairs_equal_brute_force(spark, strict):
    """Hot keys, bursts, ties, nulls, and more tasks than any key has rows in."""
    rnd = random.Random(7)
    at = lambda: None if rnd.random() < 0.05 else TS + datetime.timedelta(microseconds=rnd.randrange(40) if rnd.random() < 0.5 else rnd.randrange(10**12))
    key = lambda: rnd.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(i, key(), rnd.randrange(2), at()) for i in range(300)]
    right = [(i, key(), rnd.randrange(2), at()) for i in range(120)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        l, r = spark.createDataFrame(left, "id long, k string, n int, t timestamp"), spark.createDataFrame(right, "v long, key string, n int, u timestamp")
        got = rows(joins.asof_pairs(l, r, [("k", "key"), ("n", "n")], ("t", "u"), strict).select("l.id", "r.v", "r.u"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = []
    for i, k, n, t in left:
        fit = [(u, v) for v, key_, n_, u in right if None not in (k, t, u) and (key_, n_) == (k, n) and (u < t or u == t and not strict)]
        late = max((u for u, _ in fit), default=None)
        want.append((i, max((v for u, v in fit if u == late), default=None), late))
    assert [r[0] for r in got] == list(range(300)) and got == [w for w in want]
    empty = joins.asof_pairs(l, r.limit(0), [("k", "key")], ("t", "u"))
    assert empty.count() == 300 and empty.where("r is not null").count() == 0 and joins.asof_pairs(l.limit(0), r, [("k", "key")], ("t", "u")).count() == 0


def test_join_unique_with_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "heavy_keys", lambda df, key, partitions=None: [1, 3])
    left = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n"), (4, "w")], "k long, v string")
    right = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k long, w long")
    assert rows(common.join_unique(left, right, "k").select("v", "w")) == [("n", None), ("w", None), ("x", 10), ("y", 10), ("z", 20)]
    assert rows(common.join_unique(left, right, "k", "inner").select("v", "w")) == [("x", 10), ("y", 10), ("z", 20)]


def test_hot_struct_key(spark):
    """A key that holds most rows, unpatched: keys of any type are joined."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        left = spark.range(0, 150_000).select(F.struct(F.lit("a").alias("t"), F.when(F.col("id") < 149_990, 7).otherwise(F.col("id")).alias("n")).alias("k"), "id")
        right = spark.createDataFrame([(("a", 7), 1), (("a", 149_995), 2), (("b", 7), 3)], "k struct<t:string,n:long>, v int")
        assert rows(common.join_unique(left, right, "k", "inner").groupBy("v").count()) == [(1, 149_990), (2, 1)]
        assert common.join_unique(left, right, "k").where("v is null").count() == 9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://there:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_root(type("S", (), {"sparkContext": Context, "conf": {}}))


def test_heavy_keys_are_few(spark):
    frame = spark.range(0, 400_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    assert common.heavy_keys(frame, "k", 16) == [7]


def test_current_rows(spark):
    frame = spark.createDataFrame([(1, "a", TS), (1, "b", TS + DAY), (1, "b", TS + DAY), (2, "c", None), (None, "d", TS)], "k long, v string, loaded_at timestamp")
    assert rows(common.current_rows(frame, "k", ["k", "v"])) == [(1, "b"), (2, "c")]


# Histograms --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("values", [list(range(5003)), [3] * 700 + list(range(301)), [1, 2], [None, 5], []])
@pytest.mark.parametrize("slice_rows", [100, 1_000_000])
def test_histogram_is_exact_at_any_accuracy(spark, monkeypatch, values, slice_rows):
    monkeypatch.setattr(maintenance, "SLICE_ROWS", slice_rows, raising=False)
    mixed = values[:]
    random.Random(1).shuffle(mixed)
    ordered = sorted(v for v in values if v is not None)
    want = [(b + 1, int(part[0]), int(part[-1]), len(part)) for b, part in enumerate(np.array_split(ordered, 4)) if len(part)]
    assert rows(maintenance.histogram(spark.createDataFrame([(v,) for v in mixed], "v long"), "v", 4, accuracy=5)) == want
