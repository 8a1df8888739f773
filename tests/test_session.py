import pytest

from sedimenta.errors import AlreadyExists, AmbiguousRelation, AnalysisError, EngineError, NotEmpty, PermissionDenied, StreamConcurrentConsume, StreamPayloadMissing, TableNotFound, TransactionConflict, UnsupportedStatement
from sedimenta.sources.table import VersionedTable
from sedimenta.streaming import cdc
from tests.conftest import rows


@pytest.fixture
def sales(session):
    session.sql("CREATE TABLE orders (id INT, customer_id INT, amount INT, status VARCHAR)")
    for row in ("1, 100, 50, 'pending'", "2, 100, 150, 'shipped'", "3, 200, 75, 'pending'", "4, 200, 300, 'shipped'", "5, 300, 100, 'cancelled'"):
        session.sql(f"INSERT INTO orders VALUES ({row})")
    return session


def test_aggregates(sales):
    assert rows(sales.sql("SELECT COUNT(*), SUM(amount), MIN(amount), MAX(amount), AVG(amount) FROM orders")) == [(5, 675, 50, 300, 135.0)]
    assert rows(sales.sql("SELECT customer_id, SUM(amount) FROM orders GROUP BY customer_id HAVING SUM(amount) > 100")) == [(100, 200), (200, 375)]
    assert rows(sales.sql("SELECT id FROM orders ORDER BY id LIMIT 2")) == [(1,), (2,)]
    assert len(rows(sales.sql("SELECT DISTINCT status FROM orders"))) == 3


def test_join_across_schemas(sales):
    sales.sql("CREATE SCHEMA other; CREATE TABLE other.customers (id INT, name VARCHAR); INSERT INTO other.customers VALUES (100, 'Alice'), (200, 'Bob')")
    got = rows(sales.sql("SELECT o.id, c.name FROM orders o INNER JOIN other.customers c ON o.customer_id = c.id"))
    assert got == [(1, "Alice"), (2, "Alice"), (3, "Bob"), (4, "Bob")]
    assert rows(sales.sql("SELECT customers.name FROM main.other.customers WHERE customers.id = 200")) == [("Bob",)]


def test_empty_table_aggregates(session):
    session.sql("CREATE TABLE t (id INT)")
    assert rows(session.sql("SELECT COUNT(*), SUM(id) FROM t")) == [(0, None)]


def test_copy_on_write(session):
    session.sql("CREATE TABLE items (id INT, qty INT); INSERT INTO items VALUES (1, 10), (2, 20), (3, NULL)")
    assert rows(session.sql("UPDATE items SET qty = 99 WHERE id = 1")) == [("UPDATE OK",)]
    session.sql("UPDATE items SET qty = qty + 1 WHERE qty IN (20) AND id BETWEEN 1 AND 5")
    assert rows(session.sql("DELETE FROM items WHERE qty > 90 OR id = 7")) == [("DELETE OK",)]
    assert rows(session.sql("SELECT * FROM items")) == [(2, 21), (3, None)]
    session.sql("DELETE FROM items")
    assert rows(session.sql("SELECT * FROM items")) == []


def test_insert_columns_defaults_and_not_null(session):
    session.sql("CREATE TABLE t (id INT NOT NULL, name VARCHAR DEFAULT 'none', v DECIMAL(10,2), b BOOLEAN, d DATE, ts TIMESTAMP)")
    session.sql("INSERT INTO t (id, v) VALUES (1, -2.50)")
    session.sql("INSERT INTO t SELECT 2, 'x', 1.5, true, DATE '2024-01-02', TIMESTAMP '2024-01-02 03:04:05'")
    got = rows(session.sql("SELECT id, name, CAST(v AS STRING), b, CAST(d AS STRING), CAST(ts AS STRING) FROM t"))
    assert got == [(1, "none", "-2.50", None, None, None), (2, "x", "1.50", True, "2024-01-02", "2024-01-02 03:04:05")]
    with pytest.raises(Exception, match="NOT NULL"):
        session.sql("INSERT INTO t (id) VALUES (NULL)")
    with pytest.raises(AnalysisError):
        session.sql("INSERT INTO t (id, v) VALUES (1)")
    assert rows(session.sql("SELECT count(*) FROM t")) == [(2,)]


def test_time_travel_and_clone(session):
    session.sql("CREATE TABLE history (id INT NOT NULL)")
    session.sql("INSERT INTO history VALUES (1)")
    table = session._table(("history",), "SELECT")[1]
    first = table.head().commit_ts
    session.sql("INSERT INTO history VALUES (2); UPDATE history SET id = 10 WHERE id = 1")
    assert rows(session.sql("SELECT * FROM history AT(TIMESTAMP => 1)")) == []
    assert rows(session.sql(f"SELECT * FROM history AT(TIMESTAMP => {first})")) == [(1,)]
    assert rows(session.sql(f"SELECT h.id, n.id FROM history AT(TIMESTAMP => {first}) h JOIN history n ON n.id = h.id + 1")) == [(1, 2)]
    assert rows(session.sql("SELECT * FROM history VERSION AS OF 2")) == [(1,)]
    session.sql(f"CREATE TABLE old CLONE history AT(TIMESTAMP => {first}); CREATE TABLE now CLONE history")
    session.sql("DELETE FROM now WHERE id = 2")
    assert rows(session.sql("SELECT * FROM old")) == [(1,)]
    assert rows(session.sql("SELECT * FROM now")) == [(10,)]
    assert rows(session.sql("SELECT * FROM history")) == [(2,), (10,)]


def test_alter_never_shows_dropped_values(session):
    session.sql("CREATE TABLE t (id INT, x INT); INSERT INTO t VALUES (1, 5)")
    session.sql("ALTER TABLE t DROP COLUMN x; ALTER TABLE t ADD COLUMN x VARCHAR; INSERT INTO t VALUES (2, 'new')")
    assert rows(session.sql("SELECT * FROM t")) == [(1, None), (2, "new")]


def test_transactions(engine):
    a, b = engine.session(), engine.session()
    a.sql("CREATE TABLE accounts (id INT, balance INT); INSERT INTO accounts VALUES (1, 100)")
    a.sql("BEGIN; UPDATE accounts SET balance = 50 WHERE id = 1; INSERT INTO accounts VALUES (2, 7); DELETE FROM accounts WHERE id = 2")
    assert rows(a.sql("SELECT * FROM accounts")) == [(1, 50)]
    assert rows(b.sql("SELECT * FROM accounts")) == [(1, 100)]
    a.sql("ROLLBACK")
    assert rows(a.sql("SELECT * FROM accounts")) == [(1, 100)]
    a.sql("BEGIN; UPDATE accounts SET balance = 1 WHERE id = 1; COMMIT")
    assert rows(b.sql("SELECT * FROM accounts")) == [(1, 1)]
    a.sql("BEGIN; UPDATE accounts SET balance = 2 WHERE id = 1")
    b.sql("UPDATE accounts SET balance = 3 WHERE id = 1")
    with pytest.raises(TransactionConflict):
        a.sql("COMMIT")
    assert rows(a.sql("SELECT * FROM accounts")) == [(1, 3)]
    assert rows(a.sql("COMMIT")) == [("No active transaction",)]


def test_stream_consume_and_preview(session):
    session.sql("CREATE TABLE events (id INT); INSERT INTO events VALUES (0); CREATE STREAM s ON TABLE events")
    has = lambda: rows(session.sql("SELECT SYSTEM$STREAM_HAS_DATA('s')"))
    assert has() == [("false",)]
    session.sql("INSERT INTO events VALUES (1), (2); INSERT INTO events VALUES (3)")
    assert has() == [("true",)]
    for _ in range(2):
        assert rows(session.sql("SELECT id FROM s WITH (COMMIT = FALSE)")) == [(1,), (2,), (3,)]
    assert rows(session.sql("SELECT id FROM s WITH (COMMIT = FALSE) WHERE id >= 2 ORDER BY id LIMIT 1")) == [(2,)]
    assert rows(session.sql("SELECT id FROM s WHERE id = 2 LIMIT 1")) == [(2,)]
    assert rows(session.sql("SELECT * FROM s")) == []
    assert has() == [("false",)]


def test_stream_updates_and_deletes(session):
    session.sql("CREATE TABLE orders (id INT, status TEXT); CREATE STREAM s ON TABLE orders")
    session.sql("INSERT INTO orders VALUES (1, 'a'), (2, 'a'), (3, 'a'); UPDATE orders SET status = 'b' WHERE id = 2; DELETE FROM orders WHERE id = 3")
    got = session.sql("SELECT id, status, METADATA$ACTION, METADATA$ISUPDATE, METADATA$ROW_ID, METADATA$SEQUENCE FROM s ORDER BY METADATA$SEQUENCE").collect()
    assert [r[5] for r in got] == [1, 2, 3, 4, 5, 6]
    assert [tuple(r[:4]) for r in got[3:]] == [(2, "a", "DELETE", True), (2, "b", "INSERT", True), (3, "a", "DELETE", False)]
    by_id = {r[0]: r[4] for r in got[:3]}
    assert got[3][4] == got[4][4] == by_id[2] and got[5][4] == by_id[3]
    assert session.sql("SELECT * FROM s").columns[:3] == ["id", "status", "METADATA$ACTION"]


@pytest.mark.parametrize("fault", ["short", "missing"])
def test_stream_payload_is_checked_beyond_the_driver_files(session, engine, monkeypatch, fault):
    import os

    import pyarrow.parquet as pq

    session.sql("CREATE TABLE t (id INT); CREATE STREAM s ON TABLE t")
    for i in range(4):
        session.sql(f"INSERT INTO t VALUES ({i}), ({i + 10})")
    monkeypatch.setattr(cdc, "CHECKED_FILES", 1)
    table = VersionedTable(engine.spark, engine.store, engine.catalog.find("tables", ("main", "public", "t"))["id"])
    assert len(rows(cdc.changes(table, 0))) == 8
    path = cdc.records(table, 0)[-1]["path"].removeprefix("file:").replace("///", "/")
    whole = pq.read_table(path)
    os.remove(path)
    if fault == "short":
        pq.write_table(whole.slice(0, whole.num_rows - 1), path)
    with pytest.raises(StreamPayloadMissing):
        cdc.changes(table, 0)


def test_stream_conflict_and_names(session, engine):
    session.sql("CREATE TABLE t (id INT); CREATE STREAM s ON TABLE t; INSERT INTO t VALUES (1)")
    offset = cdc.Offset(engine.store, engine.catalog.find("streams", ("main", "public", "s"))["id"])
    move, _ = offset.get()
    offset.advance(move, 1)
    with pytest.raises(StreamConcurrentConsume):
        offset.advance(move, 1)
    session.sql("CREATE TABLE s (id INT)")
    with pytest.raises(AmbiguousRelation):
        session.sql("SELECT * FROM s")
    with pytest.raises(UnsupportedStatement):
        session.sql("CREATE STREAM a ON TABLE t APPEND_ONLY = TRUE")
    assert [r[0] for r in rows(session.sql("SHOW STREAMS LIKE 's%'"))] == ["s"]
    assert rows(session.sql("DESCRIBE STREAM s"))[0][-1] == 1


def test_dynamic_full_and_incremental(session, engine):
    session.sql("CREATE TABLE source (id INT, status VARCHAR); INSERT INTO source VALUES (1, 'x'), (2, 'y')")
    session.sql("CREATE DYNAMIC TABLE d TARGET_LAG = '10 minutes' REFRESH_MODE = INCREMENTAL AS SELECT id, upper(status) AS st FROM source WHERE id > 0")
    session.sql("CREATE DYNAMIC TABLE n TARGET_LAG = '1 minute' AS SELECT COUNT (*) AS c FROM source")
    assert rows(session.sql("SELECT * FROM d")) == [(1, "X"), (2, "Y")]
    session.sql("ALTER DYNAMIC TABLE d REFRESH")
    session.sql("INSERT INTO source VALUES (3, 'z'); DELETE FROM source WHERE id = 1; UPDATE source SET status = 'w' WHERE id = 2")
    session.sql("ALTER DYNAMIC TABLE d REFRESH; ALTER DYNAMIC TABLE n REFRESH")
    assert rows(session.sql("SELECT * FROM d")) == [(2, "W"), (3, "Z")]
    assert rows(session.sql("SELECT * FROM __dt_output_n")) == [(2,)]
    shown = rows(session.sql("SHOW DYNAMIC TABLES"))
    assert [r[:3] for r in shown] == [("d", "INCREMENTAL", 600), ("n", "AUTO", 60)] and {r[4] for r in shown} == {"Success"}
    session.sql("ALTER DYNAMIC TABLE d SUSPEND; INSERT INTO source VALUES (9, 'q')")
    head = engine.table(engine.catalog.find("tables", ("main", "public", "source"))["id"]).head()
    assert engine.tick(head.commit_ts + 700 * 10**6) == ["main.public.n"]
    session.sql("DELETE FROM source; ALTER DYNAMIC TABLE d REFRESH")
    assert rows(session.sql("SELECT * FROM d")) == []


def test_dynamic_failures_leave_nothing(session, engine):
    session.sql("CREATE TABLE a (id INT)")
    with pytest.raises(TableNotFound):
        session.sql("CREATE DYNAMIC TABLE d TARGET_LAG = '1 minute' AS SELECT id FROM missing")
    assert engine.catalog.objects("dynamic") == [] and len(engine.catalog.objects("tables")) == 1
    with pytest.raises(AnalysisError):
        session.sql("CREATE DYNAMIC TABLE e TARGET_LAG = '1 minute' REFRESH_MODE = INCREMENTAL AS SELECT count(*) AS c FROM a")


def test_functions(session):
    session.sql("CREATE TABLE numbers (id INT); INSERT INTO numbers VALUES (1), (2), (NULL)")
    session.sql("CREATE FUNCTION add_one(x INT) RETURNS INT LANGUAGE SQL AS 'x + 1'")
    assert rows(session.sql("SELECT add_one(id) FROM numbers")) == [(None,), (2,), (3,)]
    session.sql("CREATE OR REPLACE FUNCTION add_one(x INT) RETURNS INT LANGUAGE SQL AS 'x + 2'; CREATE FUNCTION add_one(x INT, y INT DEFAULT 7) RETURNS INT LANGUAGE SQL STRICT AS 'x / 2 + y'")
    assert rows(session.sql("SELECT ADD_ONE(id, 1) FROM numbers WHERE id IS NOT NULL")) == [(1,), (2,)]
    with pytest.raises(AnalysisError, match="ambiguous"):
        session.sql("SELECT add_one(id) FROM numbers")
    session.sql("DROP FUNCTION add_one(INT, INT)")
    assert rows(session.sql("SELECT add_one(id) FROM numbers WHERE add_one(id) > 3")) == [(4,)]
    with pytest.raises(AnalysisError, match="only SQL"):
        session.sql("CREATE FUNCTION f(x INT) RETURNS INT LANGUAGE PYTHON AS 'x'")
    with pytest.raises(AlreadyExists):
        session.sql("CREATE FUNCTION add_one(x INT) RETURNS INT LANGUAGE SQL AS 'x'")


def test_merge(session):
    session.sql("CREATE TABLE t (id INT, v VARCHAR); INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c'); CREATE TABLE s (id INT, v VARCHAR, gone BOOLEAN); INSERT INTO s VALUES (1, 'A', false), (2, 'B', true), (9, 'Z', false)")
    session.sql("MERGE INTO t USING s ON t.id = s.id WHEN MATCHED AND s.gone THEN DELETE WHEN MATCHED THEN UPDATE SET v = s.v || t.v WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, s.v)")
    assert rows(session.sql("SELECT * FROM t")) == [(1, "Aa"), (3, "c"), (9, "Z")]
    session.sql("INSERT INTO s VALUES (1, 'again', false)")
    with pytest.raises(AnalysisError, match="several source rows"):
        session.sql("MERGE INTO t USING s ON t.id = s.id WHEN MATCHED THEN UPDATE ALL BY NAME")
    session.sql("MERGE INTO t AS x USING (SELECT id, v FROM s WHERE id = 9) AS y ON x.id = y.id WHEN MATCHED THEN UPDATE ALL BY NAME WHEN NOT MATCHED THEN INSERT ALL BY NAME")
    assert rows(session.sql("SELECT * FROM t")) == [(1, "Aa"), (3, "c"), (9, "Z")]


def test_security(engine):
    root = engine.session()
    root.sql("CREATE TABLE secret (id INT); INSERT INTO secret VALUES (1); CREATE ROLE analyst; CREATE USER bob; GRANT ROLE analyst TO USER bob")
    bob = engine.session("bob", "analyst")
    for query in ("SELECT * FROM secret", "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret", "SELECT 1 WHERE EXISTS (SELECT 1 FROM secret)"):
        with pytest.raises(PermissionDenied):
            bob.sql(query)
    root.sql("GRANT USAGE ON DATABASE main TO ROLE analyst; GRANT USAGE ON SCHEMA main.public TO ROLE analyst; GRANT SELECT ON TABLE secret TO ROLE analyst")
    assert rows(bob.sql("SELECT * FROM secret")) == [(1,)]
    for statement in ("INSERT INTO secret VALUES (2)", "DROP TABLE secret", "CREATE TABLE mine (id INT)", "GC 7"):
        with pytest.raises(PermissionDenied):
            bob.sql(statement)
    assert ("analyst", "TABLE", "main.public.secret", "SELECT", False) in rows(root.sql("SHOW GRANTS TO ROLE analyst"))
    root.sql("CREATE ROLE child; GRANT ROLE analyst TO ROLE child")
    with pytest.raises(AnalysisError, match="circle"):
        root.sql("GRANT ROLE child TO ROLE analyst")
    root.sql("REVOKE SELECT ON TABLE secret FROM ROLE analyst")
    with pytest.raises(PermissionDenied):
        bob.sql("SELECT * FROM secret")


def test_catalog_statements(session):
    session.sql("CREATE DATABASE shop; USE shop; CREATE SCHEMA s; USE shop.s; CREATE TABLE b (id INT); CREATE TABLE a AS SELECT 1 AS x, 'q' AS y")
    assert rows(session.sql("SHOW TABLES")) == [("a",), ("b",)]
    assert ("shop",) in rows(session.sql("SHOW DATABASES"))
    with pytest.raises(NotEmpty):
        session.sql("DROP SCHEMA s")
    with pytest.raises(NotEmpty):
        session.sql("DROP DATABASE shop")
    session.sql("DROP TABLE a; DROP TABLE b; UNDROP TABLE a")
    assert rows(session.sql("SELECT * FROM a")) == [(1, "q")]
    with pytest.raises(AlreadyExists):
        session.sql("CREATE TABLE a (id INT)")
    session.sql("CREATE TABLE IF NOT EXISTS a (id INT); DROP TABLE a; DROP SCHEMA s; DROP DATABASE shop")
    with pytest.raises(TableNotFound):
        session.sql("SELECT * FROM a")


def test_upkeep(session, engine):
    session.sql("CREATE TABLE t (id INT)")
    for i in range(9):
        session.sql(f"INSERT INTO t VALUES ({i})")
    session.sql("CREATE TABLE c CLONE t")
    table = session._table(("t",), "SELECT")[1]
    assert rows(session.sql("OPTIMIZE t TARGET_ROWS 100")) == [("merged 9 files into 1",)]
    assert len(table.head().files) == 1 and [r[0] for r in rows(session.sql("SELECT id FROM t"))] == list(range(9))
    assert rows(session.sql("GC 0")) == [("GC: deleted 0 expired MPs (retention=0d)",)]
    session.sql("DROP TABLE c")
    assert rows(session.sql("GC 7")) == [("GC: deleted 0 expired MPs (retention=7d)",)]
    assert rows(session.sql("GC 0")) == [("GC: deleted 9 expired MPs (retention=0d)",)]
    assert [r[0] for r in rows(session.sql("SELECT id FROM t"))] == list(range(9))
    session.sql("BACKUP TO 'b1.json'; DELETE FROM t WHERE id > 2")
    assert rows(session.sql("RESTORE FROM 'b1.json'"))[0][:2] == (1, 1)
    assert len(rows(session.sql("SELECT id FROM t"))) == 9


def test_pruning_reads_fewer_files(session, engine):
    engine.cache.most = 0
    session.sql("CREATE TABLE t (id INT, name VARCHAR); INSERT INTO t SELECT id, 'n' || id FROM range(0, 101, 1, 1); INSERT INTO t SELECT id + 100, NULL FROM range(0, 101, 1, 1)")
    df = session.sql("SELECT * FROM t WHERE id > 150")
    assert df.count() == 50 and len(df.inputFiles()) == 1
    assert len(session.sql("SELECT * FROM t WHERE name IS NOT NULL AND id BETWEEN 1 AND 300").inputFiles()) == 1
    assert len(session.sql("SELECT * FROM t WHERE id < 20 OR length(name) > 1").inputFiles()) == 2


def test_cache_and_prepared(session, engine):
    session.sql("CREATE TABLE t (id INT); INSERT INTO t VALUES (1)")
    session.sql("SELECT sum(id) FROM t").collect()
    hits = engine.cache.hits
    assert rows(session.sql("select   SUM(id) from t;")) == [(1,)] and engine.cache.hits == hits + 1
    session.sql("INSERT INTO t VALUES (5)")
    assert rows(session.sql("SELECT sum(id) FROM t")) == [(6,)]
    session.sql("PREPARE q FROM 'SELECT id FROM t WHERE id > ?'")
    assert rows(session.sql("EXECUTE q USING 2")) == [(5,)]
    assert rows(session.sql("SELECT id FROM t WHERE id = :x", {"x": 1})) == [(1,)]
    with pytest.raises(EngineError):
        session.sql("CREATE NONSENSE")
    with pytest.raises(AnalysisError):
        session.sql("SELEC 1 FROM")


def test_backups_survive_collection(session):
    session.sql("CREATE TABLE t (id INT); INSERT INTO t VALUES (1), (2); BACKUP TO 'b.json'; DELETE FROM t; GC 0; DROP TABLE t; GC 0")
    assert [r[0] for r in rows(session.sql("SHOW BACKUPS"))] == ["b.json"]
    assert rows(session.sql("RESTORE FROM 'b.json'").select("tables_restored", "files_missing")) == [(1, [])]
    assert rows(session.sql("SELECT * FROM t")) == [(1,), (2,)]
    session.sql("DELETE FROM t; DROP BACKUP 'b.json'; DROP BACKUP IF EXISTS 'b.json'")
    assert "deleted 0" not in session.sql("GC 0").first()[0] and rows(session.sql("SHOW BACKUPS")) == []
    with pytest.raises(AnalysisError):
        session.sql("DROP BACKUP 'b.json'")


def test_collection_starts_where_all_is_gone(session):
    session.sql("CREATE TABLE t (id INT)")
    table = session._table(("t",), "SELECT")[1]
    for i in range(4):
        session.sql(f"INSERT INTO t VALUES ({i}); DELETE FROM t WHERE id = {i}")
    session.sql("CREATE STREAM s ON TABLE t; INSERT INTO t VALUES (9); DELETE FROM t; GC 0")
    settled = table.store.latest(f"{table.folder}/_settled")
    assert settled == table.head().version - 1  # the stream still needs the last change
    session.sql("SELECT * FROM s; GC 0")
    assert table.store.latest(f"{table.folder}/_settled") == table.head().version
    session.sql("INSERT INTO t VALUES (10); GC 0")
    assert rows(session.sql("SELECT * FROM t")) == [(10,)]


def test_history_is_read_from_the_nearest_checkpoint(session, monkeypatch):
    from sedimenta.sources import table as tables

    monkeypatch.setattr(tables, "CHECKPOINT_EVERY", 5)
    session.sql("CREATE TABLE t (id INT); CREATE STREAM s ON TABLE t")
    table = session._table(("t",), "SELECT")[1]
    times = []
    for i in range(22):
        session.sql(f"INSERT INTO t VALUES ({i})")
        times.append(table.head().commit_ts)
    read = []
    monkeypatch.setattr(VersionedTable, "_entry", lambda self, v, entry=VersionedTable._entry: (read.append(v), entry(self, v))[1])
    assert len(table.at_version(18).files) == 17 and sorted(read) == [16, 17, 18]
    read.clear()
    assert [len(table.as_of(t).files) for t in (0, times[0], times[12], times[12] + 0, times[21] + 9)] == [0, 1, 13, 13, 22]
    assert len(set(read)) < 20
    read.clear()
    assert [c["seq_start"] for c in cdc.records(table, 19)] == [20, 21, 22] and len(read) < 9
    assert VersionedTable(session.spark, table.store, table.table_id).head().version == 23


def test_tasks_run_when_due_and_after_each_other(session, engine):
    session.sql("CREATE TABLE log (what VARCHAR); CREATE TABLE src (id INT); CREATE STREAM s ON TABLE src")
    session.sql("CREATE TASK first SCHEDULE = '5 minutes' AS INSERT INTO log VALUES ('first')")
    session.sql("CREATE TASK second AFTER first AS INSERT INTO log VALUES ('second')")
    session.sql("CREATE TASK third AFTER second WHEN SYSTEM$STREAM_HAS_DATA('s') AS INSERT INTO log SELECT 'third' FROM s")
    assert engine.tick(0) == []
    session.sql("ALTER TASK first RESUME; ALTER TASK second RESUME; ALTER TASK third RESUME")
    assert engine.tick(10**9) == ["main.public.first", "main.public.second"]
    session.sql("INSERT INTO src VALUES (1)")
    assert engine.tick(10**9 + 1) == []
    assert engine.tick(2 * 10**9) == [f"main.public.{t}" for t in ("first", "second", "third")]
    assert rows(session.sql("SELECT what, count(*) FROM log GROUP BY what")) == [("first", 2), ("second", 2), ("third", 1)]
    assert [(r["name"], r["status"]) for r in session.sql("SHOW TASKS").collect()] == [(n, "Success") for n in ("first", "second", "third")]
    session.sql("ALTER TASK first SUSPEND; DROP TASK third; DROP TASK IF EXISTS third; CREATE OR REPLACE TASK second SCHEDULE = '1 minute' AS SELECT * FROM nothing; ALTER TASK second RESUME")
    assert engine.tick(9 * 10**9) == [] and session.sql("SHOW TASKS").where("name = 'second'").first()["status"].startswith("Failed")
    for bad in ("CREATE TASK x AS SELECT 1", "CREATE TASK x AFTER nothing AS SELECT 1", "DROP TASK third"):
        with pytest.raises(AnalysisError):
            session.sql(bad)


def test_merge_reads_only_files_in_the_sources_range(session, monkeypatch):
    from sedimenta.operators import dml

    session.sql("CREATE TABLE t (id INT, v INT)")
    for i in range(5):
        session.sql(f"INSERT INTO t SELECT /*+ COALESCE(1) */ id + {i * 10}, 0 FROM range(0, 10, 1, 1)")
    read = []
    monkeypatch.setattr(dml, "mergeable", lambda *a, run=dml.mergeable: (read.append(run(*a)), read[-1])[1])
    session.sql("MERGE INTO t USING (SELECT id + 15 AS k FROM range(8)) s ON t.id = s.k WHEN MATCHED THEN UPDATE SET v = 1 WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.k, 2)")
    assert len(read[0]) == 2
    session.sql("MERGE INTO t USING (SELECT CAST(NULL AS INT) AS k) s ON t.id = s.k WHEN MATCHED THEN DELETE WHEN NOT MATCHED THEN INSERT (id, v) VALUES (99, 3)")
    assert read[1] == []
    session.sql("MERGE INTO t USING (SELECT 3 AS k) s ON t.id < s.k WHEN MATCHED THEN DELETE")
    assert len(read[2]) == len(session._table(("t",), "SELECT")[1].at_version(8).files)
    assert rows(session.sql("SELECT v, count(*), min(id), max(id) FROM t GROUP BY v")) == [(0, 39, 3, 49), (1, 8, 15, 22), (3, 1, 99, 99)]


def test_qualify_limit_by_and_apply(session):
    session.sql("CREATE TABLE t (g VARCHAR, n INT); INSERT INTO t VALUES ('a', 1), ('a', 2), ('a', 3), ('b', 9), (NULL, 5), (NULL, 6)")
    assert rows(session.sql("SELECT g, n FROM t QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC) = 1")) == [(None, 6), ("a", 3), ("b", 9)]
    assert [tuple(r) for r in session.sql("SELECT g, n * 10 AS m FROM t WHERE n < 9 QUALIFY m > 10 ORDER BY n DESC LIMIT 3").collect()] == [(None, 60), (None, 50), ("a", 30)]
    assert rows(session.sql("SELECT count(*) FROM (SELECT DISTINCT g FROM t QUALIFY n > 2 UNION ALL SELECT g FROM t QUALIFY max(n) OVER () = n)")) == [(4,)]
    assert rows(session.sql("SELECT g, sum(n) AS s FROM t GROUP BY g HAVING sum(n) > 1 QUALIFY rank() OVER (ORDER BY sum(n)) <= 2")) == [("a", 6), ("b", 9)]
    assert [tuple(r) for r in session.sql("SELECT n FROM t ORDER BY g NULLS LAST, n DESC LIMIT 1 BY g LIMIT 2").collect()] == [(3,), (9,)]
    assert len(rows(session.sql("SELECT n FROM t LIMIT 2 BY g"))) == 5
    assert rows(session.sql("SELECT a.n, x.m FROM t a CROSS APPLY (SELECT max(b.n) AS m FROM t b WHERE b.n < a.n AND b.g = a.g HAVING count(*) > 0) x WHERE a.n < 9")) == [(2, 1), (3, 2)]
    assert rows(session.sql("SELECT a.n, e FROM t a OUTER APPLY explode(sequence(1, a.n)) AS x(e) WHERE a.g = 'a' AND a.n < 3")) == [(1, 1), (2, 1), (2, 2)]
    assert rows(session.sql("SELECT 'QUALIFY LIMIT 1 BY x' AS \"s\" FROM t LIMIT 1".replace('"', "`"))) == [("QUALIFY LIMIT 1 BY x",)]
    with pytest.raises(AnalysisError):
        session.sql("SELECT 1 QUALIFY 1")


def test_asof_join_text(session):
    session.sql("CREATE TABLE trades (sym VARCHAR, at INT, px INT); CREATE TABLE quotes (sym VARCHAR, at INT, bid INT)")
    session.sql("INSERT INTO trades VALUES ('a', 5, 1), ('a', 1, 2), ('b', 7, 3), (NULL, 7, 4); INSERT INTO quotes VALUES ('a', 2, 10), ('a', 5, 11), ('b', 9, 12), (NULL, 1, 13)")
    assert rows(session.sql("SELECT t.px, q.bid FROM trades t ASOF LEFT JOIN quotes q ON t.sym = q.sym AND t.at >= q.at")) == [(1, 11), (2, None), (3, None), (4, None)]
    assert rows(session.sql("SELECT t.px, q.bid FROM trades AS t ASOF JOIN quotes AS q MATCH_CONDITION (t.at > q.at) ON t.sym = q.sym WHERE t.px > 0")) == [(1, 10)]
    assert rows(session.sql("SELECT trades.px, q.b FROM main.public.trades ASOF JOIN (SELECT sym, at, bid + 1 AS b FROM quotes) q ON q.at <= trades.at AND q.sym = trades.sym ORDER BY q.b")) == [(1, 12)]
    for bad in ("t.sym = q.sym", "t.at >= q.at", "t.sym = q.sym AND t.at <= q.at", "t.sym = q.sym AND t.at >= q.at AND t.px > q.bid"):
        with pytest.raises(AnalysisError):
            session.sql(f"SELECT t.px FROM trades t ASOF JOIN quotes q ON {bad}")


def test_python_functions(session):
    session.sql("CREATE TABLE t (n INT); INSERT INTO t VALUES (1), (2), (NULL)")
    session.register("twice", lambda v: v * 2, "long")
    assert rows(session.sql("SELECT twice(n) FROM t WHERE n IS NOT NULL")) == [(2,), (4,)]
    with pytest.raises(AnalysisError):
        session.register("x", lambda v: v, "long", "other")


def test_copy_in_and_out(session, tmp_path):
    session.sql("CREATE TABLE t (id INT, name VARCHAR, d DATE) WITH (COMPRESSION = 'zstd'); INSERT INTO t VALUES (1, 'a', DATE '2024-01-01'), (2, NULL, NULL)")
    for kind in ("parquet", "orc", "csv", "json"):
        options = "TYPE = CSV, HEADER = true" if kind == "csv" else f"TYPE = {kind.upper()}"
        session.sql(f"COPY INTO 'file://{tmp_path}/{kind}' FROM t FILE_FORMAT = ({options})")
        session.sql(f"CREATE TABLE {kind}_ (id INT, name VARCHAR, d DATE); COPY INTO {kind}_ FROM 'file://{tmp_path}/{kind}' FILE_FORMAT = ({options})")
        assert rows(session.sql(f"SELECT * FROM {kind}_")) == rows(session.sql("SELECT * FROM t"))
    session.sql(f"COPY INTO 'file://{tmp_path}/q' FROM (SELECT id FROM t WHERE id > 1)")
    session.sql(f"CREATE TABLE u (x INT, id INT); COPY INTO u (id) FROM 'file://{tmp_path}/q' FILE_FORMAT = (TYPE = 'parquet')")
    assert rows(session.sql("SELECT * FROM u")) == [(None, 2)]
    path = next(iter(session._table(("t",), "SELECT")[1].head().files.values()))["path"]
    import pyarrow.parquet as pq

    assert pq.read_metadata(path.removeprefix("file:")).row_group(0).column(0).compression == "ZSTD"
    for bad in ("CREATE TABLE x (id INT) WITH (COMPRESSION = 'nothing')", "CREATE TABLE x (id INT) WITH (a = 1)", "COPY INTO t FROM 'x' FILE_FORMAT = (TYPE = XML)"):
        with pytest.raises(AnalysisError):
            session.sql(bad)


def test_analyze_and_advice(session):
    session.sql("CREATE TABLE a (id INT, b_id INT); CREATE TABLE b (id INT, c_id INT); CREATE TABLE c (id INT)")
    session.sql("INSERT INTO a SELECT id, id % 10 FROM range(1000); INSERT INTO b SELECT id, id % 3 FROM range(10); INSERT INTO c VALUES (0), (1), (NULL)")
    assert rows(session.sql("ANALYZE TABLE b")) == [("c_id", 10, 3, 0, "0", "2"), ("id", 10, 10, 0, "0", "9")]
    assert rows(session.sql("ANALYZE TABLE c COMPUTE STATISTICS")) == [("id", 3, 2, 1, "0", "1")]
    got = session.sql("EXPLAIN ADVICE SELECT * FROM a x JOIN b ON b.id = x.b_id JOIN main.public.c ON c.id = b.c_id WHERE x.id > 5").collect()
    assert [(r["build"], r["probe"], r["distribution"]) for r in got] == [("c", "b", got[0][4]), ("(c b)", "x", got[1][4])] and {r[4] for r in got} <= {"broadcast_left", "broadcast_right"}
    with pytest.raises(AnalysisError):
        session.sql("EXPLAIN ADVICE SELECT * FROM a, c")


def test_health(engine):
    assert engine.health() == {"alive": True, "ready": True, "checks": {"catalog": True, "spark": True, "store": True}}


def test_log_entries_appear_whole_or_not(session, tmp_path):
    from sedimenta.sources.store import FileExists, Store

    store = Store(session.spark, str(tmp_path / "s"))
    store.create("a/00000000000000000001.json", {"x": 1})
    with pytest.raises(FileExists):
        store.create("a/00000000000000000001.json", {"x": 2})
    (tmp_path / "s/a/.00000000000000000002.json.dead").write_text("{")
    assert store.latest("a") == 1 and store.read("a/00000000000000000001.json") == {"x": 1}
    store.create("a/00000000000000000002.json", {"x": 3})
    with pytest.raises(Exception) as refused:
        Store(session.spark, "/proc/none").create("x.json", {})
    assert not isinstance(refused.value, FileExists)


def test_refresh_looks_only_into_files_of_the_changed_rows(session, monkeypatch):
    session.sql("CREATE TABLE t (id INT)")
    for i in range(4):
        session.sql(f"INSERT INTO t SELECT id + {i * 100} FROM range(0, 100, 1, 1)")
    session.sql("CREATE DYNAMIC TABLE d TARGET_LAG = '1 minute' REFRESH_MODE = INCREMENTAL AS SELECT id, id * 2 AS two FROM t WHERE id % 10 <> 0")
    output = session.engine.table(session.engine.catalog.find("dynamic", ("main", "public", "d"))["output_id"])
    assert all(f["origins"] for f in output.head().files.values())
    looked, scan = [], VersionedTable.scan
    monkeypatch.setattr(VersionedTable, "scan", lambda self, s, files=None, **k: (looked.append(len(files)) if self is output and k.get("file_names") else None, scan(self, s, files, **k))[1])
    session.sql("INSERT INTO t VALUES (1000), (1001); ALTER DYNAMIC TABLE d REFRESH")
    assert looked == []  # appended rows are in no output file yet
    session.sql("UPDATE t SET id = id + 5000 WHERE id = 105; DELETE FROM t WHERE id = 107; ALTER DYNAMIC TABLE d REFRESH")
    assert looked == [1]
    want = [i for i in (*range(400), 1000, 1001, 5105) if i % 10 and i not in (105, 107)]
    assert rows(session.sql("SELECT id, two FROM d")) == [(i, 2 * i) for i in want]
