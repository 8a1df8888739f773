"""The registered queries of the general data problems, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import changefeed, compaction, hierarchy, orphans, outliers, snapshots
from sedimenta.operators.common import current_rows, read, scratch_path, staged


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return compaction.compact(read(spark, d, "mp_scans"), read(spark, d, "micro_partitions"), read(spark, d, "compaction_configs"), read(spark, d, "mp_rows"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Small files, as the members of the merged and validated files."""
    return _merged(spark, d).select("table_id", F.explode("members.mp_id").alias("mp_id"))


def p1_merged(spark: SparkSession, d: str) -> DataFrame:
    """The records of all merged files, read back from their bytes."""
    rows = read(spark, d, "mp_rows")
    return compaction.decode_merged(_merged(spark, d), rows.schema).select("mp_id", "row_ordinal", "table_id", "id", "name", "amount", "written_at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.manifest_changes(read(spark, d, "backup_manifests"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.rebuild(read(spark, d, "cdc_batches"), scratch_path(spark, "changefeed")).read().select("table_id", "row_id", "sequence")


def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows that exist at the end, with the values of their last change."""
    return changefeed.rebuild(read(spark, d, "cdc_batches"), scratch_path(spark, "changefeed")).read().select("table_id", "row_id", "sequence", "txn_id", "status", "quantity")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    flagged = outliers.flag_readings(read(spark, d, "heartbeats"), ["cpu_usage", "memory_usage"])
    return flagged.select(F.col("id").alias("heartbeat_id"), "metric").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    files = current_rows(read(spark, d, "micro_partitions"), "mp_id", ["mp_id", "loaded_at", "supersedes"]).select(F.lit("mp").alias("tree"), F.col("mp_id").alias("node"), F.col("supersedes").alias("parent"))
    roles = current_rows(read(spark, d, "roles"), "id", ["id", "loaded_at", "owner_role_id"]).select(F.lit("role").alias("tree"), F.col("id").alias("node"), F.when(F.col("owner_role_id") != F.col("id"), F.col("owner_role_id")).alias("parent"))
    return hierarchy.hierarchy(files.unionByName(roles))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.file_orphans(read(spark, d, "backup_manifests"), read(spark, d, "restore_results"), read(spark, d, "micro_partitions"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_id", "mp_id", "orphan_kind")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per referring table and month."""
    return orphans.orphan_report(staged(_orphans(spark, d), "orphans"))


QUERIES = {f.__name__: f for f in (p1_found, p1_merged, p2_found, p3_found, p3_rows, p4_found, p5_found, p6_found, p6_report)}

_P1 = """
WITH cur AS (SELECT mp_id, arg_max(table_id, loaded_at) AS table_id, arg_max(schema_id, loaded_at) AS schema_id, arg_max(active, loaded_at) AS active FROM micro_partitions GROUP BY mp_id),
files AS (SELECT DISTINCT s.table_id, s.mp_id, c.schema_id FROM (SELECT table_id, unnest(mp_list) AS mp_id FROM mp_scans) s JOIN cur c ON c.mp_id = s.mp_id AND c.table_id = s.table_id WHERE c.active),
newest AS (SELECT * FROM compaction_configs QUALIFY row_number() OVER (PARTITION BY schema_id ORDER BY updated_at DESC) = 1),
dflt AS (SELECT * FROM newest WHERE schema_id IS NULL),
conf AS (SELECT s.schema_id, coalesce(n.enabled, d.enabled) AS enabled, coalesce(n.merge_enabled, d.merge_enabled) AS merge_enabled, coalesce(n.merge_min_mps, d.merge_min_mps) AS min_mps, coalesce(n.merge_target_rows, d.merge_target_rows) AS target
  FROM (SELECT DISTINCT schema_id FROM files) s LEFT JOIN newest n ON n.schema_id = s.schema_id LEFT JOIN dflt d ON TRUE),
counted AS (SELECT mp_id, count(DISTINCT row_ordinal) AS n FROM mp_rows GROUP BY mp_id),
sized AS (SELECT f.table_id, f.mp_id, coalesce(n, 0) AS n, target, min_mps, count(*) OVER (PARTITION BY f.table_id) AS files FROM files f JOIN conf c ON c.schema_id IS NOT DISTINCT FROM f.schema_id LEFT JOIN counted k ON k.mp_id = f.mp_id WHERE enabled AND merge_enabled),
small AS (SELECT *, count(*) OVER (PARTITION BY table_id) AS smalls FROM sized WHERE files >= min_mps AND 2 * n < target),
found AS (SELECT table_id, mp_id FROM small WHERE smalls >= 2)
"""
_TREE = """
{name}_nodes AS ({nodes}),
{name}_links AS (SELECT a.node, a.parent FROM {name}_nodes a JOIN {name}_nodes b ON a.parent = b.node),
{name}_up AS (SELECT node, node AS anc, 0 AS d FROM {name}_nodes UNION SELECT u.node, l.parent, u.d + 1 FROM {name}_up u JOIN {name}_links l ON u.anc = l.node WHERE u.d < (SELECT count(*) FROM {name}_nodes)),
{name}_ring AS (SELECT DISTINCT node FROM {name}_up WHERE d > 0 AND anc = node),
{name}_lab AS (SELECT u.node, min(u.anc) AS label FROM {name}_up u WHERE u.node IN (SELECT node FROM {name}_ring) GROUP BY u.node),
{name}_desc AS (SELECT anc AS node, count(DISTINCT node) - 1 AS n FROM {name}_up GROUP BY anc),
{name}_rooted AS (SELECT node, anc AS root, d FROM {name}_up u WHERE anc NOT IN (SELECT node FROM {name}_links)),
{name}_path AS (SELECT r.node, string_agg(CAST(u.anc AS VARCHAR), '/' ORDER BY u.d DESC) AS path FROM {name}_rooted r JOIN {name}_up u ON u.node = r.node GROUP BY r.node),
{name}_into AS (SELECT u.node, arg_min(g.label, u.d) AS root, min(u.d) AS d FROM {name}_up u JOIN {name}_lab g ON g.node = u.anc WHERE u.node NOT IN (SELECT node FROM {name}_ring) GROUP BY u.node)
"""
_ROWS = """
SELECT '{tree}' AS tree, r.node AS node_id, r.root AS root_id, CAST(r.d AS BIGINT) AS depth, p.path, 'rooted' AS link_state, CAST(c.n AS BIGINT) AS descendants FROM {name}_rooted r JOIN {name}_path p ON p.node = r.node JOIN {name}_desc c ON c.node = r.node
UNION ALL SELECT '{tree}', g.node, g.label, 0, '', 'on_cycle', c.n FROM {name}_lab g JOIN {name}_desc c ON c.node = g.node
UNION ALL SELECT '{tree}', i.node, i.root, i.d, '', 'into_cycle', c.n FROM {name}_into i JOIN {name}_desc c ON c.node = i.node
"""
_REFS = """
WITH man AS (SELECT backup_id, arg_max(created_at, loaded_at) AS ref_at, arg_max(tables, loaded_at) AS tables FROM (SELECT DISTINCT backup_id, created_at, loaded_at, tables FROM backup_manifests) GROUP BY backup_id),
refs AS (SELECT DISTINCT 'backup_manifests' AS ref_table, backup_id AS ref_id, unnest(t.mp_ids) AS mp_id, ref_at FROM (SELECT backup_id, ref_at, unnest(tables) AS t FROM man)
  UNION SELECT DISTINCT 'restore_results', restore_id, unnest(mps_missing), restored_at FROM restore_results),
cur AS (SELECT mp_id, max(loaded_at) AS newest FROM micro_partitions GROUP BY mp_id),
par AS (SELECT DISTINCT m.mp_id, m.purged_at, m.commit_ts FROM micro_partitions m JOIN cur c ON c.mp_id = m.mp_id AND c.newest = m.loaded_at),
found AS (SELECT r.*, CASE WHEN p.mp_id IS NULL THEN 'missing' WHEN p.purged_at <= r.ref_at THEN 'deleted' WHEN p.commit_ts > r.ref_at THEN 'late' END AS orphan_kind FROM refs r LEFT JOIN par p ON p.mp_id = r.mp_id WHERE r.mp_id IS NOT NULL)
"""
SQL = {
    "p1_found": _P1 + "SELECT table_id, mp_id FROM found",
    "p1_merged": _P1 + """SELECT r.mp_id, r.row_ordinal, r.table_id, r.id, r.name, r.amount, r.written_at FROM (SELECT * FROM mp_rows WHERE mp_id IN (SELECT mp_id FROM found)
      QUALIFY row_number() OVER (PARTITION BY mp_id, row_ordinal ORDER BY written_at DESC, table_id DESC, id DESC, name DESC NULLS LAST, amount DESC NULLS LAST) = 1) r""",
    "p2_found": """
WITH cur AS (SELECT DISTINCT b.backup_id, b.db_id, b.created_at, b.tables, b.incremental_from FROM backup_manifests b JOIN (SELECT backup_id, max(loaded_at) AS m FROM backup_manifests GROUP BY 1) x ON x.backup_id = b.backup_id AND x.m = b.loaded_at),
full_ AS (SELECT *, lag(backup_id) OVER (PARTITION BY db_id ORDER BY created_at) AS prev FROM cur WHERE tables IS NOT NULL AND trim(coalesce(incremental_from, '')) = ''),
ent AS (SELECT backup_id, t.table_id AS table_id, lower(trim(t.name)) AS name, t.owner AS owner, t.mp_ids AS ids FROM (SELECT backup_id, unnest(tables) AS t FROM full_)),
rows_ AS (SELECT backup_id, table_id, min(name) AS name, min(owner) AS owner, list_sort(list_distinct(flatten(list(coalesce(ids, []))))) AS ids FROM ent GROUP BY 1, 2),
pairs AS (SELECT db_id, prev, backup_id FROM full_ WHERE prev IS NOT NULL),
a AS (SELECT p.db_id, p.backup_id, r.table_id, r.name, r.owner, r.ids FROM pairs p JOIN rows_ r ON r.backup_id = p.backup_id),
b AS (SELECT p.db_id, p.backup_id, r.table_id, r.name, r.owner, r.ids FROM pairs p JOIN rows_ r ON r.backup_id = p.prev)
SELECT coalesce(a.db_id, b.db_id) AS db_id, coalesce(a.backup_id, b.backup_id) AS backup_id, coalesce(a.table_id, b.table_id) AS table_id, CASE WHEN b.table_id IS NULL THEN 'added' WHEN a.table_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM a FULL JOIN b ON a.backup_id = b.backup_id AND a.table_id = b.table_id
WHERE a.table_id IS NULL OR b.table_id IS NULL OR a.name IS DISTINCT FROM b.name OR a.owner IS DISTINCT FROM b.owner OR a.ids IS DISTINCT FROM b.ids""",
    "p3_found": """
SELECT table_id, row_id, max(s) AS sequence FROM (SELECT table_id, unnest(row_ids) AS row_id, unnest(sequences) AS s, unnest(actions) AS a FROM cdc_batches)
WHERE row_id IS NOT NULL AND s IS NOT NULL GROUP BY table_id, row_id HAVING upper(trim(arg_max(a, s))) IN ('I', 'INSERT')""",
    "p3_rows": """
SELECT table_id, row_id, c.s AS sequence, c.x AS txn_id, c.st AS status, c.q AS quantity FROM (SELECT table_id, row_id, arg_max(c, c.s) AS c FROM (
  SELECT table_id, row_id, {'s': s, 'a': a, 'x': x, 'st': st, 'q': q} AS c FROM (SELECT table_id, unnest(row_ids) AS row_id, unnest(sequences) AS s, unnest(actions) AS a, unnest(txn_ids) AS x, unnest(statuses) AS st, unnest(quantities) AS q FROM cdc_batches)
  WHERE row_id IS NOT NULL AND s IS NOT NULL) GROUP BY table_id, row_id) WHERE upper(trim(c.a)) IN ('I', 'INSERT')""",
    "p5_found": "WITH RECURSIVE " + _TREE.format(name="m", nodes="SELECT mp_id AS node, arg_max(coalesce(supersedes, -1), loaded_at) AS parent FROM micro_partitions GROUP BY mp_id") + ", "
    + _TREE.format(name="r", nodes="SELECT node, CASE WHEN p <> node THEN p END AS parent FROM (SELECT id AS node, arg_max(coalesce(owner_role_id, -1), loaded_at) AS p FROM roles GROUP BY id)") + _ROWS.format(tree="mp", name="m") + "UNION ALL" + _ROWS.format(tree="role", name="r"),
    "p6_found": _REFS + "SELECT ref_table, ref_id, mp_id, orphan_kind FROM found WHERE orphan_kind IS NOT NULL",
    "p6_report": _REFS + "SELECT ref_table, date_trunc('month', ref_at) AS period, orphan_kind, count(*) AS refs, count(DISTINCT mp_id) AS ids FROM found WHERE orphan_kind IS NOT NULL GROUP BY ALL",
}
