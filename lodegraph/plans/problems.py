"""The pN queries of the general problems, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import heavy_keys, hierarchy, incremental, references, snapshots
from lodegraph.runtime import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.files_to_update(*(table(spark, d, t) for t in ("parse_status", "processed_file", "update_run"))).select("source_file")


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    return incremental.update_runs(*(table(spark, d, t) for t in ("parse_status", "processed_file", "update_run")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_edges(table(spark, d, "edge"), table(spark, d, "node"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    edge = table(spark, d, "edge")
    return references.orphan_report(references.orphan_edges(edge, table(spark, d, "node")), edge)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.code_hierarchies(table(spark, d, "edge"), table(spark, d, "include_dep"))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "edge").where("relation_type = 'belongs_to' AND to_id > 0")
    return hierarchy.full_hierarchy(links.select(F.col("from_id").alias("child"), F.col("to_id").alias("parent")))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "edge").where("relation_type = 'belongs_to' AND to_id > 0")
    links = cut(links.select(F.col("from_id").alias("child"), F.col("to_id").alias("parent")))
    pairs = hierarchy.ancestor_pairs(links, cut(hierarchy.resolve_forest(links)))
    return pairs.where("distance > 0").select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "distance")


def p3_paths_all(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "edge").where("relation_type = 'belongs_to' AND to_id > 0")
    return hierarchy.full_hierarchy(links.select(F.col("from_id").alias("child"), F.col("to_id").alias("parent")), cycles=True)


def p3_descendants_all(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "edge").where("relation_type = 'belongs_to' AND to_id > 0")
    pairs = hierarchy.every_pair(links.select(F.col("from_id").alias("child"), F.col("to_id").alias("parent")))
    return pairs.select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "distance")


def p3_include_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.include_paths(hierarchy.include_links(table(spark, d, "include_dep")))


def p3_include_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.include_descendants(hierarchy.include_links(table(spark, d, "include_dep")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.heavy_targets(table(spark, d, "edge")).select("relation_type", "to_id")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.target_counts(table(spark, d, "edge"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.code_graph_changes(table(spark, d, "node_snapshot"), table(spark, d, "edge_snapshot"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_runs, p2_found, p2_report, p3_found, p3_paths, p3_descendants, p3_paths_all, p3_descendants_all, p3_include_paths, p3_include_descendants, p4_found, p4_counts, p6_found)
}

_HASH = r"regexp_replace(regexp_replace(lower(regexp_replace(file_hash, '^\s+|\s+$', '', 'g')), '^md5:', ''), '^\s+|\s+$', '', 'g')"
_STATE = r"lower(regexp_replace({}, '^\s+|\s+$', '', 'g'))"
_VERSIONS = f"""
WITH ready AS (
  SELECT source_file, {_HASH} AS h FROM parse_status
  WHERE source_file IS NOT NULL AND {_STATE.format('status')} IN ('success', 'partial') AND {_HASH} <> ''
  QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY parsed_at DESC NULLS LAST, id DESC) = 1),
taken AS (
  SELECT source_file, {_HASH} AS h FROM processed_file p JOIN update_run r USING (run_id)
  WHERE source_file IS NOT NULL AND {_STATE.format('r.state')} = 'success'
  QUALIFY row_number() OVER (PARTITION BY source_file
    ORDER BY r.finished_at DESC NULLS LAST, run_id DESC, processed_at DESC NULLS LAST, {_HASH} DESC NULLS LAST) = 1),
found AS (SELECT source_file FROM ready LEFT JOIN taken USING (source_file) WHERE taken.source_file IS NULL OR ready.h IS DISTINCT FROM taken.h)"""
P1 = f"{_VERSIONS} SELECT source_file FROM found"
P1_RUNS = f"""{_VERSIONS}
SELECT 1 AS run_no, count(*) AS n_records, count(*) AS n_processed FROM taken
UNION ALL SELECT 2, (SELECT count(*) FROM ready), count(*) FROM found
UNION ALL SELECT 3, count(*), 0 FROM ready"""


def _name(c: str) -> str:
    # template arguments nested up to 8 deep
    for _ in range(8):
        c = f"regexp_replace({c}, '<[^<>]*>', '', 'g')"
    return rf"regexp_replace(regexp_replace({c}, '^.*::', '', 's'), '\s+', '', 'g')"


_ORPHANS = f"""
cur AS (SELECT * FROM node WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1),
parents AS (
  SELECT 'id' AS kind, id::VARCHAR AS key, created_at, deleted_at FROM cur
  UNION ALL SELECT CASE WHEN type = 'function' THEN 'function' ELSE 'type' END, {_name('name')}, created_at, deleted_at
  FROM cur WHERE type IN ('function', 'class', 'struct')),
valid AS (
  SELECT kind, key, count(*) FILTER (deleted_at IS NULL) AS live,
    count(*) FILTER (deleted_at IS NULL AND created_at IS NULL) AS undated, min(created_at) FILTER (deleted_at IS NULL) AS born
  FROM parents WHERE key IS NOT NULL GROUP BY ALL),
refs AS (
  SELECT id, created_at AS ts, relation_type,
    CASE WHEN to_id > 0 THEN 'id' WHEN needs_resolution AND resolve_hint = 'type_alias' THEN 'type'
      WHEN needs_resolution AND (resolve_hint IS NULL OR resolve_hint IN ('override', 'using_decl')) THEN 'function' END AS kind,
    CASE WHEN to_id > 0 THEN to_id::VARCHAR WHEN resolve_hint = 'type_alias' THEN {_name('target_simple_name')}
      WHEN resolve_hint IS NULL THEN {_name('callee_name')} ELSE {_name('function_name')} END AS key
  FROM edge),
judged AS (
  SELECT id AS edge_id, ts, CASE WHEN live IS NULL THEN 'missing' WHEN live = 0 THEN 'deleted'
    WHEN undated = 0 AND born > ts THEN 'late' END AS reason
  FROM refs LEFT JOIN valid USING (kind, key) WHERE kind IS NOT NULL),
orphans AS (
  SELECT edge_id, reason, strftime(ts, '%Y-%m') AS period FROM judged WHERE reason IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY ts NULLS FIRST, reason) = 1)"""
P2 = f"WITH {_ORPHANS} SELECT edge_id, reason, period FROM orphans"
P2_REPORT = f"""WITH {_ORPHANS}, relation AS (SELECT id AS edge_id, min(relation_type) AS relation_type FROM edge GROUP BY 1)
SELECT relation_type, period, reason, count(*) AS n_edges FROM orphans JOIN relation USING (edge_id) GROUP BY ALL"""

_OWNER = """
one AS (SELECT from_id AS child, min(to_id) AS parent FROM edge WHERE relation_type = 'belongs_to' AND to_id > 0 AND from_id IS NOT NULL GROUP BY 1),
ids AS (SELECT child AS id FROM one UNION SELECT parent FROM one),
up(id, top, depth) AS (
  SELECT id, id, 0::BIGINT FROM ids
  UNION ALL SELECT up.id, one.parent, up.depth + 1 FROM up JOIN one ON up.top = one.child WHERE up.depth < 300),
rooted AS (SELECT id, top AS root, depth FROM up WHERE top NOT IN (SELECT child FROM one)),
looped AS (SELECT id, min(top) AS root, -1::BIGINT AS depth FROM up WHERE id NOT IN (SELECT id FROM rooted) AND depth >= 150 GROUP BY 1)"""


def _sql_path(c: str) -> str:
    return rf"regexp_replace(regexp_replace(replace({c}, '\', '/'), '/+', '/', 'g'), '^\./', '')"


P3 = f"""WITH RECURSIVE {_OWNER},
inc AS (SELECT DISTINCT {_sql_path('source_file')} AS a, {_sql_path('included_file')} AS b FROM include_dep
  WHERE is_system = false AND source_file IS NOT NULL AND included_file IS NOT NULL),
reach(a, b) AS (SELECT a, b FROM inc UNION SELECT reach.a, inc.b FROM reach JOIN inc ON reach.b = inc.a),
cyc AS (SELECT x.a AS node, min(x.b) AS root FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1)
SELECT 'belongs_to' AS hierarchy, id::VARCHAR AS node_key, root::VARCHAR AS root_key, depth FROM (FROM rooted UNION ALL FROM looped)
UNION ALL SELECT 'include', node, root, -1::BIGINT FROM cyc"""
P3_PATHS = f"""WITH RECURSIVE {_OWNER},
path AS (SELECT up.id, string_agg(top::VARCHAR, '/' ORDER BY up.depth DESC) AS path FROM up JOIN rooted USING (id) GROUP BY 1),
below AS (SELECT top AS id, count(*) AS n FROM up WHERE up.depth > 0 AND up.id IN (SELECT id FROM rooted) GROUP BY 1)
SELECT id AS node, root, depth, path, coalesce(n, 0) AS n_descendants
FROM (FROM rooted UNION ALL FROM looped) LEFT JOIN path USING (id) LEFT JOIN below USING (id)"""

P3_DESCENDANTS = f"""WITH RECURSIVE {_OWNER}
SELECT top AS node, id AS descendant, depth AS distance FROM up WHERE depth > 0 AND id IN (SELECT id FROM rooted)"""

P3_PATHS_ALL = f"""WITH RECURSIVE {_OWNER},
path AS (SELECT up.id, string_agg(top::VARCHAR, '/' ORDER BY up.depth DESC) AS path FROM up JOIN rooted USING (id) GROUP BY 1),
below AS (SELECT top AS id, count(DISTINCT up.id) AS n FROM up WHERE top <> up.id GROUP BY 1)
SELECT id AS node, root, depth, path, coalesce(n, 0) AS n_descendants
FROM (FROM rooted UNION ALL FROM looped) LEFT JOIN path USING (id) LEFT JOIN below USING (id)"""

P3_DESCENDANTS_ALL = f"""WITH RECURSIVE {_OWNER}
SELECT top AS node, id AS descendant, min(depth) AS distance FROM up WHERE top <> id GROUP BY ALL"""

P3_INCLUDE_DESCENDANTS = f"""WITH RECURSIVE inc AS (SELECT DISTINCT {_sql_path('source_file')} AS child, {_sql_path('included_file')} AS parent FROM include_dep
  WHERE is_system = false AND source_file IS NOT NULL AND included_file IS NOT NULL),
walk(node, descendant, distance) AS (SELECT parent, child, 1::BIGINT FROM inc
  UNION SELECT node, child, distance + 1 FROM walk JOIN inc ON parent = descendant WHERE distance < 64)
SELECT node, descendant, min(distance) AS distance FROM walk WHERE node <> descendant GROUP BY ALL"""

_COUNTS = """
once AS (SELECT DISTINCT from_id, to_id, relation_type, coalesce(call_line, 0) AS line FROM edge WHERE to_id > 0),
counts AS (SELECT relation_type, to_id, count(*) AS n_edges FROM once GROUP BY ALL)"""
P4_COUNTS = f"WITH {_COUNTS} SELECT * FROM counts"
P4 = f"WITH {_COUNTS} SELECT relation_type, to_id FROM counts WHERE n_edges >= 0.005 * (SELECT count(*) FROM once)"


def _changes(entity: str, rows: str) -> str:
    return f"""
SELECT k.later AS snapshot_no, '{entity}' AS entity, key AS record_key,
  CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM (SELECT no AS earlier, later, key FROM {rows} JOIN next_{rows} USING (no)
      UNION SELECT n.no, later, key FROM {rows} r JOIN next_{rows} n ON r.no = later) k
LEFT JOIN {rows} a ON a.no = earlier AND a.key = k.key LEFT JOIN {rows} b ON b.no = later AND b.key = k.key
WHERE a.key IS NULL OR b.key IS NULL OR a.v IS DISTINCT FROM b.v""".replace("key AS record_key", "k.key AS record_key")


P6 = rf"""WITH nodes AS (
  SELECT snapshot_no AS no, unique_key AS key, row(file_path, start_line, end_line,
    regexp_replace(regexp_replace(signature, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), lower(content_hash), access) AS v
  FROM node_snapshot WHERE unique_key IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, unique_key ORDER BY loaded_at DESC NULLS LAST) = 1),
edges AS (
  SELECT snapshot_no AS no, from_key || '~' || to_key || '~' || coalesce(call_line, 0)::VARCHAR AS key,
    row(lower(regexp_replace(relation_type, '\s+', '', 'g'))) AS v
  FROM edge_snapshot WHERE from_key IS NOT NULL AND to_key IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, from_key, to_key, coalesce(call_line, 0) ORDER BY loaded_at DESC NULLS LAST) = 1),
next_nodes AS (SELECT no, lead(no) OVER (ORDER BY no) AS later FROM (SELECT DISTINCT no FROM nodes) QUALIFY later IS NOT NULL),
next_edges AS (SELECT no, lead(no) OVER (ORDER BY no) AS later FROM (SELECT DISTINCT no FROM edges) QUALIFY later IS NOT NULL)
{_changes('node', 'nodes')} UNION ALL {_changes('edge', 'edges')}"""

SQL: dict[str, str] = {
    "p1_found": P1,
    "p1_runs": P1_RUNS,
    "p2_found": P2,
    "p2_report": P2_REPORT,
    "p3_found": P3,
    "p3_paths": P3_PATHS,
    "p3_descendants": P3_DESCENDANTS,
    "p3_paths_all": P3_PATHS_ALL,
    "p3_descendants_all": P3_DESCENDANTS_ALL,
    "p3_include_descendants": P3_INCLUDE_DESCENDANTS,
    "p4_found": P4,
    "p4_counts": P4_COUNTS,
    "p6_found": P6,
}
