"""Queries about states of tables: counts, quality, upserts, deletes, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.functions import text as t
from lodegraph.operators import references, stats, store
from lodegraph.operators.graph import first_by
from lodegraph.plans.problems import _name
from lodegraph.plans.views import NE, N, edges, nodes
from lodegraph.runtime import cut, small, strip, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- counts ------------------------------------------------------------------------------------------


@query(f"""WITH {NE} SELECT 'type' AS kind, type AS value, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'relation_type', relation_type, count(*) FROM e GROUP BY 2
UNION ALL SELECT 'access', access, count(*) FROM n GROUP BY 2""")
def graph_stats(spark, d):
    """Nodes by type and access, edges by relation (A-01)."""
    n = stats.distribution(nodes(spark, d, "type", "access"), "type", "access")
    return n.unionByName(stats.distribution(edges(spark, d), "relation_type")).select(F.col("column").alias("kind"), "value", "n")


@query(f"""WITH {NE} SELECT count(*) FILTER (type = 'doc_section') AS n_sections, sum(word_count) FILTER (type = 'doc_section')::BIGINT AS n_words,
count(*) FILTER (type = 'doc_section' AND id IN (SELECT src FROM e UNION SELECT dst FROM e)) AS n_linked,
round(100 * count(*) FILTER (type = 'doc_section' AND id IN (SELECT src FROM e UNION SELECT dst FROM e)) / greatest(1, count(*) FILTER (type = 'doc_section')), 1) AS linked_percent FROM n""")
def doc_stats(spark, d):
    """Sections, their words and how many are linked (A-02, J-24, G-29)."""
    e = edges(spark, d)
    ends = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("linked", F.lit(True))
    s = nodes(spark, d, "type", "word_count").where("type = 'doc_section'").join(ends, "id", "left")
    out = s.agg(F.count("*").alias("n_sections"), F.sum("word_count").alias("n_words"), F.count_if("linked").alias("n_linked"))
    return out.withColumn("linked_percent", stats.share(F.col("n_linked"), F.col("n_sections")))


@query(f"WITH {NE} SELECT relation_type, round(confidence, 1) AS level, count(*) AS n FROM e WHERE confidence IS NOT NULL GROUP BY ALL")
def confidence_histogram(spark, d):
    """Edges by confidence in tenths (A-14)."""
    e = edges(spark, d, "confidence").where("confidence IS NOT NULL")
    return e.groupBy("relation_type", F.round("confidence", 1).alias("level")).agg(F.count("*").alias("n"))


@query(f"WITH {NE} SELECT dst, count(*) AS n FROM e WHERE relation_type = 'doc_describes_code' GROUP BY 1 ORDER BY n DESC, dst LIMIT 10")
def most_described(spark, d):
    """The code that most sections describe (A-15, A-17)."""
    return stats.top_counts(edges(spark, d, relations=["doc_describes_code"]), ["dst"], 10)


@query("SELECT from_id, to_id, relation_type, call_line, count(*) AS n FROM edge GROUP BY ALL HAVING count(*) > 1")
def duplicate_edges(spark, d):
    """Edges delivered more than once (A-13, U-04)."""
    return stats.duplicates(table(spark, d, "edge"), ["from_id", "to_id", "relation_type", "call_line"])


@query(f"""WITH {N}, pairs AS (SELECT DISTINCT relation_type, edge.id, {_name('n.name')} AS e, {_name('callee_name')} AS a FROM edge JOIN n ON n.id = to_id WHERE callee_name IS NOT NULL AND n.name IS NOT NULL AND edge.id IS NOT NULL)
SELECT relation_type, count(*) FILTER (e = a) AS tp, count(*) FILTER (e <> a) AS fp, count(*) FILTER (e <> a) AS fn,
round(count(*) FILTER (e = a) / count(*), 4) AS precision, round(count(*) FILTER (e = a) / count(*), 4) AS recall, round(count(*) FILTER (e = a) / count(*), 4) >= 0.9 AS passed FROM pairs GROUP BY 1""")
def name_accuracy(spark, d):
    """How often a call's written name is that of its target, per relation (A-12, O-03)."""
    e = table(spark, d, "edge").where("callee_name IS NOT NULL AND id IS NOT NULL").select("id", "to_id", "relation_type", "callee_name")
    n = nodes(spark, d, "name").where("name IS NOT NULL").select(F.col("id").alias("to_id"), "name")
    j = e.join(n, "to_id")
    expected = j.select("relation_type", "id", references.plain_name("name").alias("name"))
    actual = j.select("relation_type", "id", references.plain_name("callee_name").alias("name"))
    return stats.precision_recall(expected, actual, ["id", "name"], "relation_type", 0.9, 0.9)


@query(f"WITH {NE} SELECT relation_type, count(*) AS n, count(DISTINCT src) AS n_sources, count(DISTINCT dst) AS n_targets FROM e WHERE call_line > (SELECT avg(call_line) FROM e WHERE call_line > 0) GROUP BY 1")
def late_calls(spark, d):
    """Edges beyond the mean line, per relation: a scalar subquery in a filter (J-27)."""
    e = cut(edges(spark, d))
    mean = e.where("line > 0").agg(F.avg("line")).scalar()
    return e.where(F.col("line") > mean).groupBy("relation_type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_sources"), F.countDistinct("dst").alias("n_targets"))


# --- parse status -------------------------------------------------------------------------------------

_LATEST = r"""latest AS (SELECT source_file, lower(regexp_replace(status, '^\s+|\s+$', '', 'g')) AS status, node_count, edge_count, parsed_at FROM parse_status WHERE source_file IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY parsed_at DESC NULLS LAST, id DESC) = 1)"""


def latest_status(spark: SparkSession, d: str) -> DataFrame:
    """The last attempt of each file (S-22, T-11)."""
    rows = table(spark, d, "parse_status").where("source_file IS NOT NULL").select("source_file", F.lower(strip("status")).alias("status"), "node_count", "edge_count", "parsed_at", "id")
    return first_by(rows.distinct(), ["source_file"], F.desc_nulls_last("parsed_at"), F.desc("id")).drop("id")


@query(f"WITH {_LATEST} SELECT status, count(*) AS n_files, sum(node_count)::BIGINT AS n_nodes, sum(edge_count)::BIGINT AS n_edges, max(parsed_at) AS last FROM latest GROUP BY 1")
def parse_report(spark, d):
    """Files, nodes and edges by the status of the last attempt (A-19, S-22)."""
    s = latest_status(spark, d)
    return s.groupBy("status").agg(F.count("*").alias("n_files"), F.sum("node_count").alias("n_nodes"), F.sum("edge_count").alias("n_edges"), F.max("parsed_at").alias("last"))


@query(f"WITH {_LATEST} SELECT source_file FROM latest WHERE status = 'failed'")
def retry_failed(spark, d):
    """Files to parse again (P-25, C-06)."""
    return latest_status(spark, d).where("status = 'failed'").select("source_file")


@query("SELECT DISTINCT source_file FROM parse_status WHERE parsed_at >= (SELECT max(parsed_at) FROM parse_status) - INTERVAL 30 DAY AND source_file IS NOT NULL")
def recent_files(spark, d):
    """Files parsed within 30 days of the last attempt (C-07, S-15)."""
    p = table(spark, d, "parse_status").where("source_file IS NOT NULL")
    last = p.agg(F.max("parsed_at")).scalar()
    return p.where(F.col("parsed_at") >= last - F.expr("INTERVAL 30 DAYS")).select("source_file").distinct()


# --- writes -------------------------------------------------------------------------------------------


def _deliveries(spark: SparkSession, d: str, name: str, keys: list[str], *values: str) -> DataFrame:
    """All snapshots of a table, one row per key in each: the one loaded last."""
    rows = table(spark, d, name)
    if "call_line" in keys:
        rows = rows.withColumn("call_line", F.coalesce("call_line", F.lit(0)))
    rows = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return cut(first_by(rows, ["snapshot_no", *keys], F.desc_nulls_last("loaded_at"), *(F.desc(v) for v in values)).select("snapshot_no", *keys, *values))


def _pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each snapshot, and the one before it under the same number."""
    numbers = rows.select("snapshot_no").distinct()  # as many as snapshots, not rows
    later = cut(numbers.select("snapshot_no", F.lead("snapshot_no").over(W.orderBy("snapshot_no")).alias("later")).where("later IS NOT NULL"))
    before = rows.join(small(later), "snapshot_no").drop("snapshot_no").withColumnRenamed("later", "snapshot_no")
    return before, rows.join(small(later.select(F.col("later").alias("snapshot_no"))), "snapshot_no", "left_semi")


def _ends(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first snapshot, and all later ones."""
    first = rows.agg(F.min("snapshot_no")).scalar()
    return rows.where(F.col("snapshot_no") == first), rows.where(F.col("snapshot_no") > first)


_NODE_VALUES = ("file_path", "start_line", "content_hash", "access")
_NODES = """one AS (SELECT snapshot_no, unique_key, file_path, start_line, content_hash, access FROM node_snapshot WHERE unique_key IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, unique_key ORDER BY loaded_at DESC NULLS LAST, file_path DESC NULLS LAST, start_line DESC NULLS LAST, content_hash DESC NULLS LAST, access DESC NULLS LAST) = 1),
after AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS later FROM (SELECT DISTINCT snapshot_no FROM one) QUALIFY later IS NOT NULL),
a AS (SELECT later AS snapshot_no, unique_key, content_hash FROM one JOIN after USING (snapshot_no)),
b AS (SELECT * FROM one WHERE snapshot_no IN (SELECT later FROM after))"""
_EDGE_KEYS = ["from_key", "to_key", "relation_type", "call_line"]
_EDGES = """one AS (SELECT DISTINCT snapshot_no, from_key, to_key, relation_type, coalesce(call_line, 0) AS call_line FROM edge_snapshot WHERE from_key IS NOT NULL AND to_key IS NOT NULL AND relation_type IS NOT NULL)"""


@query(f"WITH {_NODES} SELECT snapshot_no, unique_key, file_path, start_line, content_hash, access FROM one QUALIFY row_number() OVER (PARTITION BY unique_key ORDER BY snapshot_no DESC) = 1")
def upsert_nodes(spark, d):
    """All later snapshots written over the first, in their order (U-01)."""
    stored, incoming = _ends(_deliveries(spark, d, "node_snapshot", ["unique_key"], *_NODE_VALUES))
    return store.upsert(stored, incoming, ["unique_key"], [F.desc("snapshot_no")])


@query(f"WITH {_EDGES} SELECT max(snapshot_no) AS snapshot_no, from_key, to_key, relation_type, call_line FROM one GROUP BY ALL")
def upsert_edges(spark, d):
    """The same for edges, by both ends, relation and line (U-02)."""
    stored, incoming = _ends(_deliveries(spark, d, "edge_snapshot", _EDGE_KEYS))
    return store.upsert(stored, incoming, _EDGE_KEYS, [F.desc("snapshot_no")])


@query(f"WITH {_NODES} SELECT snapshot_no, unique_key, file_path, start_line, content_hash, access FROM one QUALIFY row_number() OVER (PARTITION BY unique_key ORDER BY snapshot_no) = 1")
def insert_new(spark, d):
    """The first snapshot with the keys that only later ones have, as first delivered (U-03)."""
    stored, incoming = _ends(_deliveries(spark, d, "node_snapshot", ["unique_key"], *_NODE_VALUES))
    return store.insert_new(stored, incoming, ["unique_key"], [F.asc("snapshot_no")])


@query(f"""WITH {_NODES} SELECT snapshot_no, unique_key, CASE WHEN a.unique_key IS NULL THEN 'created' WHEN b.unique_key IS NULL THEN 'deleted'
WHEN a.content_hash IS NOT DISTINCT FROM b.content_hash THEN 'unchanged' ELSE 'updated' END AS change FROM a FULL JOIN b USING (snapshot_no, unique_key)""")
def doc_changes(spark, d):
    """Records by what each snapshot does to those of the one before (U-13, C-09)."""
    before, now = _pairs(_deliveries(spark, d, "node_snapshot", ["unique_key"], *_NODE_VALUES))
    return store.classify(before, now, ["snapshot_no", "unique_key"], "content_hash")


@query(f"""WITH {_NODES} SELECT snapshot_no, count(*) FILTER (a.unique_key IS NULL) AS n_new, count(*) FILTER (a.unique_key IS NOT NULL AND a.content_hash IS DISTINCT FROM b.content_hash) AS n_updated,
count(*) FILTER (a.unique_key IS NOT NULL AND a.content_hash IS NOT DISTINCT FROM b.content_hash) AS n_unchanged FROM b LEFT JOIN a USING (snapshot_no, unique_key) GROUP BY 1""")
def import_counts(spark, d):
    """New, updated and unchanged records of the import of each snapshot (A-18)."""
    before, now = _pairs(_deliveries(spark, d, "node_snapshot", ["unique_key"], *_NODE_VALUES))
    return store.import_counts(before, now, ["snapshot_no", "unique_key"], ["content_hash"], ("snapshot_no",))


@query(f"WITH {NE} SELECT relation_type, count(*) AS n FROM e WHERE src NOT IN (SELECT id FROM n WHERE starts_with(file_path, 'src/') AND ends_with(file_path, '.cpp')) GROUP BY 1")
def delete_out_edges(spark, d):
    """Edges left when those out of some files are deleted (U-06, U-07)."""
    n = nodes(spark, d, "file_path").where("file_path LIKE 'src/%' AND file_path LIKE '%.cpp'")
    return store.drop_out_edges(edges(spark, d), n, n.select("file_path").distinct()).groupBy("relation_type").agg(F.count("*").alias("n"))


@query(f"""WITH {NE}, gone AS (SELECT id FROM n WHERE contains(file_path, '/gen/') OR file_path IS NULL),
left_ AS (SELECT * FROM e WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone))
SELECT 'nodes' AS what, count(*) AS n FROM n WHERE id NOT IN (FROM gone) UNION ALL SELECT relation_type, count(*) FROM left_ GROUP BY 1""")
def delete_cascade(spark, d):
    """Nodes and edges left when generated code is deleted with its edges (U-08..U-11)."""
    n, e = cut(nodes(spark, d, "file_path")), cut(edges(spark, d))
    kept, left = store.drop_nodes(n, e, n.where("file_path LIKE '%/gen/%' OR file_path IS NULL"))
    total = kept.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n")
    return total.unionByName(left.groupBy(F.col("relation_type").alias("what")).agg(F.count("*").alias("n")))


@query(f"WITH {NE} SELECT relation_type, count(*) AS n FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) GROUP BY 1")
def intact_edges(spark, d):
    """Edges whose two ends exist (U-11, J-26)."""
    return store.with_both_ends(edges(spark, d), nodes(spark, d)).groupBy("relation_type").agg(F.count("*").alias("n"))


# --- scalar functions -----------------------------------------------------------------------------------


@query(rf"""WITH {N} SELECT id, split_part(namespace, '::', -1) AS tail, regexp_replace(namespace, '::[^:]*$', '') AS head, split_part(file_path, '/', -1) AS base,
array_to_string(list_filter(string_split(replace(file_path, '\', '/'), '/'), lambda x: x <> '')[-2:], '/') AS path_end, substr(sha256(coalesce(signature, '')), 1, 16) AS hash,
coalesce(regexp_matches(name, '^operator($|[^\p{{L}}\p{{N}}])') OR regexp_matches(name, '^(_M_|_r_|__|_\p{{Lu}})') OR name IN ('vector', 'map', 'set', 'pair', 'tuple') OR name = '', true) AS noise
FROM n WHERE type = 'function'""")
def name_functions(spark, d):
    """Parts of names and paths, hashes and noise of all functions (F-10, F-14..F-16, P-10, P-19)."""
    n = nodes(spark, d, "type", "name", "namespace", "file_path", "signature").where("type = 'function'")
    return n.select("id", t.tail("namespace").alias("tail"), t.head("namespace").alias("head"), t.basename("file_path").alias("base"), t.path_end("file_path").alias("path_end"),
                    t.content_hash(F.coalesce("signature", F.lit(""))).alias("hash"), t.is_call_noise("name").alias("noise"))


@query(r"""SELECT doc_id, (len(regexp_extract_all(coalesce(text, ''), '[\x{4E00}-\x{9FFF}]')) + len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z_][a-zA-Z0-9_]*')))::INT AS n_words,
CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS preview FROM documents""")
def text_functions(spark, d):
    """Words and previews of all documents (F-12, F-45)."""
    return table(spark, d, "documents").select("doc_id", t.word_count("text").alias("n_words"), t.preview("text").alias("preview"))
