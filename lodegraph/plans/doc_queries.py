"""Queries to documents, sections, vectors and telemetry over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import text as t
from lodegraph.operators import documents as docs
from lodegraph.operators import findings, questions, retrieval, stats
from lodegraph.plans import doc_sql
from lodegraph.plans.views import NE, E, N, edges, nodes
from lodegraph.runtime import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sections(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Current sections of the node table."""
    return nodes(spark, d, *dict.fromkeys(["type", *columns])).where("type = 'doc_section'")


# --- Markdown ----------------------------------------------------------------------------------------


@query(r"""WITH ln AS (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, regexp_matches(trim(line, E' \t\r\n\x0b\x0c'), '^##\s+.') AND NOT regexp_matches(trim(line, E' \t\r\n\x0b\x0c'), '^#{3,}') AS h FROM ln),
g AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY no) AS part FROM s)
SELECT doc_id, min(no)::BIGINT AS start_line, max(no)::BIGINT AS end_line FROM g GROUP BY doc_id, part""")
def section_split(spark, d):
    """Sections of every document, cut at headings of level two (W-10)."""
    return docs.sections(table(spark, d, "documents")).select("doc_id", "start_line", "end_line")


@query(doc_sql.SECTION_NODES)
def section_nodes(spark, d):
    """Sections with short ones merged, their hash, words and tags (W-09, D-12, F-10, F-12, F-40)."""
    rules = [("docs/*telemetry*", ["telemetry"]), ("docs/*", ["docs"])]
    return docs.section_nodes(docs.merge_short(docs.sections(table(spark, d, "documents"))), rules).drop("content")


@query(doc_sql.DOCUMENT_NODES)
def document_nodes(spark, d):
    """Documents with the fields of their heads, titles and summaries (D-01, F-32..F-37, W-12)."""
    return docs.document_nodes(table(spark, d, "documents"))


@query(doc_sql.DOCUMENT_EDGES)
def document_edges(spark, d):
    """Links and mentioned symbols of every document (D-02, D-06, D-07)."""
    return docs.document_edges(table(spark, d, "documents"))


@query(doc_sql.KNOWLEDGE_NODES)
def knowledge_nodes(spark, d):
    """A node per section outside code (D-03..D-05)."""
    return docs.knowledge_nodes(table(spark, d, "documents"))


@query(r"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '`([A-Z][A-Za-z0-9_]*(?:::[A-Za-z0-9_~]+)+)`', 1)) AS symbol FROM documents
UNION SELECT doc_id, s FROM (SELECT doc_id, unnest(regexp_extract_all(text, '`([A-Z][A-Za-z0-9_]{2,})`', 1)) AS s FROM documents)
WHERE regexp_matches(s, '[a-z]') AND NOT regexp_matches(s, '^[A-Z]{2,}_'))
SELECT DISTINCT doc_id, symbol FROM s""")
def document_symbols(spark, d):
    """Names in code marks (F-27, P-22)."""
    return table(spark, d, "documents").select("doc_id", F.explode(t.backtick_symbols("text")).alias("symbol"))


@query(rf"""WITH {N}, links AS (SELECT DISTINCT doc_id, trim(unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1))) AS link FROM documents),
p AS (SELECT *, regexp_replace(split_part(link, '::', -1), '\|.*$', '') AS name, CASE WHEN contains(link, '::') THEN regexp_replace(link, '::[^:]*$', '') END AS ns FROM links),
hit AS (SELECT doc_id, link, n.id, CASE type WHEN 'class' THEN 1 WHEN 'function' THEN 2 WHEN 'struct' THEN 3 END AS tier, coalesce(coalesce(namespace, '') = ns, false) AS near
  FROM p JOIN n USING (name) WHERE type IN ('class', 'function', 'struct'))
SELECT doc_id, link, id AS target, tier FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id, link ORDER BY tier, near DESC, id) = 1""")
def link_targets(spark, d):
    """Code that double-bracket links lead to (J-16, F-26)."""
    return docs.link_targets(table(spark, d, "documents"), nodes(spark, d, "type", "name", "namespace"))


# --- documents and code ------------------------------------------------------------------------------


@query(rf"""WITH {N}, w AS (SELECT id AS part_id, unnest(regexp_extract_all(content_preview, '[\p{{L}}\p{{N}}_]+')) AS name FROM n WHERE type = 'doc_section'),
c AS (SELECT DISTINCT name FROM n WHERE type IN ('class', 'struct', 'function'))
SELECT part_id, name, count(*) AS n FROM w JOIN c USING (name) WHERE regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') AND length(name) >= 4 GROUP BY ALL""")
def content_scan(spark, d):
    """Names of code in sections (J-15)."""
    parts = sections(spark, d, "content_preview").select(F.col("id").alias("part_id"), F.col("content_preview").alias("text"))
    return docs.content_mentions(parts, nodes(spark, d, "type", "name").where("type IN ('class', 'struct', 'function')"))


@query(f"""WITH {N}, c AS (SELECT DISTINCT name FROM n WHERE type IN ('class', 'struct') AND length(name) >= 4)
SELECT DISTINCT n.id AS part_id, c.name FROM n JOIN c ON contains(n.heading, c.name) WHERE type = 'doc_section'""")
def title_rule(spark, d):
    """Classes whose name is part of a section's heading (J-14)."""
    titles = sections(spark, d, "heading").select(F.col("id").alias("part_id"), F.col("heading").alias("title"))
    return docs.title_mentions(titles, nodes(spark, d, "type", "name").where("type IN ('class', 'struct')"))


@query(doc_sql.associations(N))
def associations(spark, d):
    """Edges between sections and the classes that their headings or contents name, both ways (U-17)."""
    code = nodes(spark, d, "type", "name").where("type IN ('class', 'struct')").select(F.col("id").alias("code_id"), "name")
    found = sections(spark, d, "heading", "content_preview")
    inside = docs.content_mentions(found.select(F.col("id").alias("part_id"), F.col("content_preview").alias("text")), code).select("part_id", "name", F.lit(0.6).alias("confidence"), F.lit("content").alias("method"))
    titled = docs.title_mentions(found.select(F.col("id").alias("part_id"), F.col("heading").alias("title")), code).select("part_id", "name", F.lit(0.8).alias("confidence"), F.lit("title").alias("method"))
    return docs.association_edges(inside.unionByName(titled).join(code, "name").select(F.col("part_id").alias("doc_id"), "code_id", "confidence", "method"))


@query(doc_sql.REPAIRED_LINKS)
def repaired_links(spark, d):
    """Links between documents, dangling ones led to the only document that fits or dropped (D-10, J-30)."""
    rows = table(spark, d, "documents")
    links = docs.document_edges(rows).where("rel = 'relates_to'").select("src", "dst").distinct()
    return docs.repair_links(links, docs.document_nodes(rows).where("key IS NOT NULL").select("key").distinct())


@query(doc_sql.missing_symbols(N))
def missing_symbols(spark, d):
    """Symbols that documents mention and no code has (D-11, U-21)."""
    code = nodes(spark, d, "type", "name").where("type IN ('class', 'struct', 'function')")
    return docs.missing_symbols(docs.document_edges(table(spark, d, "documents")), code.select(F.concat(F.lit("symbol:"), "name").alias("key")))


_DOCS = f"""WITH {NE}, both_ AS (SELECT src AS code_id, dst AS doc_id, confidence FROM e WHERE relation_type = 'code_refers_to_doc'
  UNION ALL SELECT dst, src, confidence FROM e WHERE relation_type = 'doc_describes_code'),
about AS (SELECT code_id, doc_id, max(coalesce(confidence, 0)) AS confidence FROM both_ WHERE doc_id IN (SELECT id FROM n WHERE type = 'doc_section') GROUP BY ALL)"""
_DOC_REL = ["code_refers_to_doc", "doc_describes_code"]


@query(f"{_DOCS} SELECT * FROM about")
def docs_for_code(spark, d):
    """Sections about every piece of code, over both directions (J-22, O-05, O-06)."""
    return docs.docs_for_code(edges(spark, d, "confidence", relations=_DOC_REL), sections(spark, d))


@query(f"""{_DOCS} SELECT n.id, n.name, n.type, count(doc_id) AS n_docs, count(doc_id) FILTER (confidence >= 0.7) AS n_sure
FROM n LEFT JOIN about ON code_id = n.id WHERE type IN ('class', 'struct', 'function') GROUP BY ALL""")
def code_coverage(spark, d):
    """Every class and function with the number of sections about it (R-11..R-13, A-13)."""
    about = docs.docs_for_code(edges(spark, d, "confidence", relations=_DOC_REL), sections(spark, d))
    per = about.groupBy(F.col("code_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.7).alias("s"))
    code = nodes(spark, d, "name", "type").where("type IN ('class', 'struct', 'function')")
    zero = F.lit(0).cast("long")
    return code.join(per, "id", "left").select("id", "name", "type", F.coalesce("n", zero).alias("n_docs"), F.coalesce("s", zero).alias("n_sure"))


@query(rf"""{_DOCS}, rest AS (SELECT id, name FROM n WHERE type IN ('class', 'struct') AND id NOT IN (SELECT code_id FROM about)),
w AS (SELECT id AS doc_id, unnest(regexp_extract_all(content_preview, '[\p{{L}}\p{{N}}_]+')) AS name FROM n WHERE type = 'doc_section'),
c AS (SELECT doc_id, name, count(*) AS k FROM w WHERE length(name) >= 4 AND regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') GROUP BY ALL),
hit AS (SELECT rest.id AS code_id, doc_id FROM rest JOIN c USING (name) QUALIFY row_number() OVER (PARTITION BY rest.id ORDER BY k DESC, doc_id) <= 3)
SELECT code_id, doc_id, confidence, 'link' AS source FROM about WHERE code_id IN (SELECT id FROM n WHERE type IN ('class', 'struct'))
UNION ALL SELECT code_id, doc_id, 0.6, 'word' FROM hit""")
def class_docs(spark, d):
    """Sections of every class: linked ones, else those that have its name (R-11)."""
    about = docs.docs_for_code(edges(spark, d, "confidence", relations=_DOC_REL), sections(spark, d))
    classes = nodes(spark, d, "type", "name").where("type IN ('class', 'struct')").select("id", "name")
    return questions.code_with_documents(classes, about, sections(spark, d, "content_preview").select("id", F.col("content_preview").alias("text")))


@query("""SELECT doc_id, title, updated_at FROM documents WHERE doc_type = 'review' AND (contains(lower(title), 'reader') OR contains(lower(path), 'reader'))
ORDER BY updated_at DESC NULLS LAST, doc_id LIMIT 50""")
def list_documents(spark, d):
    """The latest reviews with a word in their title or path (P-18)."""
    rows = table(spark, d, "documents").select("doc_id", "title", "path", F.col("doc_type").alias("type"), F.col("updated_at").alias("date"))
    return questions.list_documents(rows, "review", "reader").select("doc_id", "title", F.col("date").alias("updated_at"))


@query(f"""WITH {E} SELECT a.src, a.dst, a.relation_type FROM (SELECT DISTINCT src, dst, relation_type FROM e) a
WHERE relation_type IN ('code_refers_to_doc', 'doc_describes_code') AND NOT EXISTS (FROM e b WHERE b.src = a.dst AND b.dst = a.src AND b.relation_type <> a.relation_type
  AND b.relation_type IN ('code_refers_to_doc', 'doc_describes_code'))""")
def one_way_links(spark, d):
    """Document edges without their counterpart (O-07)."""
    return docs.one_way_edges(edges(spark, d, relations=_DOC_REL)).distinct()


_HITS = "(" + " + ".join(f"(coalesce(contains(lower(name), '{w}'), false) OR coalesce(contains(lower(doc_title), '{w}'), false) OR coalesce(contains(lower(content_preview), '{w}'), false))::INT" for w in ("queue", "lock", "retry")) + ")"


@query(f"""WITH {N}, h AS (SELECT id, name, {_HITS} AS hits, start_line FROM n WHERE type = 'doc_section')
SELECT id, name, hits FROM h WHERE hits > 0 ORDER BY hits DESC, start_line NULLS FIRST, id LIMIT 20""")
def doc_search(spark, d):
    """Sections by the number of words they have of a query (R-01, A-11, T-02)."""
    s = sections(spark, d, "name", "doc_title", "content_preview", "start_line")
    hit = retrieval.word_hits(s, ["queue", "lock", "retry"], ["name", "doc_title", "content_preview"])
    return hit.orderBy(F.desc("hits"), F.asc_nulls_first("start_line"), "id").limit(20).select("id", "name", "hits")


@query(f"WITH {N} SELECT tag, count(*) AS n_sections, sum(word_count)::BIGINT AS n_words FROM (SELECT unnest(tags) AS tag, word_count FROM n WHERE type = 'doc_section') GROUP BY 1")
def tag_counts(spark, d):
    """Sections and words per tag (P-16, F-07)."""
    s = sections(spark, d, "tags", "word_count").select(F.explode("tags").alias("tag"), "word_count")
    return s.groupBy("tag").agg(F.count("*").alias("n_sections"), F.sum("word_count").alias("n_words"))


_TERMS = r"list_transform(regexp_extract_all(regexp_replace(regexp_replace(replace(text, '_', ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([\x{4E00}-\x{9FFF}])', ' \1 ', 'g'), '[\x{4E00}-\x{9FFF}]|\p{L}+|\d+'), lambda x: lower(x))"


@query(f"""WITH d AS (SELECT doc_id AS key, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM d), p AS (SELECT key, len(terms) AS size, unnest(terms) AS term FROM d),
h AS (SELECT key, size, term, count(*) AS tf FROM p WHERE term IN ('condition', 'variable', 'polling') GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
r AS (SELECT key, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM h JOIN f USING (term), st GROUP BY 1)
SELECT key, round(score, 4) AS score FROM r""")
def bm25(spark, d):
    """All documents with words of a query, by BM25 (R-02, F-22..F-24)."""
    texts = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("key"), "text")
    return retrieval.bm25(texts, "condition variable polling").select("key", F.round("score", 4).alias("score"))


@query(doc_sql.DOCUMENT_SEARCH)
def document_search(spark, d):
    """Start documents of a query by three routes over their titles, summaries, paths and tags, and rank fusion (R-02..R-05, W-02..W-04)."""
    rows = table(spark, d, "documents")
    items = cut(docs.document_nodes(rows).select(F.col("doc_id").alias("key"), *retrieval.FIELDS))
    mentions = docs.document_edges(rows).where("rel = 'mentions_symbol'").select(F.col("src").alias("key"), F.col("dst").alias("name"))
    return retrieval.document_search(items, mentions, "Reader", 10)


@query(doc_sql.DOCUMENT_REACH)
def document_reach(spark, d):
    """Documents and symbols within two links of the ten documents with the most links (G-27)."""
    rows = table(spark, d, "documents")
    keys = docs.document_nodes(rows).select(F.col("doc_id").alias("src"), "key")
    found = cut(docs.document_edges(rows).join(keys, "src").select(F.col("key").alias("src"), "dst", "rel"))
    starts = found.groupBy("src").count().orderBy(F.desc("count"), "src").limit(10).select(F.col("src").alias("key"))
    return retrieval.reach_documents(starts, found, 2)


# --- vectors -----------------------------------------------------------------------------------------


@query("""SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 3) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3""")
def similar_vectors(spark, d):
    """All vectors close to each vector whose id is divisible by 50, exactly (J-17, R-08, F-41)."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return retrieval.nearest(v.where("id % 50 = 0"), v, 0.3).select("a_id", "b_id", F.round("similarity", 3).alias("similarity"))


@query("""SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 3) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.45""")
def similar_pairs(spark, d):
    """All pairs of vectors with the reference's threshold of similarity, exactly (J-17, R-14)."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return retrieval.similar_pairs(v, v, 0.45).select("a_id", "b_id", F.round("similarity", 3).alias("similarity"))


# --- telemetry ---------------------------------------------------------------------------------------


def telemetry(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("ts", F.col("event_type").alias("tool"), "user_id", F.get_json_object("props", "$.k").cast("int").alias("n_results"), F.col("value").alias("duration_ms"))


@query("""SELECT tool, count(*) AS n, count(*) FILTER (k = 0) AS n_empty, round(count(*) FILTER (k = 0) / count(*), 4) AS empty_share, round(avg(value), 4) AS mean_ms,
round(list_sort(list(value))[least(floor(count(*) * 95 / 100)::INT, count(*) - 1) + 1], 4) AS p95_ms
FROM (SELECT event_type AS tool, (props ->> '$.k')::INT AS k, value FROM events) GROUP BY 1""")
def tool_usage(spark, d):
    """Calls, empty results and times per tool (A-03, S-17)."""
    return stats.tool_usage(telemetry(spark, d))


@query("SELECT event_type AS tool, user_id, count(*) AS n FROM events WHERE (props ->> '$.k')::INT = 0 GROUP BY ALL ORDER BY n DESC, tool, user_id LIMIT 10")
def empty_results(spark, d):
    """The most frequent calls without a result (A-04)."""
    return stats.top_counts(telemetry(spark, d).where("n_results = 0"), ["tool", "user_id"], 10)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type AS tool, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def hourly_events(spark, d):
    """Tumbling windows of an hour per tool (C-10)."""
    w = telemetry(spark, d).groupBy(F.window("ts", "1 hour"), "tool").agg(F.count("*").alias("n"), F.round(F.sum("duration_ms"), 3).alias("total"))
    return w.select(F.col("window.start").alias("hour"), "tool", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, (ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS first, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, d):
    """Sessions of users that end after six quiet hours (C-10)."""
    w = telemetry(spark, d).groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("first"), "n")


# --- findings ----------------------------------------------------------------------------------------


def finding_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents taken as findings: the title is the key, names in code marks are the anchors."""
    return table(spark, d, "documents").where("title IS NOT NULL").select(
        "title", F.col("text").alias("detail"), F.lit("fact").alias("ftype"), t.backtick_symbols(F.coalesce("text", F.lit(""))).alias("symbols"), "source", F.lit("confirmed").alias("confidence"),
        F.array("doc_type").alias("tags"), "updated_at", F.lit(None).cast("array<float>").alias("embedding"),
    )


def finding_store(spark: SparkSession, d: str) -> DataFrame:
    return findings.upsert(spark.createDataFrame([], findings.SCHEMA), finding_rows(spark, d))


@query("SELECT trim(title) AS title, min(updated_at) AS created_at, max(updated_at) AS updated_at, 'active' AS status FROM documents WHERE trim(title) <> '' GROUP BY 1")
def finding_upsert(spark, d):
    """The latest finding of each title (U-14, W-13)."""
    return finding_store(spark, d).select("title", "created_at", "updated_at", "status")


@query(doc_sql.freshness(N))
def finding_freshness(spark, d):
    """Findings whose names of code are all gone (U-15, J-21)."""
    store = cut(finding_store(spark, d))
    return findings.freshness(store, nodes(spark, d, "type", "name")).select("id", "before", "after", F.size("missing").alias("n_missing"))


@query(doc_sql.FINDING_SEARCH)
def finding_search(spark, d):
    """Findings by words and synonyms, the latest first (R-06..R-09)."""
    return findings.search(cut(finding_store(spark, d)), "deadlock queue", 10, {"deadlock": ["lock", "wait"]})
