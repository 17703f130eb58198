"""Questions that combine several operators: lists, documents of code, search with its surroundings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import text as t
from lodegraph.operators import documents as docs
from lodegraph.operators import findings, retrieval
from lodegraph.operators.graph import first_by
from lodegraph.runtime import cut


def by_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with one of ``ids(id)`` (P-01, P-02)."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def list_documents(documents: DataFrame, kind: str | None = None, part: str | None = None, limit: int = 50) -> DataFrame:
    """Documents of a type and with a part in their title or path, the latest first (P-18)."""
    rows = documents.where(F.col("type") == kind) if kind else documents
    if part:
        rows = rows.where(F.coalesce(t.contains_like("title", part), F.lit(False)) | F.coalesce(t.contains_like("path", part), F.lit(False)))
    return rows.orderBy(F.desc_nulls_last("date"), "doc_id").limit(limit)


def definition_first(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """One node per name: one in a source file before one in a header, then the first by file, line and id (W-08)."""
    source = F.when(F.coalesce(F.col("file_path").rlike(r"\.(cpp|cc|cxx|c)$"), F.lit(False)), 0).otherwise(1)
    return first_by(nodes, keys, source, F.asc_nulls_last("file_path"), F.asc_nulls_last("start_line"), F.col("id"))


def shared_grams(names: DataFrame, folders: DataFrame, size: int = 4) -> DataFrame:
    """``names(name)`` that share ``size`` letters in a row with one of ``folders(folder)``, without regard to case and ``_`` (P-21, J-13)."""
    def grams(c: str):
        s = F.lower(F.replace(F.col(c), F.lit("_"), F.lit("")))
        places = F.when(F.length(s) >= size, F.sequence(F.lit(1), F.length(s) - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(s, i, F.lit(size))))).alias("gram")

    have = folders.select(grams("folder")).distinct()
    return names.select("name", grams("name")).join(have, "gram", "left_semi").select("name").distinct()


def code_with_documents(code: DataFrame, about: DataFrame, sections: DataFrame, most: int = 3) -> DataFrame:
    """``(code_id, doc_id, confidence, source)``: sections of each of ``code(id, name)`` (R-11..R-13).

    Those linked to it; where there are none, up to ``most`` sections whose text has its name as a whole
    word, with confidence 0.6. ``sections(id, text)``.
    """
    linked = about.join(code.select(F.col("id").alias("code_id")), "code_id", "left_semi").select("code_id", "doc_id", "confidence", F.lit("link").alias("source"))
    rest = cut(code.join(about.select(F.col("code_id").alias("id")).distinct(), "id", "left_anti"))
    found = docs.content_mentions(sections.select(F.col("id").alias("part_id"), "text"), rest)
    hit = rest.select(F.col("id").alias("code_id"), "name").join(found, "name")
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("code_id").orderBy(F.desc("n"), "part_id"))
    word = hit.withColumn("place", place).where(F.col("place") <= most).select("code_id", F.col("part_id").alias("doc_id"), F.lit(0.6).alias("confidence"), F.lit("word").alias("source"))
    return linked.unionByName(word)


def surroundings(
    texts: DataFrame, mentions: DataFrame, links: DataFrame, nodes: DataFrame, query: str, limit: int = 3, depth: int = 2, edges: DataFrame | None = None, store: DataFrame | None = None
) -> dict[str, DataFrame]:
    """A query's start documents, what they reach, the code that the symbols on the way are, and findings (R-10).

    ``texts(key, title, summary, path, tags)``, ``mentions(key, name)``, ``links(src, dst, rel, manual)``;
    declared symbols come before found ones, then by hop and name. The first ten are looked up as code,
    with callers and callees where ``edges`` are given; findings of a ``store`` are the first five of the
    query and those with one of the first 30 symbols, or of the code found, as an anchor.
    """
    starts = cut(retrieval.document_search(texts, mentions, query, limit))
    reached = cut(retrieval.reach_documents(starts.select("key"), links, depth))
    near = reached.groupBy("node").agg(F.min("hop").alias("hop"))
    declared = links.where("rel = 'mentions_symbol' AND manual").select(F.col("dst").alias("node"), F.lit(0).alias("found")).distinct()
    symbols = near.where("node LIKE 'symbol:%'").join(declared, "node", "left")
    symbols = cut(symbols.select(F.regexp_replace("node", "^symbol:", "").alias("symbol"), "hop", F.coalesce("found", F.lit(1)).alias("found")).orderBy("found", "hop", "symbol").limit(30))
    code = cut(retrieval.bridge_symbols(symbols.orderBy("found", "hop", "symbol").limit(10), nodes))
    out = {"starts": starts, "reached": near, "symbols": symbols, "code": retrieval.bridge_calls(code, edges, nodes) if edges is not None else code}
    if store is not None:
        names = nodes.join(code.select(F.col("node_id").alias("id")).distinct(), "id", "left_semi").select(F.col("name").alias("symbol"))
        anchored = [r[0] for r in symbols.select("symbol").union(names).distinct().collect()]  # 30 + 50 at most
        asked = findings.search(store, query, 5).select("id")
        found = findings.by_symbols(store, anchored).select("id") if anchored else asked
        out["findings"] = findings.in_display_order(store.join(asked.union(found).distinct(), "id", "left_semi"))
    return out
