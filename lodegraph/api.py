"""One object per graph, with a method per question; names and limits are arguments.

``CodeGraph`` holds current nodes, distinct edges and includes, ``DocGraph`` documents. All answers are
DataFrames.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import text as t
from lodegraph.operators import code, findings, graph, questions, retrieval, stats
from lodegraph.operators import documents as docs
from lodegraph.plans import views
from lodegraph.runtime import cut, table

NODE_COLUMNS = (
    "type", "name", "namespace", "file_path", "start_line", "end_line", "is_abstract", "is_virtual", "is_pure_virtual", "access", "parent_class", "signature", "param_types",
    "doc_title", "heading", "content_preview", "tags", "word_count",
)


class CodeGraph:
    """A code graph: ``nodes(id, ...)``, ``edges(src, dst, relation_type, line, edge_id, ...)``, ``includes``."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, includes: DataFrame):
        self.nodes, self.edges, self.includes = nodes, edges, includes

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CodeGraph:
        """From a folder with the tables node, edge and include_dep."""
        return cls(cut(views.nodes(spark, path, *NODE_COLUMNS)), cut(views.edges(spark, path, "alias_name", "confidence")), cut(code.clean_includes(table(spark, path, "include_dep"))))

    def _named(self, kind: tuple[str, ...], name: str, exact: bool = False) -> DataFrame:
        rows = self.nodes.where(F.col("type").isin(*kind))
        hit = rows.where(F.col("name") == name)
        return hit if exact or not hit.isEmpty() else rows.where(t.contains_like("name", name))

    def search_class(self, name: str, exact: bool = False, limit: int = 100) -> DataFrame:
        """Classes of a name, else structs; exact, else with the name as a part (P-04)."""
        hit = self._named(("class",), name, exact)
        return (self._named(("struct",), name, exact) if hit.isEmpty() else hit).orderBy("name", "id").limit(limit)

    def search_function(self, name: str, cls: str | None = None, limit: int = 100) -> DataFrame:
        """Functions of a name, of a class or namespace if given (P-05)."""
        hit = self._named(("function",), name)
        if cls:
            hit = hit.where(F.coalesce((code.name_tail("namespace") == cls) | F.col("namespace").contains(cls), F.lit(False)))
        return hit.orderBy("name", "id").limit(limit)

    def file_symbols(self, path: str) -> DataFrame:
        """Symbols of files whose path has a part (P-06)."""
        return self.nodes.where(t.contains_like("file_path", path)).orderBy("file_path", "start_line", "id")

    def _seeds(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").alias("seed"), F.col("id").alias("node"))

    def _with_names(self, found: DataFrame, key: str = "node") -> DataFrame:
        return found.join(self.nodes.select(F.col("id").alias(key), "name", "namespace", "file_path", "start_line"), key)

    def inheritance(self, cls: str, direction: str = "ancestors", depth: int = 0) -> DataFrame:
        """Ancestors or descendants of a class with their depth; 0 is unlimited (G-01, G-02)."""
        up = code.inherits(self.edges).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
        arcs = up if direction == "ancestors" else up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return self._with_names(graph.closure(self._seeds(self.search_class(cls)), arcs, depth, include_seeds=False))

    def diamonds(self) -> DataFrame:
        return code.diamonds(self.edges)

    def _functions(self, name: str, cls: str | None) -> DataFrame:
        return cut(self.search_function(name, cls).select(F.col("id")))

    def callers(self, name: str, cls: str | None = None, kind: str | None = None, expand: bool = True) -> DataFrame:
        """Callers of a function; with ``expand`` also of functions it overrides, called virtually (G-04).

        The latter only where a class is given, else any function of the name would count.
        """
        ids = self._functions(name, cls)
        direct = code.call_sites(self.edges, self.nodes, t.call_types(kind)).join(ids.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi")
        if not expand or not cls:
            return direct
        over = code.override_closure(self.edges).join(ids.withColumnRenamed("id", "derived"), "derived", "left_semi").select(F.col("base").alias("callee_id")).distinct()
        more = code.call_sites(self.edges, self.nodes, ["calls_virtual"]).join(over, "callee_id", "left_semi").withColumn("call_type", F.lit("calls_virtual_expanded"))
        return direct.unionByName(more)

    def callees(self, name: str, cls: str | None = None, expand: bool = True) -> DataFrame:
        """Callees of a function; with ``expand`` also the overrides of those called virtually (G-05)."""
        ids = self._functions(name, cls).withColumnRenamed("id", "src")
        calls = code.expanded_calls(self.edges) if expand else code.of(self.edges, *code.CALLS).select("src", "dst", F.col("relation_type").alias("via"))
        return self._with_names(calls.join(ids, "src", "left_semi").withColumnRenamed("dst", "node"))

    def call_chain(self, name: str, cls: str | None = None, direction: str = "up", depth: int = 3) -> DataFrame:
        """Functions within ``depth`` calls, up to callers or down to callees (G-06)."""
        return self._with_names(code.call_chain(self._seeds(self._functions(name, cls)), self.edges.where(F.col("relation_type").isin(code.CALLS)), direction, depth))

    def overrides(self, name: str, cls: str | None = None) -> DataFrame:
        """All overrides of a function (G-07, G-14)."""
        ids = self._functions(name, cls).withColumnRenamed("id", "base")
        return self._with_names(code.override_closure(self.edges).join(ids, "base", "left_semi").withColumnRenamed("derived", "node"))

    def virtual_table(self, cls: str) -> DataFrame:
        return code.virtual_table(self.edges, self.nodes).join(self.search_class(cls).select(F.col("id").alias("class_id")), "class_id", "left_semi")

    def implementations(self, interface: str, include_abstract: bool = False) -> DataFrame:
        ids = self.search_class(interface).select(F.col("id").alias("interface"))
        return self._with_names(code.implementations(self.edges, self.nodes, include_abstract).join(ids, "interface", "left_semi").withColumnRenamed("class_id", "node"))

    def traverse(self, names: list[str], relations: list[str] | None = None, direction: str = "outgoing", depth: int = 2, mode: str = "bfs", max_results: int = 50) -> DataFrame:
        """What some nodes lead to, breadth first or (from one node) depth first (G-15, G-16)."""
        if not 1 <= depth <= 20:
            raise ValueError(f"depth: {depth}")
        start = self.nodes.where(F.col("name").isin(names)).select(F.col("id").alias("node"))
        arcs = graph.orient(self.edges, direction, relations)
        if mode == "dfs":
            first = start.orderBy("node").first()
            return self._with_names(graph.depth_first(first["node"] if first else -1, arcs, depth))
        return self._with_names(graph.traverse(start, arcs, depth, max_results)[0])

    def include_impact(self, *files: str) -> DataFrame:
        """Files to handle again when files change (G-23, G-28)."""
        return code.include_impact(self.includes, self.includes.sparkSession.createDataFrame([(f,) for f in files], "file string"))

    def include_tree(self, file: str, depth: int = 5, skip_system: bool = True) -> DataFrame:
        return code.include_tree(self.includes, self.includes.sparkSession.createDataFrame([(file,)], "file string"), depth, skip_system)

    def aliases(self, name: str) -> DataFrame:
        return code.aliases(self.edges, self.nodes).where(F.col("target_name") == name)

    def blast_radius(self, symbols: list[str] | None = None, files: list[str] | None = None, depth: int = 3, direction: str = "up", max_nodes: int = 500, **options) -> DataFrame:
        """What a change of symbols (``f`` or ``Class::f``) or files affects: the nearest ``max_nodes`` (G-18, T-04)."""
        hit = F.lit(False)
        for s in symbols or []:
            name, owner = s.rsplit("::", 1)[-1], s.rsplit("::", 1)[0] if "::" in s else None
            one = F.col("name") == name
            hit = hit | (one & ((F.col("parent_class") == owner) | F.col("namespace").endswith(owner)) if owner else one)
        for f in files or []:
            hit = hit | F.col("file_path").contains(f)
        seeds = self.nodes.where(F.coalesce(hit, F.lit(False)) & F.col("type").isin("class", "struct", "function")).select(F.lit(0).cast("long").alias("seed"), F.col("id").alias("node"))
        return code.blast_radius(self.edges, self.nodes, cut(seeds), depth, direction, **options).orderBy("depth", "file_path", "name", "node").limit(max_nodes)

    def search_docs(self, query: str, tag: str | None = None, limit: int = 20, min_confidence: float = 0.0) -> DataFrame:
        """Sections by the number of a query's words they have, with the code they describe (R-01, J-23)."""
        words = query.split()
        s = self.nodes.where("type = 'doc_section'")
        if tag:
            s = s.where(F.array_contains("tags", tag))
        if not words:
            return s.limit(0)
        hit = retrieval.word_hits(s, words, ["name", "doc_title", "content_preview"]).orderBy(F.desc("hits"), F.asc_nulls_first("start_line"), "id").limit(limit)
        about = docs.docs_for_code(self.edges, s).where(F.col("confidence") >= min_confidence).join(self.nodes.select(F.col("id").alias("code_id"), F.col("name").alias("code")), "code_id")
        per = about.groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_set("code")).alias("related_code"))
        return hit.join(per, "id", "left").select("id", "name", "doc_title", "file_path", "start_line", "hits", "related_code")

    def code_docs(self, name: str, most: int = 3) -> DataFrame:
        """Sections about classes and functions of a name (R-11..R-13)."""
        s = self.nodes.where("type = 'doc_section'")
        hit = cut(self._named(("class", "struct", "function"), name).select("id", "name"))
        return questions.code_with_documents(hit, docs.docs_for_code(self.edges, s), s.select("id", F.col("content_preview").alias("text")), most)

    def stats(self) -> DataFrame:
        return stats.distribution(self.nodes, "type").unionByName(stats.distribution(self.edges, "relation_type"))


class DocGraph:
    """Documents ``(doc_id, path, text, title, updated_at)``, their links and symbols, and findings."""

    def __init__(self, documents: DataFrame, nodes: DataFrame | None = None, store: DataFrame | None = None, edges: DataFrame | None = None):
        self.documents, self.nodes, self.edges = documents, nodes, edges
        self.findings = store if store is not None else documents.sparkSession.createDataFrame([], findings.SCHEMA)

    @cached_property
    def items(self) -> DataFrame:
        return cut(docs.document_nodes(self.documents))

    @cached_property
    def links(self) -> DataFrame:
        e = docs.document_edges(self.documents).withColumnRenamed("src", "doc_id").join(self.items.select("doc_id", "key"), "doc_id")
        return cut(e.select(F.col("key").alias("src"), "dst", "rel", "manual"))

    def _texts(self) -> tuple[DataFrame, DataFrame]:
        mentions = self.links.where("rel = 'mentions_symbol'").select(F.col("src").alias("key"), F.regexp_replace("dst", "^symbol:", "").alias("name"))
        return self.items.select("key", *retrieval.FIELDS), mentions

    def search(self, query: str, limit: int = 5, depth: int = 2) -> dict[str, DataFrame]:
        """Start documents, what they reach, and code and findings of the symbols on the way (R-10)."""
        texts, mentions = self._texts()
        empty = "id long, name string, type string, parent_class string, namespace string"
        nodes = self.nodes if self.nodes is not None else self.documents.sparkSession.createDataFrame([], empty)
        return questions.surroundings(texts, mentions, self.links, nodes, query, limit, depth, self.edges, self.findings)

    def list(self, kind: str | None = None, part: str | None = None, limit: int = 50) -> DataFrame:
        return questions.list_documents(self.items, kind, part, limit)

    def knowledge(self) -> DataFrame:
        return docs.knowledge_nodes(self.documents)

    def record(self, incoming: DataFrame) -> None:
        """Takes findings in by title."""
        self.findings = cut(findings.upsert(self.findings, incoming))

    def search_findings(self, query: str = "", **options) -> DataFrame:
        return findings.search(self.findings, query, **options)

    def check_freshness(self) -> DataFrame:
        return findings.freshness(self.findings, self.nodes)

    def stats(self) -> DataFrame:
        """Documents by type, links by relation and findings by status (A-02)."""
        return stats.distribution(self.items, "type").unionByName(stats.distribution(self.links, "rel")).unionByName(stats.distribution(self.findings, "status", "ftype"))
