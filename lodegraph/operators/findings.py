"""A store of findings: upsert by title, search, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import text as t
from lodegraph.operators.retrieval import expand_query, fuse, ranked, synonym_pairs
from lodegraph.runtime import cut

TYPES = ("fact", "decision", "pitfall", "pattern", "todo")
SCHEMA = (
    "id string, ftype string, title string, detail string, symbols array<string>, source string, status string, confidence string, "
    "tags array<string>, created_at timestamp, updated_at timestamp, embedding array<float>"
)


def upsert(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store after findings ``incoming`` (all columns of ``SCHEMA`` but id, status and created_at) are written (U-14, W-13).

    The title is the key: the latest incoming row of a title replaces the stored one but for its id,
    status and first time. Rows without a title are refused (``rejected`` lists them). Anchors are the
    distinct symbols, sorted.
    """
    new = incoming.where("trim(coalesce(title, '')) <> ''").withColumn("title", F.trim("title"))
    anchors = F.array_sort(F.array_distinct(F.filter(F.coalesce("symbols", F.array().cast("array<string>")), lambda s: F.trim(s) != "")))
    pack = ["ftype", "detail", "symbols", "source", "confidence", "tags", "embedding"]
    new = new.withColumn("symbols", anchors).groupBy("title").agg(F.min("updated_at").alias("first"), F.max(F.struct("updated_at", *pack)).alias("m"))
    old = store.select("title", F.col("id").alias("old_id"), F.col("status").alias("old_status"), F.col("created_at").alias("old_created"))
    joined = new.join(old, "title", "left")
    written = joined.select(
        F.coalesce("old_id", t.finding_id("title", F.col("first"))).alias("id"), "m.ftype", "title", "m.detail", "m.symbols", "m.source",
        F.coalesce("old_status", F.lit("active")).alias("status"), "m.confidence", "m.tags", F.coalesce("old_created", "first").alias("created_at"), "m.updated_at", "m.embedding",
    )
    return store.join(new.select("title"), "title", "left_anti").select(written.columns).unionByName(written)


def rejected(incoming: DataFrame, types: tuple[str, ...] = TYPES, confidences: tuple[str, ...] = ("confirmed", "tentative")) -> DataFrame:
    """Incoming findings without a title or with an unknown type or confidence (P-24)."""
    bad = (F.trim(F.coalesce("title", F.lit(""))) == "") | ~F.coalesce(F.col("ftype").isin(*types), F.lit(False)) | ~F.coalesce(F.col("confidence").isin(*confidences), F.lit(False))
    return incoming.where(bad)


def anchors(store: DataFrame) -> DataFrame:
    """``(finding_id, symbol)`` of all findings."""
    return store.select(F.col("id").alias("finding_id"), F.explode("symbols").alias("symbol")).distinct()


def by_symbols(store: DataFrame, symbols: list[str], limit: int = 10) -> DataFrame:
    """Findings with an anchor that is one of the symbols or a member of one, the latest first (J-20, P-17)."""
    hit = F.lit(False)
    for s in symbols:
        hit = hit | (F.col("symbol") == s) | F.col("symbol").startswith(s + "::")
    ids = anchors(store).where(hit).select(F.col("finding_id").alias("id")).distinct()
    return store.join(ids, "id", "left_semi").orderBy(F.desc("updated_at"), "id").limit(max(3 * limit, 10))


def search(store: DataFrame, query: str, limit: int = 10, synonyms: dict[str, list[str]] | None = None, vector: list[float] | None = None, statuses: tuple[str, ...] = ("active", "stale"), ftype: str | None = None, depth: int = 1000) -> DataFrame:
    """Findings with any term of the query or a synonym; a vector only reorders them (R-07..R-09, T-07, T-08).

    ``(id, score, routes, place)``; without a query the latest come first. As a report of the best
    ``limit``, the route by words goes ``depth`` findings deep, so a ranking is never longer.
    """
    rows = store.where(F.col("status").isin(*statuses))
    if ftype:
        rows = rows.where(F.col("ftype") == ftype)
    if not query.strip():
        return ranked(rows.withColumnRenamed("id", "key").orderBy(F.desc("updated_at")).limit(limit), "latest", F.desc("updated_at"), F.col("key")).select(F.col("key").alias("id"), F.lit(0.0).alias("score"), F.col("route").alias("routes"), (F.col("rank") + 1).alias("place"))
    spark = store.sparkSession
    wanted = [r[0] for r in spark.createDataFrame([(" ".join([query, *(expand_query(synonym_pairs(spark, synonyms), query) if synonyms else ())]),)], "q string").select(F.explode(F.array_distinct(t.terms("q")))).collect()]
    text = F.concat_ws(" ", "title", "detail", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    hits = cut(rows.where(F.arrays_overlap(t.terms(text), F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>"))).withColumnRenamed("id", "key"))
    routes = ranked(hits.orderBy(F.desc("updated_at"), "key").limit(depth), "words", F.desc("updated_at"), F.col("key"))
    if vector is not None:
        q = F.array(*(F.lit(float(x)) for x in vector))
        near = hits.where("embedding IS NOT NULL").withColumn("sim", t.dot(t.unit("embedding"), t.unit(q)))
        routes = routes.unionByName(ranked(near.orderBy(F.desc("sim"), "key").limit(2 * limit), "vector", F.desc("sim"), F.col("key")))
    return fuse(routes, limit).where(F.col("place") <= limit).withColumnRenamed("key", "id")


def in_display_order(found: DataFrame) -> DataFrame:
    """Active findings before others, each the oldest first (T-06)."""
    return found.orderBy(F.when(F.col("status") == "active", 0).otherwise(1), "updated_at", "id")


def known_symbols(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(symbol, known)`` for each of ``names(symbol)``: whether the code has it (J-21).

    It does if a class, struct or function has its last part as name, or as part of its name: a wrongly
    outdated finding costs more than one that stays too long. Names are compared by trigrams, so no
    pair of all names and nodes is formed.
    """
    s = names.select("symbol").distinct().withColumn("short", t.tail(F.regexp_replace("symbol", "^symbol:", "")))
    code = nodes.select(F.lower("name").alias("name")).where("name IS NOT NULL").distinct()
    exact = s.join(nodes.where("type IN ('class', 'struct', 'function')").select(F.col("name").alias("short")).distinct(), "short", "left_semi").select("symbol")
    rest = s.join(exact, "symbol", "left_anti")
    size = F.length("name")
    places = F.when(size >= 3, F.sequence(F.lit(1), size - 2)).otherwise(F.array().cast("array<int>"))
    grams = code.select("name", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("name"), i, F.lit(3))))).alias("gram"))
    part = rest.withColumn("low", F.lower("short")).withColumn("gram", F.substring("low", 1, 3)).join(grams, "gram").where(F.col("name").contains(F.col("low"))).select("symbol")
    known = exact.union(part).distinct().withColumn("known", F.lit(True))
    return s.select("symbol").join(known, "symbol", "left").select("symbol", F.coalesce("known", F.lit(False)).alias("known"))


def freshness(store: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, before, after, missing)``: findings whose status changes (U-15).

    Active ones become stale when all their anchors that can be names of code are gone, stale ones
    active when any is back. Other anchors, and findings without such anchors, are left alone.
    """
    mine = anchors(store.where("status IN ('active', 'stale')")).where(t.is_code_symbol("symbol"))
    known = known_symbols(mine, nodes)
    per = mine.join(known, "symbol").groupBy("finding_id").agg(F.bool_or("known").alias("any"), F.array_sort(F.collect_set(F.when(~F.col("known"), F.col("symbol")))).alias("missing"))
    joined = store.select("id", "status").join(per, store["id"] == per["finding_id"])
    after = F.when((F.col("status") == "active") & ~F.col("any"), "stale").when((F.col("status") == "stale") & F.col("any"), "active")
    return joined.select("id", F.col("status").alias("before"), after.alias("after"), "missing").where("after IS NOT NULL")


def with_freshness(store: DataFrame, nodes: DataFrame, at) -> DataFrame:
    """The store with changed statuses; ``at`` is their time of change."""
    change = freshness(store, nodes).select("id", "after")
    return store.join(change, "id", "left").withColumn("updated_at", F.when(F.col("after").isNotNull(), at).otherwise(F.col("updated_at"))).withColumn("status", F.coalesce("after", "status")).drop("after").select(store.columns)


def export(store: DataFrame, path: str) -> None:
    """Writes the store where a rebuild of the rest leaves it alone (S-30)."""
    store.write.mode("overwrite").parquet(path)


def import_(spark, path: str, store: DataFrame | None = None) -> DataFrame:
    """An exported store, taken into another one if given: of one title, the row that changed last (S-30)."""
    old = spark.read.parquet(path)
    if store is None:
        return old
    both = store.unionByName(old)
    return both.groupBy("title").agg(F.max(F.struct("updated_at", *[c for c in store.columns if c not in ("title", "updated_at")])).alias("m")).select(*(F.col("title") if c == "title" else F.col(f"m.{c}") for c in store.columns))


def without_vector(store: DataFrame) -> DataFrame:
    """Findings whose vector is still to be made (U-16)."""
    return store.where("embedding IS NULL").select("id", F.concat_ws("。", "title", F.nullif("detail", F.lit(""))).alias("text"))
