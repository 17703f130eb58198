"""Search in texts: key words, BM25, fusion of rankings, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.functions import text as t
from lodegraph.operators.graph import closure
from lodegraph.runtime import cut

K1, B = 1.2, 0.75


def postings(texts: DataFrame) -> DataFrame:
    """``(key, term, tf)`` of ``texts(key, text)``: how often each search term stands in each text."""
    return texts.select("key", F.explode(t.terms("text")).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))


def bm25(texts: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """``(key, score)``: texts with any term of the query, by BM25 (R-02, T-03).

    Only the postings of the query's terms are kept; the number of texts, their mean length and the
    texts per term are one small aggregate each.
    """
    spark = texts.sparkSession
    wanted = [r[0] for r in spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(t.terms("q")))).collect()]
    if not wanted:
        return texts.select("key", F.lit(0.0).alias("score")).limit(0)
    # texts are taken apart once: what is kept of each is its size and its terms of the query
    sized = cut(texts.select("key", t.terms("text").alias("terms")).select("key", F.size("terms").alias("size"), F.filter("terms", lambda x: x.isin(wanted)).alias("terms")))
    stats = sized.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
    hits = sized.select("key", "size", F.explode("terms").alias("term")).groupBy("key", "size", "term").agg(F.count("*").alias("tf"))
    hits = cut(hits)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as the query has terms
    n, mean = float(stats["n"]), float(stats["mean"] or 1.0) or 1.0
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
    out = hits.join(F.broadcast(df), "term").groupBy("key").agg(F.sum(part).alias("score"))
    return out.orderBy(F.desc(F.round("score", 9)), "key").limit(limit) if limit else out


def word_hits(texts: DataFrame, words: list[str], fields: list[str]) -> DataFrame:
    """Rows of ``texts`` with any of the words in any of the fields, with the number of words they have as ``hits`` (R-01, A-11)."""
    total: Column = F.lit(0)
    for w in words:
        any_ = F.lit(False)
        for f in fields:
            any_ = any_ | F.coalesce(t.contains_like(f, w), F.lit(False))
        total = total + F.when(any_, 1).otherwise(0)
    return texts.withColumn("hits", total).where("hits > 0")


def ranked(df: DataFrame, route: str, *order: Column) -> DataFrame:
    """``(route, key, rank)`` of a route's hits, rank from 0 (W-02)."""
    return df.select(F.lit(route).alias("route"), "key", (F.row_number().over(W.orderBy(*order)) - 1).alias("rank"))


def fuse(rankings: DataFrame, limit: int, full: tuple[str, ...] = (), k: int = 60) -> DataFrame:
    """``(key, score, routes, place)``: reciprocal rank fusion of ``rankings(route, key, rank)`` (R-05, W-03, W-04).

    A key's score is the sum of 1 / (k + rank + 1). After the best ``limit``, the keys among the first
    ``limit`` of a ``full`` route and the first of every other route follow where they are missing, so
    more than ``limit`` keys may come. Rankings are short lists: routes keep a multiple of ``limit``.
    """
    score = F.round(F.sum(1 / (F.lit(k) + F.col("rank") + 1)), 6)
    kept = F.max(F.when(F.col("route").isin(*full), F.col("rank") < limit).otherwise(F.col("rank") == 0)).alias("kept")
    every = rankings.groupBy("key").agg(score.alias("score"), F.array_join(F.array_sort(F.collect_set("route")), "+").alias("routes"), kept)
    every = every.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "key")))
    return every.where((F.col("place") <= limit) | F.col("kept")).select("key", "score", "routes", "place")


#: The columns of a document that are searched.
FIELDS = ("title", "summary", "path", "tags")


def document_search(texts: DataFrame, mentions: DataFrame, query: str, limit: int = 5, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(key, score, routes, place)``: start documents by three routes (R-02..R-05).

    BM25 over all ``fields`` of ``texts(key, fields...)``, the whole query as a part of any of them, and
    documents of ``mentions(key, name)`` whose name has the query as a part. A route by parts ranks by
    how many fields or names have it, then by key.
    """
    per = limit * 3
    one = bm25(texts.select("key", F.concat_ws(" ", *fields).alias("text")), query, per)
    parts = word_hits(texts, [query], list(fields)).select("key", sum((F.when(F.coalesce(t.contains_like(f, query), F.lit(False)), 1).otherwise(0) for f in fields), F.lit(0)).alias("n"))
    two = parts.orderBy(F.desc("n"), "key").limit(per)
    three = mentions.where(t.contains_like("name", query)).groupBy("key").agg(F.count_distinct("name").alias("n")).orderBy(F.desc("n"), "key").limit(per)
    best = (F.desc("n"), F.col("key"))
    every = ranked(one, "bm25", F.desc(F.round("score", 9)), F.col("key")).unionByName(ranked(two, "part", *best)).unionByName(ranked(three, "symbol", *best))
    return fuse(cut(every), limit, ("bm25",))


def synonym_pairs(spark: SparkSession, synonyms: dict[str, list[str]]) -> DataFrame:
    """``(place, word, alt)``: a dictionary as a table, read in both directions, in its order."""
    rows = [(k, v) for k, values in synonyms.items() for v in values]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, word string, alt string")
    turned = table.select((F.col("place") + len(rows)).alias("place"), F.col("alt").alias("word"), F.col("word").alias("alt"))
    return table.unionByName(turned)


def expand_query(pairs: DataFrame, query: str) -> list[str]:
    """Words of a dictionary that stand for words of the query; none the query has (R-06).

    ``pairs`` are ``synonym_pairs``; the query is matched against the table, and its few hits come back.
    """
    asked = F.lower(F.lit(query))
    hit = pairs.where(F.contains(asked, F.lower("word")) & ~F.contains(asked, F.lower("alt")))
    return [r["alt"] for r in hit.groupBy("alt").agg(F.min("place").alias("place")).orderBy("place").collect()]


def reach_documents(starts: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """``(start, node, hop)``: documents and symbols within ``depth`` links of the starts (G-27).

    Links lead both ways between documents; a symbol is a leaf, met over ``mentions_symbol`` and not
    gone on from.
    """
    docs = edges.where("rel <> 'mentions_symbol'").select("src", "dst")
    arcs = docs.unionByName(docs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = cut(closure(starts.select(F.col("key").alias("seed"), F.col("key").alias("node")), arcs, depth))
    leaf = near.where(F.col("depth") < depth).join(edges.where("rel = 'mentions_symbol'").select(F.col("src").alias("node"), "dst"), "node")
    leaf = leaf.groupBy("seed", F.col("dst").alias("node")).agg((F.min("depth") + 1).alias("depth"))
    return near.unionByName(leaf).select(F.col("seed").alias("start"), "node", F.col("depth").alias("hop"))


def bridge_symbols(symbols: DataFrame, nodes: DataFrame, per_tier: int = 5) -> DataFrame:
    """``(symbol, node_id, tier)``: code for names in documents (J-18, W-05).

    Tier 1: a class, struct or function of the symbol's last part; tier 2, where there is none: a member of
    that name in the class before it; tier 3, where there is neither: a class or function with the last
    part in its name, whatever its case. At most ``per_tier`` nodes by id. Parts of names are found by a
    join on the first letters at every place of a name, then compared.
    """
    bare = F.regexp_replace("symbol", "^symbol:", "")
    s = symbols.select("symbol").distinct().withColumn("name", t.tail(bare)).withColumn("owner", F.when(bare.contains("::"), t.head(bare)))
    code = nodes.where("type IN ('class', 'struct', 'function') AND name IS NOT NULL").select(F.col("id").alias("node_id"), "name", "type", "parent_class")

    def first(found: DataFrame, tier: int) -> DataFrame:
        place = F.row_number().over(W.partitionBy("symbol").orderBy("node_id"))
        return found.withColumn("place", place).where(F.col("place") <= per_tier).select("symbol", "node_id", F.lit(tier).alias("tier"))

    one = cut(first(s.join(code, "name"), 1))
    rest = s.join(one.select("symbol").distinct(), "symbol", "left_anti")
    member = code.where("type = 'function'").select("node_id", "name", F.col("parent_class").alias("owner"))
    two = cut(first(rest.join(member, ["name", "owner"]), 2))
    rest = cut(rest.join(two.select("symbol").distinct(), "symbol", "left_anti").where("name <> ''").withColumn("low", F.lower("name")))
    wanted = rest.select("symbol", "low", F.substring("low", 1, 3).alias("gram"))
    low = F.lower("name")
    gram = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - k + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(k)))
    grams = code.where("type IN ('class', 'function')").select("node_id", low.alias("have"), F.explode(F.array_distinct(F.concat(gram(1), gram(2), gram(3)))).alias("gram"))
    three = first(wanted.join(grams, "gram").where(F.col("have").contains(F.col("low"))).select("symbol", "node_id"), 3)
    return one.unionByName(two).unionByName(three)


def bridge_calls(bridge: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(symbol, node_id, tier, callers, callees)``: names of what calls, and is called by, the code of symbols (J-19)."""
    calls = edges.where("relation_type LIKE 'calls%'")
    named = nodes.select("id", "name")
    ids = bridge.select("node_id").distinct()
    up = calls.join(ids, calls["dst"] == ids["node_id"]).join(named, F.col("src") == F.col("id")).groupBy("node_id").agg(F.array_sort(F.collect_set("name")).alias("callers"))
    down = calls.join(ids, calls["src"] == ids["node_id"]).join(named, F.col("dst") == F.col("id")).groupBy("node_id").agg(F.array_sort(F.collect_set("name")).alias("callees"))
    none = F.array().cast("array<string>")
    out = bridge.join(up, "node_id", "left").join(down, "node_id", "left")
    return out.select("symbol", "node_id", "tier", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))


def similar_pairs(a: DataFrame, b: DataFrame, least: float, block: int = 4096) -> DataFrame:
    """``(a_id, b_id, similarity)``: all pairs of vectors with cosine ``least`` or more, exactly (J-17, R-14).

    Both sides are laid in blocks of about ``block`` vectors by a hash of the id; a task multiplies one
    block of either as matrices, in strips. All pairs are compared: at a threshold such as 0.45 signs
    of hyperplanes rule out too few to keep the recall. Nothing goes through the driver.
    ``a(id, vec)`` and ``b(id, vec)``; a null or zero vector has no pairs.
    """
    import numpy as np
    import pandas as pd

    def named(df: DataFrame, name: str) -> DataFrame:
        rows = df.where("vec IS NOT NULL AND exists(vec, x -> x <> 0)")
        return cut(rows.select(F.col("id").cast("long").alias(f"{name}_id"), F.col("vec").cast("array<double>").alias(f"{name}_vec")))

    kept = [named(a, "a"), named(b, "b")]
    na, nb = (max(1, -(-df.count() // block)) for df in kept)

    def laid(df: DataFrame, name: str, own: str, n: int, other: str, times: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(f"{name}_id"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(times - 1)).cast("array<long>")))

    def unit(rows: pd.Series) -> np.ndarray:
        v = np.array(rows.tolist(), float)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a_id": np.array([], np.int64), "b_id": np.array([], np.int64), "similarity": np.array([], float)})]
        if len(x) and len(y):
            ux, uy, ix, iy = unit(x["a_vec"]), unit(y["b_vec"]), x["a_id"].to_numpy(), y["b_id"].to_numpy()
            for at in range(0, len(ix), 512):
                s = ux[at : at + 512] @ uy.T
                i, j = np.nonzero(s >= least)
                keep = ix[at + i] != iy[j]
                out.append(pd.DataFrame({"a_id": ix[at + i][keep], "b_id": iy[j][keep], "similarity": s[i, j][keep]}))
        return pd.concat(out[1:] or out)

    left, right = laid(kept[0], "a", "ai", na, "aj", nb), laid(kept[1], "b", "bj", nb, "bi", na)
    return left.groupBy("ai", "aj").cogroup(right.groupBy("bi", "bj")).applyInPandas(product, "a_id long, b_id long, similarity double")


def nearest(queries: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """``(a_id, b_id, similarity)``: exact cosines of a stated set of queries against all vectors (J-17, R-08).

    Each task multiplies its vectors with one block of queries at a time as matrices; the queries are
    sent in blocks of 1,024.
    """
    import numpy as np
    import pandas as pd

    rows = vectors.where("vec IS NOT NULL").select("id", "vec")
    n = queries.count()
    parts = max(1, -(-n // 1024))
    out = None
    for part in range(parts):
        held = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).where("vec IS NOT NULL").select("id", "vec").collect()
        ids = np.array([r[0] for r in held], np.int64)
        q = np.array([r[1] for r in held], float).reshape(len(held), -1)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(batches, ids=ids, q=q):
            for b in batches:
                if not len(b) or not len(ids):
                    continue
                v = np.array(b["vec"].tolist(), float)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                own = b["id"].to_numpy()
                for at in range(0, len(own), 4096):
                    s = q @ v[at : at + 4096].T
                    i, j = np.nonzero(s >= least)
                    keep = ids[i] != own[at + j]
                    yield pd.DataFrame({"a_id": ids[i][keep], "b_id": own[at + j][keep], "similarity": s[i, j][keep]})

        found = rows.mapInPandas(run, "a_id long, b_id long, similarity double")
        out = found if out is None else out.unionByName(found)
    return out
