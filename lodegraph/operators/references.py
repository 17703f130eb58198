"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.runtime import cut, hot_keys

#: Salts of a hot key: its references are spread over so many tasks.
SALTS = 32


def plain_name(c: Column | str) -> Column:
    """A C++ name without template arguments (however nested), qualifiers and blanks."""
    name = F.col(c) if isinstance(c, str) else c
    opens = F.length(name) - F.length(F.replace(name, F.lit("<"), F.lit("")))
    bare = F.aggregate(F.sequence(F.lit(1), opens), name, lambda acc, _: F.regexp_replace(acc, "<[^<>]*>", ""))
    bare = F.when(name.contains("<"), bare).otherwise(name)
    return F.regexp_replace(F.regexp_replace(bare, r"^(?s).*::", ""), r"\s+", "")


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References whose target is missing, deleted, or came later than the reference.

    ``refs(ref_id, kind, key, at)`` refer to key ``key`` of kind ``kind`` at time ``at``;
    ``parents(kind, key, born, gone)`` are the records that can be referred to, with the interval in
    which they are valid. Parents are reduced to one validity row per key (how many, how many not
    gone, earliest birth of those); references and parents are co-partitioned by key, sorted and
    merged in one pass (a sort-merge join). Keys that hold a large share of the references are
    salted: their references are spread, their one validity row is repeated per salt.

    Defined results: a null ``key`` refers to a key no record has, so it is missing; a null ``at`` or
    a null ``born`` is never late; several rows of one ``ref_id`` give one row, that with the earliest
    ``at``, then the smallest reason. Returns ``(ref_id, reason, at)``.
    """
    live = F.col("gone").isNull()
    valid = (
        parents.where("key IS NOT NULL")
        .groupBy("kind", "key")
        .agg(
            F.count_if(live).alias("live"),
            F.count_if(live & F.col("born").isNull()).alias("undated"),
            F.min(F.when(live, F.col("born"))).alias("born"),
        )
    )
    hot = hot_keys(refs, "key")
    if hot:
        is_hot = F.coalesce(F.col("key").isin(hot), F.lit(False))
        refs = refs.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("ref_id"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
        salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        valid = valid.withColumn("salt", F.explode(salts.cast("array<long>")))
    on = ["kind", "key"] + ["salt"] * bool(hot)
    merged = refs.join(valid.hint("merge"), on, "left")
    reason = (
        F.when(F.col("live").isNull(), "missing")
        .when(F.col("live") == 0, "deleted")
        .when((F.col("undated") == 0) & (F.col("born") > F.col("at")), "late")
    )
    found = merged.select("ref_id", reason.alias("reason"), "at").where("reason IS NOT NULL")
    return found.groupBy("ref_id").agg(F.min(F.struct("at", "reason")).alias("m")).select("ref_id", "m.reason", "m.at")


def current_nodes(node: DataFrame, *columns: str) -> DataFrame:
    """The current row of each id: that with the largest updated_at (of equal ones, the largest values)."""
    picked = F.max(F.struct("updated_at", *columns)).alias("m")
    return node.where("id IS NOT NULL").groupBy("id").agg(picked).select("id", *(F.col(f"m.{c}").alias(c) for c in columns))


def edge_references(edge: DataFrame) -> DataFrame:
    """What each edge refers to: ``(ref_id, kind, key, at)``; edges that refer to nothing are left out."""
    hint, by_name = F.col("resolve_hint"), F.coalesce(F.col("needs_resolution"), F.lit(False))
    by_id = F.coalesce(F.col("to_id") > 0, F.lit(False))
    kind = (
        F.when(by_id, "id")
        .when(by_name & (hint == "type_alias"), "type")
        .when(by_name & (hint.isin("override", "using_decl") | hint.isNull()), "function")
    )
    name = F.when(hint == "type_alias", F.col("target_simple_name")).when(hint.isNull(), F.col("callee_name")).otherwise(F.col("function_name"))
    key = F.when(by_id, F.col("to_id").cast("string")).otherwise(plain_name(name))
    return edge.select(F.col("id").alias("ref_id"), kind.alias("kind"), key.alias("key"), F.col("created_at").alias("at")).where("kind IS NOT NULL AND ref_id IS NOT NULL")


def node_parents(node: DataFrame) -> DataFrame:
    """Nodes as records that edges refer to, by id and by name: ``(kind, key, born, gone)``."""
    now = cut(current_nodes(node, "type", "name", "created_at", "deleted_at"))
    span = [F.col("created_at").alias("born"), F.col("deleted_at").alias("gone")]
    ids = now.select(F.lit("id").alias("kind"), F.col("id").cast("string").alias("key"), *span)
    kind = F.when(F.col("type") == "function", "function").when(F.col("type").isin("class", "struct"), "type")
    names = now.select(kind.alias("kind"), plain_name("name").alias("key"), *span).where("kind IS NOT NULL")
    return ids.unionByName(names)


def orphan_edges(edge: DataFrame, node: DataFrame) -> DataFrame:
    """Edges that refer to nodes that are missing, deleted or later: ``(edge_id, reason, period)``."""
    out = orphan_references(edge_references(edge), node_parents(node))
    return out.select(F.col("ref_id").alias("edge_id"), "reason", F.date_format("at", "yyyy-MM").alias("period"))


def orphan_report(orphans: DataFrame, edge: DataFrame) -> DataFrame:
    """Orphans per relation, period and reason: ``(relation_type, period, reason, n_edges)``."""
    relation = edge.groupBy(F.col("id").alias("edge_id")).agg(F.min("relation_type").alias("relation_type"))
    return orphans.join(relation, "edge_id", "left").groupBy("relation_type", "period", "reason").agg(F.count(F.lit(1)).alias("n_edges"))
