"""What changed between full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.operators import merkle
from lodegraph.runtime import cut, small


def deliveries(rows: DataFrame, entity: str, snapshot: str, key: Column, values: list[Column], loaded: str) -> DataFrame:
    """Snapshot rows as ``(entity, snapshot_no, record_key, at, v1, v2)``.

    ``key`` and ``values`` are expressions over ``rows`` (normalise there). Rows with a null key or
    snapshot number are no records and are left out; a null value equals null only.
    """
    return rows.select(
        F.lit(entity).alias("entity"),
        F.col(snapshot).alias("snapshot_no"),
        key.cast("string").alias("record_key"),
        F.col(loaded).alias("at"),
        merkle.row_digest(*values, salt=1).alias("v1"),
        merkle.row_digest(*values, salt=2).alias("v2"),
    ).where("snapshot_no IS NOT NULL AND record_key IS NOT NULL")


def snapshot_changes(rows: DataFrame, leaf_rows: int = merkle.LEAF_ROWS) -> DataFrame:
    """Records added, removed or changed from each delivered snapshot of an entity to the next.

    ``rows`` are ``deliveries`` of one or more entities. Within a snapshot the row of a key with the
    latest ``at`` counts; of rows that also tie there, the one with the largest digest, so the outcome
    is defined. Keys are bucketed into hash ranges, the Merkle trees of consecutive snapshots are
    compared from the root down, and rows are compared only in leaves whose digests differ. A key
    delivered many times is reduced to one row before the shuffle.

    Defined results: a null ``at`` is earlier than any other; an empty table, or one with a single
    snapshot, gives no rows; gaps in the numbers are bridged to the snapshot delivered before.

    Returns ``(snapshot_no, entity, record_key, change_kind)``.
    """
    depth, bits = merkle.plan_shape(rows.count(), leaf_rows)
    latest = (
        rows.withColumn("leaf", merkle.leaf_of(F.col("record_key"), depth, bits))
        .groupBy("entity", "leaf", "snapshot_no", "record_key")
        .agg(F.max(F.struct("at", "v1", "v2")).alias("m"))
    )
    digests = [merkle.row_digest(F.col("record_key"), F.col("m.v1"), F.col("m.v2"), salt=k).alias(f"d{k - 2}") for k in (3, 4)]
    latest = cut(latest.select("entity", "leaf", "snapshot_no", "record_key", *digests))

    scope = ["entity", "snapshot_no"]
    trees = cut(merkle.tree(merkle.leaves(latest, scope), depth, scope, bits))
    # one row per delivery: as many as snapshots, not as rows
    by = W.partitionBy("entity").orderBy("snapshot_no")
    order = trees.where("level = 0").select(*scope, F.lead("snapshot_no").over(by).alias("later"), F.row_number().over(by).alias("place"))
    order = cut(order)
    follows, first = small(order.where("later IS NOT NULL").select(*scope, "later")), small(order.where("place = 1").select(*scope))

    def moved(df: DataFrame) -> DataFrame:
        return df.join(follows, scope).drop("snapshot_no").withColumnRenamed("later", "snapshot_no")

    differ = small(merkle.differing_leaves(trees.join(first, scope, "left_anti"), moved(trees), depth, scope, bits))
    now = latest.join(first, scope, "left_anti").join(differ, [*scope, "leaf"], "left_semi").withColumn("side", F.lit(1))
    old = moved(latest).join(differ, [*scope, "leaf"], "left_semi").withColumn("side", F.lit(2))
    both = now.unionByName(old).groupBy(*scope, "record_key").agg(
        F.sum("side").alias("sides"), F.min("d1").alias("l1"), F.max("d1").alias("h1"), F.min("d2").alias("l2"), F.max("d2").alias("h2")
    )
    kind = (
        F.when(F.col("sides") == 1, "added")
        .when(F.col("sides") == 2, "removed")
        .when((F.col("l1") != F.col("h1")) | (F.col("l2") != F.col("h2")), "changed")
    )
    return both.select("snapshot_no", "entity", "record_key", kind.alias("change_kind")).where("change_kind IS NOT NULL")


def code_graph_changes(node_snapshot: DataFrame, edge_snapshot: DataFrame) -> DataFrame:
    """Changes of node and edge snapshots: ``(snapshot_no, entity, record_key, change_kind)``."""
    signature = F.regexp_replace(F.regexp_replace("signature", r"^\s+|\s+$", ""), r"\s+", " ")
    values = [F.col("file_path"), F.col("start_line"), F.col("end_line"), signature, F.lower("content_hash"), F.col("access")]
    node = deliveries(node_snapshot, "node", "snapshot_no", F.col("unique_key"), values, "loaded_at")
    line = F.coalesce("call_line", F.lit(0))
    key = F.concat(F.col("from_key"), F.lit("~"), F.col("to_key"), F.lit("~"), line.cast("string"))
    edge = deliveries(edge_snapshot, "edge", "snapshot_no", key, [F.lower(F.regexp_replace("relation_type", r"\s+", ""))], "loaded_at")
    return snapshot_changes(node.unionByName(edge))
