"""Writing nodes, edges and includes: upserts, deletes and integrity over snapshots.

Parquet has no MERGE, so a write makes the next state from the last one and what comes in.
``SnapshotStore`` keeps states in folders and publishes one by a small numbered file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegraph.operators.graph import first_by
from lodegraph.publish import Publications


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``stored`` with ``incoming`` written over it by key; nulls overwrite too (U-01, U-02, U-20, S-19, S-20).

    Of incoming rows of one key the last under ``order`` counts; columns in ``keep`` stay as stored. A
    key's null equals a null.
    """
    if order:
        incoming = incoming.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
    else:
        incoming = incoming.dropDuplicates(keys)
    new = incoming
    if keep:
        old = stored.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(c).alias(f"_o_{c}") for c in keep), F.lit(True).alias("_there"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        new = incoming.join(old, same, "left").select(*(F.when(F.col("_there"), F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c) if c in keep else c for c in incoming.columns))
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_new")))
    return both.withColumn("_rn", last).where("_rn = 1").select(stored.columns)


def insert_new(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """``stored`` with the incoming rows whose key it hasn't, of several of a key the first under ``order`` (U-03, S-21)."""
    one = first_by(incoming, keys, *order) if order else incoming.dropDuplicates(keys)
    return stored.unionByName(one.join(stored.select(*keys), keys, "left_anti").select(stored.columns))


def import_counts(stored: DataFrame, incoming: DataFrame, keys: list[str], compared: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``(n_new, n_updated, n_unchanged)`` of an upsert, one row or one for each value of the keys in ``by`` (A-18)."""
    old = stored.select(*keys, F.xxhash64(*compared).alias("_old"))
    new = incoming.dropDuplicates(keys).select(*keys, F.xxhash64(*compared).alias("_new"))
    j = new.join(old, keys, "left")
    return j.groupBy(*by).agg(
        F.count_if(F.col("_old").isNull()).alias("n_new"), F.count_if(F.col("_old") != F.col("_new")).alias("n_updated"), F.count_if(F.col("_old") == F.col("_new")).alias("n_unchanged")
    )


def drop_out_edges(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Edges without those from nodes of ``files(file_path)``; edges to these nodes stay (U-06)."""
    gone = nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select(F.col("id").alias("src"))
    return edges.join(gone, "src", "left_anti")


def drop_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes ``gone(id)`` and the edges at either end of them (U-08..U-11)."""
    ids = gone.select("id").distinct()
    kept = nodes.join(ids, "id", "left_anti")
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return kept, left.select(edges.columns)


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes (U-11)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def vanished(nodes: DataFrame, parsed: DataFrame, status: DataFrame) -> DataFrame:
    """``(id)`` of nodes of successfully parsed files that the new parse doesn't have (U-08, O-02, A-21).

    ``parsed(unique_key)`` are the keys of the new parse; files whose parse failed keep their nodes.
    """
    files = status.where("status IN ('success', 'partial')").select(F.col("source_file").alias("file_path")).distinct()
    return nodes.join(files, "file_path", "left_semi").join(parsed.select("unique_key").distinct(), "unique_key", "left_anti").select("id")


def classify(stored: DataFrame, incoming: DataFrame, key: str | list[str], value: str) -> DataFrame:
    """``(key, change)``: created, updated, unchanged or deleted, by key and value (U-13, C-09)."""
    keys = [key] if isinstance(key, str) else key
    a, b = stored.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), incoming.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "created").when(F.col("_in_b").isNull(), "deleted").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("updated")
    return a.join(b, keys, "full").select(*keys, change.alias("change"))


def edge_keys(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges ``(from_key, to_key, ...)`` with the ids of their ends: without a known start left out, without a known end ``dst`` is null (J-03).

    A class key finds a struct of the same name, and a function key without parameters the first one
    with some.
    """
    key = nodes.select("unique_key", "id")
    loose = nodes.select(F.regexp_replace("unique_key", r"^struct\|", "class|").alias("unique_key"), "id").where("unique_key LIKE 'class|%'")
    bare = nodes.where("unique_key LIKE 'function|%'").select(F.regexp_replace("unique_key", r"^(function\|[^|]*\|[^|]*\|[^|]*)\|.*$", "$1").alias("unique_key"), "id")
    tiers = key.withColumn("tier", F.lit(1)).unionByName(loose.withColumn("tier", F.lit(2))).unionByName(bare.withColumn("tier", F.lit(3)))
    best = tiers.groupBy("unique_key").agg(F.min(F.struct("tier", "id")).alias("m")).select("unique_key", "m.id")
    src, dst = best.select(F.col("unique_key").alias("from_key"), F.col("id").alias("src")), best.select(F.col("unique_key").alias("to_key"), F.col("id").alias("dst"))
    return edges.join(src, "from_key").join(dst, "to_key", "left")


class SnapshotStore:
    """States of several tables that belong together; the last published one is read (U-18, U-19).

    A state is written to a folder of its own, which no other writer knows, and published, all its tables
    and some facts about it at once, as the number after the one it was made from. A writer whose number
    is taken raises ``TakenError``; what others published stays as it is. ``sweep`` deletes the folders of
    writers that never published.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.published = Publications(spark, f"{self.path}/published")

    def version(self) -> int:
        """The number of the last published state; 0 before the first."""
        return self.published.last()

    def facts(self, version: int | None = None) -> dict:
        number = version or self.version()
        return self.published.entry(number)["facts"] if number else {}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        folder = self.published.entry(version or self.version())["folder"]
        return self.spark.read.parquet(f"{self.path}/states/{folder}/{name}")

    def publish(self, tables: dict[str, DataFrame], facts: dict | None = None, base: int | None = None, partition_by: dict[str, list[str]] | None = None) -> int:
        """Publishes ``tables`` as the state after ``base``, the version they were made from (by default the last one now)."""
        number, folder = (self.version() if base is None else base) + 1, uuid.uuid4().hex
        for name, df in tables.items():
            writer = df.write.mode("error")
            by = (partition_by or {}).get(name)
            (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/states/{folder}/{name}")
        self.published.publish(number, {"folder": folder, "facts": facts or {}})
        return number

    def sweep(self, hours: float = 24) -> list[str]:
        """Deletes folders without a publication that are older than ``hours``, which no writer should take."""
        return self.published.sweep(f"{self.path}/states", {e["folder"] for e in self.published.entries()}, hours)


class SnapshotTable:
    """States of one table (U-18, U-19); see ``SnapshotStore``."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = SnapshotStore(spark, path)
        self.version, self.sweep = self.store.version, self.store.sweep

    def read(self, version: int | None = None) -> DataFrame:
        return self.store.read("table", version)

    def publish(self, state: DataFrame, partition_by: list[str] | None = None, base: int | None = None) -> int:
        return self.store.publish({"table": state}, base=base, partition_by={"table": partition_by} if partition_by else None)
