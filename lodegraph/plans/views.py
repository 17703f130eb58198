"""Current nodes and distinct edges of a data directory, and the SQL of the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.references import current_nodes
from lodegraph.runtime import table


def nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """``(id, columns...)`` of the current nodes that are not gone."""
    picked = list(dict.fromkeys([*columns, "deleted_at"]))
    return current_nodes(table(spark, d, "node"), *picked).where("deleted_at IS NULL").select("id", *columns)


def edges(spark: SparkSession, d: str, *columns: str, relations: list[str] | None = None) -> DataFrame:
    """``(src, dst, relation_type, line, edge_id, columns...)``: edges with a target, once per their key.

    The key is (from, to, relation, call line with null as 0); of rows that repeat it, the one with
    the smallest id counts. A relation filter reaches the scan.
    """
    rows = table(spark, d, "edge").where("to_id > 0 AND from_id IS NOT NULL")
    if relations:
        rows = rows.where(F.col("relation_type").isin(relations))
    keyed = rows.groupBy(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "relation_type", F.coalesce("call_line", F.lit(0)).alias("line"))
    if not columns:
        return keyed.agg(F.min("id").alias("edge_id"))
    first = F.min(F.struct("id", *columns)).alias("m")
    return keyed.agg(first).select("src", "dst", "relation_type", "line", F.col("m.id").alias("edge_id"), *(F.col(f"m.{c}").alias(c) for c in columns))


N = """n AS (SELECT * FROM (SELECT * FROM node WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1) WHERE deleted_at IS NULL)"""
E = """e AS (SELECT * EXCLUDE (from_id, to_id, call_line), from_id AS src, to_id AS dst, coalesce(call_line, 0) AS call_line FROM edge
  WHERE to_id > 0 AND from_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY from_id, to_id, relation_type, coalesce(call_line, 0) ORDER BY id) = 1)"""
NE = f"{N}, {E}"

INHERITS = ["inherits_public", "inherits_protected", "inherits_private"]
CALLS = ["calls_direct", "calls_virtual", "calls_callback"]


def sql_in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
