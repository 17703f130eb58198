"""Parse results as JSON documents, one per translation unit, to node, edge and include tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.functions import text as t
from lodegraph.operators.graph import first_by

NODE_TYPES = ("class", "struct", "function", "file", "doc_section")
RELATIONS = (
    "inherits_public", "inherits_protected", "inherits_private", "belongs_to", "overrides", "hides", "calls_direct", "calls_virtual", "calls_callback", "instantiates",
    "friend_of", "type_alias", "using_decl", "doc_describes_code", "code_refers_to_doc",
)

_NODE_EXTRA = (
    "is_abstract boolean, is_template_specialization boolean, is_type_alias boolean, is_typedef boolean, template_params array<string>, target_type string, is_virtual boolean, "
    "is_pure_virtual boolean, is_override boolean, is_static boolean, is_const boolean, access string, parent_class string, signature string, result_type string, "
    "param_types array<string>, is_project boolean, doc_title string, heading string, section_level int, content_preview string, content_hash string, word_count int, tags array<string>"
)
_EDGE_EXTRA = (
    "call_line int, callee_name string, callee_namespace string, callee_parent_class string, callee_file string, callee_param_types array<string>, callee_is_const boolean, "
    "call_type string, alias_name string, target_simple_name string, target_type string, function_name string, derived_class string, base_class string, base_namespace string, "
    "is_virtual boolean, is_typedef boolean, confidence double, method string, matched_name string, access string, friend_name string, _needs_resolution boolean, _resolve_hint string"
)
SCHEMA = (
    "source_path string, status string, error_message string, "
    f"nodes array<struct<type:string,name:string,namespace:string,file_path:string,start_line:int,end_line:int,unique_key:string,extra_info:struct<{_NODE_EXTRA.replace(' ', ':').replace(',:', ',')}>>>, "
    f"edges array<struct<relation_type:string,from_unique_key:string,to_unique_key:string,extra_info:struct<{_EDGE_EXTRA.replace(' ', ':').replace(',:', ',')}>>>, "
    "includes array<struct<source_file:string,included_file:string,is_system:boolean>>"
)


def schema() -> T.StructType:
    """The schema of a document, with a column for one that can't be read."""
    return T._parse_datatype_string(SCHEMA).add("_corrupt_record", T.StringType())


def read(spark: SparkSession, path: str) -> DataFrame:
    """All parse results under ``path``, sub-folders included; an unreadable file is a row of status failed (S-01, S-02, S-25)."""
    rows = spark.read.schema(schema()).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "PERMISSIVE").json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_path"))
    bad = F.col("_corrupt_record").isNotNull()
    return rows.select(
        F.coalesce("source_path", "file").alias("source_path"),
        F.when(bad, "failed").otherwise(F.coalesce("status", F.lit("success"))).alias("status"),
        F.when(bad, "unreadable").otherwise(F.col("error_message")).alias("error_message"),
        *(F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in ("nodes", "edges", "includes")),
    )


def nodes(results: DataFrame) -> DataFrame:
    """Nodes, one per key: of several, the first by file and line; an unknown type is a class (S-03, U-04)."""
    n = results.select("source_path", F.explode("nodes").alias("n")).select("source_path", "n.*").select("source_path", "type", "name", "namespace", "file_path", "start_line", "end_line", "unique_key", "extra_info.*")
    known = F.when(F.col("type").isin(*NODE_TYPES), F.col("type")).otherwise("class")
    n = n.withColumn("type", known)
    made = t.node_key(F.col("type"), F.col("namespace"), F.col("name"), F.col("file_path"), F.col("param_types"), F.col("is_const"))
    n = n.withColumn("unique_key", F.coalesce("unique_key", made))
    one = first_by(n, ["unique_key"], F.col("file_path"), F.col("start_line"), F.col("source_path"))
    return one.drop("source_path").withColumn("id", t.node_id("unique_key")).withColumnRenamed("is_template_specialization", "is_template_spec")


def edges(results: DataFrame) -> DataFrame:
    """Edges as given, by key; an unknown relation is belongs_to and kept as ``original_relation`` (S-03)."""
    e = results.select("source_path", F.explode("edges").alias("e")).select("source_path", "e.*").select("source_path", "relation_type", F.col("from_unique_key").alias("from_key"), F.col("to_unique_key").alias("to_key"), "extra_info.*")
    known = F.col("relation_type").isin(*RELATIONS)
    e = e.withColumn("original_relation", F.when(~known, F.col("relation_type"))).withColumn("relation_type", F.when(known, F.col("relation_type")).otherwise("belongs_to"))
    return e.withColumnRenamed("_needs_resolution", "needs_resolution").withColumnRenamed("_resolve_hint", "resolve_hint").withColumnRenamed("is_virtual", "is_virtual_base").withColumnRenamed("method", "match_method")


def includes(results: DataFrame) -> DataFrame:
    """Includes once per pair (S-21)."""
    i = results.select(F.explode("includes").alias("i")).select("i.*")
    return i.groupBy("source_file", "included_file").agg(F.max(F.coalesce("is_system", F.lit(False))).alias("is_system"))


def statuses(results: DataFrame) -> DataFrame:
    """``(source_file, status, error_message, node_count, edge_count)`` per translation unit (A-19, O-08)."""
    return results.select(F.col("source_path").alias("source_file"), "status", "error_message", F.size("nodes").alias("node_count"), F.size("edges").alias("edge_count"))


def merged_status(results: DataFrame) -> DataFrame:
    """One row for all results: partial if any failed (O-08)."""
    return results.agg(F.when(F.count_if(F.col("status") != "success") > 0, "partial").otherwise("success").alias("status"), F.sum(F.size("nodes")).alias("n_nodes"))
