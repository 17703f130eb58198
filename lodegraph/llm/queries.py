"""The pN queries of the text problems, each over its whole tables.

None has SQL: NFKC, tokenizers, suffix arrays and markup are beyond it. Tests hold them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodegraph.llm import bpe, leakage, markup, repetition
from lodegraph.runtime import table

#: Where the public tokenizers' files lie on every machine.
TOKENIZERS = "/opt/tokenizers"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_sections(table(spark, d, "node")).where("n_kept + n_rejected > 0").select("node_id", "field")


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_sections(table(spark, d, "node"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "heldout_item")).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    heldout = table(spark, d, "heldout_item")
    return leakage.leak_report(leakage.leaked_items(table(spark, d, "documents"), heldout), heldout)


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return leakage.clean_documents(documents, leakage.leaked_items(documents, table(spark, d, "heldout_item"))).select("doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeating_documents(table(spark, d, "documents")).select("doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeated_share(table(spark, d, "documents"))


def p9_divergence(spark: SparkSession, d: str) -> DataFrame:
    return repetition.divergence(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p5_found, p5_clean, p7_ids, p8_found, p8_report, p8_clean, p9_found, p9_shares, p9_divergence)
}
SQL: dict[str, str] = {}
