"""Counts, distributions and measures of quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distribution(df: DataFrame, *columns: str) -> DataFrame:
    """``(column, value, n)``: counts per value of each column, from one pass (A-01, A-16, A-23)."""
    sets = df.groupingSets([[F.col(c)] for c in columns], *(F.col(c) for c in columns)).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    width = len(columns)
    name = value = F.lit(None).cast("string")
    for k, c in enumerate(columns):
        mask = (1 << width) - 1 - (1 << (width - 1 - k))
        name, value = F.when(F.col("g") == mask, F.lit(c)).otherwise(name), F.when(F.col("g") == mask, F.col(c).cast("string")).otherwise(value)
    return sets.select(name.alias("column"), value.alias("value"), "n")


def nearest_rank(df: DataFrame, keys: list[str], value: str, percent: int = 95) -> DataFrame:
    """``(keys..., percentile)``: the exact value at place ``min(n * percent // 100, n - 1)`` of each key's sorted values (A-03)."""
    by = W.partitionBy(*keys)
    place = F.row_number().over(by.orderBy(value)) - 1
    n = F.count("*").over(by)
    at = F.least(F.floor(n * percent / 100), n - 1)
    return df.where(F.col(value).isNotNull()).select(*keys, value, place.alias("_p"), at.alias("_at")).where("_p = _at").select(*keys, F.col(value).alias("percentile"))


def tool_usage(telemetry: DataFrame) -> DataFrame:
    """``(tool, n, n_empty, empty_share, mean_ms, p95_ms)`` of ``telemetry(tool, n_results, duration_ms)`` (A-03, A-20)."""
    per = telemetry.groupBy("tool").agg(F.count("*").alias("n"), F.count_if(F.col("n_results") == 0).alias("n_empty"), F.avg("duration_ms").alias("mean_ms"))
    p95 = nearest_rank(telemetry, ["tool"], "duration_ms").withColumnRenamed("percentile", "p95_ms")
    return per.join(p95, "tool", "left").select("tool", "n", "n_empty", F.round(F.col("n_empty") / F.col("n"), 4).alias("empty_share"), F.round("mean_ms", 4).alias("mean_ms"), F.round("p95_ms", 4).alias("p95_ms"))


def time_range(df: DataFrame, column: str) -> DataFrame:
    """One row ``(first, last)`` (A-05)."""
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"))


def top_counts(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k most frequent keys, ties by key (A-04, A-15, A-17, T-09)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(k)


def precision_recall(expected: DataFrame, actual: DataFrame, keys: list[str], dimension: str, precision_min: float = 0.0, recall_min: float = 0.0) -> DataFrame:
    """One row per dimension: true and false positives, misses, precision, recall and whether both suffice (A-12, O-03)."""
    a = expected.select(dimension, *keys).distinct().withColumn("_e", F.lit(True))
    b = actual.select(dimension, *keys).distinct().withColumn("_a", F.lit(True))
    j = a.join(b, [dimension, *keys], "full")
    out = j.groupBy(dimension).agg(F.count_if(F.col("_e") & F.col("_a")).alias("tp"), F.count_if(F.col("_e").isNull()).alias("fp"), F.count_if(F.col("_a").isNull()).alias("fn"))
    ratio = lambda x, y: F.when(x + y > 0, x / (x + y)).otherwise(F.lit(1.0))
    out = out.withColumn("precision", F.round(ratio(F.col("tp"), F.col("fp")), 4)).withColumn("recall", F.round(ratio(F.col("tp"), F.col("fn")), 4))
    return out.withColumn("passed", (F.col("precision") >= precision_min) & (F.col("recall") >= recall_min))


def share(part: Column, whole: Column) -> Column:
    """Percent with one decimal; of nothing, 0 (A-02, A-19)."""
    return F.round(100 * part / F.greatest(F.lit(1), whole), 1)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that come more than once, with their number (A-13)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def numbered(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """Rows with a number within their group (A-22)."""
    return df.withColumn("number", F.row_number().over(W.partitionBy(group).orderBy(*order)))
