"""Session helpers: lineage cuts, hot keys, size checks."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 1 / 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    It lies in the folder that the cluster names in ``spark.checkpoint.dir``; only where that is unset
    (tests, a single machine) a temporary one is made.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodegraph-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage; the files outlive executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df``, materialised; marked for broadcast if it has at most ``most`` rows, else to be shuffled like any other."""
    df = cut(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, least: int = 10_000) -> list:
    """The values of ``key`` that hold at least ``share`` of the rows (and ``least`` rows).

    Counts are pre-aggregated before they are shuffled, and at most ``1 / share`` values can pass,
    so the list that reaches the driver has a fixed bound.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    counts = cut(counts.where(F.col("count") >= least))  # under 1 / least of the rows
    top = counts.orderBy(F.desc("count"), key).limit(int(1 / share)).collect()
    if not top:
        return []
    total = df.count()
    return [r[key] for r in top if r["count"] >= share * total]


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot: list | None = None) -> DataFrame:
    """``left`` joined to ``right``, which has one row per ``key``, without one task per hot key.

    Rows of hot keys are joined to a broadcast of those keys' rows (at most ``1 / HOT_SHARE`` rows,
    because ``key`` is unique in ``right``); all others go through a sort-merge join.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right.hint("merge"), key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.where(~is_hot).join(right.hint("merge"), key, how)
    warm = left.where(is_hot).join(F.broadcast(right.where(F.col(key).isin(hot)).limit(len(hot))), key, how)
    return cold.unionByName(warm)


def measured(df: DataFrame, most: int = 200_000) -> tuple[DataFrame, bool]:
    """``df``, materialised, and whether it has at most ``most`` rows."""
    df = cut(df)
    return df, df.limit(most + 1).count() <= most


def keyed_join(left: DataFrame, right: DataFrame, key: str, fits: bool, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has one row per ``key``: by a broadcast if it ``fits``, as ``measured``, else by ``lookup_join``."""
    return left.join(F.broadcast(right), key, how) if fits else lookup_join(left, right, key, how)


def strip(c: Column | str) -> Column:
    """``c`` without white space at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")
