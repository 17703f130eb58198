"""Streams: refreshing a graph by micro-batches, windows over telemetry, states of findings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodegraph.functions import text as t
from lodegraph.operators import build
from lodegraph.operators.store import SnapshotStore
from lodegraph.runtime import cut
from lodegraph.sources import parse_results


class GraphRefresher:
    """Takes parse results that arrive in a folder over into a store of nodes, edges, includes, statuses and pending files (U-12, C-01..C-06).

    Each micro-batch makes the next state of all tables and publishes it with the number of the batch, at
    once; a batch that is run again after a failure finds its number and is not taken over twice, and a
    writer that was overtaken publishes nothing. Besides results, documents of status ``deleted`` or
    ``modified`` bring changes of files: deleted ones leave all tables, and the sources that include a
    changed or deleted header become ``pending``, as do units whose parse failed, until a result for
    them arrives.
    """

    TABLES = ("nodes", "edges", "includes", "statuses", "pending")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = SnapshotStore(spark, self.path)

    def last_batch(self) -> int:
        """The number of the last batch taken over, -1 before the first."""
        return self.store.facts().get("batch", -1)

    def state(self) -> tuple[DataFrame, DataFrame] | None:
        """Nodes and edges."""
        version = self.store.version()
        return (self.store.read("nodes", version), self.store.read("edges", version)) if version else None

    def pending(self) -> DataFrame:
        """``(file, reason)`` of what to parse again: ``failed`` units, and sources that ``include`` a changed file."""
        return self.store.read("pending") if self.store.version() else self.spark.createDataFrame([], "file string, reason string")

    def take(self, rows: DataFrame, batch: int) -> None:
        version = self.store.version()
        if version and batch <= self.store.facts(version)["batch"]:
            return
        every = cut(parse_results_of(rows))
        notice = F.col("status").isin("deleted", "modified")
        results = every.where(~notice)
        changes = every.where(notice).select(F.when(F.col("status") == "deleted", "D").otherwise("M").alias("status"), F.col("source_path").alias("file"))
        nodes, edges, includes, statuses = build.build(results)
        waiting = self.spark.createDataFrame([], "file string, reason string")
        if version:
            old = {name: self.store.read(name, version) for name in self.TABLES}
            nodes, edges = build.refresh(old["nodes"], old["edges"], results, changes)
            gone = changes.where("status = 'D'").select(F.col("file").alias("source_file")).distinct()
            good = statuses.where("status <> 'failed'").select("source_file")
            left = old["includes"].join(gone.union(good), "source_file", "left_anti")
            includes = left.unionByName(includes).dropDuplicates(["source_file", "included_file"])
            statuses = old["statuses"].join(gone.union(statuses.select("source_file")), "source_file", "left_anti").unionByName(statuses)
            waiting = old["pending"].join(gone.union(good).withColumnRenamed("source_file", "file"), "file", "left_anti")
        statuses = cut(statuses)
        failed = parse_results.statuses(results).where("status = 'failed'").select(F.col("source_file").alias("file"), F.lit("failed").alias("reason"))
        hit = build.affected(includes, changes).join(changes.where("status = 'D'").select("file"), "file", "left_anti").select("file", F.lit("include").alias("reason"))
        parsed = parse_results.statuses(results).where("status <> 'failed'").select(F.col("source_file").alias("file"))
        waiting = waiting.unionByName(failed).unionByName(hit.join(parsed, "file", "left_anti")).groupBy("file").agg(F.min("reason").alias("reason"))
        self.store.publish(dict(zip(self.TABLES, (nodes, edges, includes, statuses, waiting), strict=True)), {"batch": batch}, version)

    def start(self, folder: str, files_per_batch: int = 1000) -> StreamingQuery:
        """Takes over all files that have arrived, at most ``files_per_batch`` at once, and ends."""
        schema = parse_results.schema()
        stream = self.spark.readStream.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).json(folder)
        return stream.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()


def parse_results_of(rows: DataFrame) -> DataFrame:
    """Documents as the batch source gives them."""
    bad = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in rows.columns else F.lit(False)
    return rows.select(
        "source_path", F.when(bad, "failed").otherwise(F.coalesce("status", F.lit("success"))).alias("status"), "error_message",
        *(F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in ("nodes", "edges", "includes")),
    )


def windowed_usage(calls: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(start, tool, n, n_empty, mean_ms)`` per tumbling window of a stream of calls; later ones are left out (C-07, C-10)."""
    w = calls.withWatermark("ts", late).groupBy(F.window("ts", size), "tool")
    out = w.agg(F.count("*").alias("n"), F.count_if(F.col("n_results") == 0).alias("n_empty"), F.avg("duration_ms").alias("mean_ms"))
    return out.select(F.col("window.start").alias("start"), "tool", "n", "n_empty", "mean_ms")


def finding_states(events: DataFrame) -> DataFrame:
    """``(id, before, after)`` changes of findings' states in a stream of ``events(id, symbol, known)`` (C-08, U-15).

    The state of a finding is which of its anchors the code has; it is stale while it has none.
    Anchors that cannot be names of code are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, names, flags = state.get if state.exists else ("active", [], [])
        known = dict(zip(names, flags, strict=True))
        for b in batches:
            known.update(zip(b["symbol"], (bool(x) for x in b["known"]), strict=True))
        after = "active" if not known or any(known.values()) else "stale"
        state.update((after, list(known), list(known.values())))
        if after != status:
            yield pd.DataFrame({"id": [key[0]], "before": [status], "after": [after]})

    rows = events.where(t.is_code_symbol("symbol")).select("id", "symbol", "known")
    return rows.groupBy("id").applyInPandasWithState(step, "id string, before string, after string", "status string, names array<string>, flags array<boolean>", "append", GroupStateTimeout.NoTimeout)
