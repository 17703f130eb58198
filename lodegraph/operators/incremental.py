"""Processing only new or changed records, by comparing Merkle trees.

``changed_records`` compares a current state with a saved one: both are ``(key, value)`` tables with
one row per key. ``IncrementalStore`` keeps the saved state and its tree on disk and publishes a
run's output together with them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import merkle
from lodegraph.publish import Publications
from lodegraph.runtime import cut, shared_folder, small, strip


def with_digests(state: DataFrame, depth: int, bits: int = merkle.BITS) -> DataFrame:
    """``state(key, value)`` with its leaf and its row digests."""
    return state.select(
        "key",
        "value",
        merkle.leaf_of(F.col("key"), depth, bits).alias("leaf"),
        merkle.row_digest(F.col("key"), F.col("value"), salt=1).alias("d1"),
        merkle.row_digest(F.col("key"), F.col("value"), salt=2).alias("d2"),
    )


def changed_records(current: DataFrame, saved: DataFrame, depth: int, bits: int = merkle.BITS) -> DataFrame:
    """Rows of ``current(key, value)`` that ``saved(key, value)`` lacks or holds with another value.

    Both have one row per key. Leaves with equal digests are never compared row by row. A null value
    equals null only; keys only ``saved`` has give no row; an empty ``saved`` gives all of
    ``current``, an empty ``current`` nothing.
    """
    now, old = cut(with_digests(current, depth, bits)), cut(with_digests(saved, depth, bits))
    trees = [cut(merkle.tree(merkle.leaves(df), depth, bits=bits)) for df in (now, old)]
    differ = small(merkle.differing_leaves(*trees, depth, bits=bits))
    now, old = (df.join(differ, "leaf", "left_semi") for df in (now, old))
    old = old.select("key", F.col("value").alias("before"), F.lit(True).alias("known"))
    both = now.select("key", "value").join(old, "key", "left")
    return both.where(F.col("known").isNull() | ~F.col("value").eqNullSafe(F.col("before"))).select("key", "value")


def clean_hash(c: Column | str) -> Column:
    """A file hash without surrounding blanks, ``md5:`` prefix and letter case."""
    return strip(F.regexp_replace(F.lower(strip(c)), "^md5:", ""))


def ready_versions(parse_status: DataFrame) -> DataFrame:
    """``(key, value)``: each file's hash at its latest usable parse attempt.

    Usable: status success or partial and a hash neither null nor empty. Latest: largest
    (parsed_at, id), a null being smallest; repeated rows are harmless. Rows without a source_file
    name no file and are left out.
    """
    rows = parse_status.select(
        F.col("source_file").alias("key"), "parsed_at", "id", clean_hash("file_hash").alias("hash"), F.lower(strip("status")).alias("state")
    ).where("key IS NOT NULL AND state IN ('success', 'partial') AND hash <> ''")
    return rows.groupBy("key").agg(F.max(F.struct("parsed_at", "id", "hash")).alias("m")).select("key", F.col("m.hash").alias("value"))


def taken_versions(processed_file: DataFrame, update_run: DataFrame) -> DataFrame:
    """``(key, value)``: each file's hash in the latest-finished successful run that lists it.

    A null finish is earliest; equal finishes are decided by run_id, several rows of one run by
    processed_at and then the hash.
    """
    runs = update_run.where(F.lower(strip("state")) == "success").select("run_id", "finished_at").distinct()
    rows = processed_file.join(runs, "run_id").where("source_file IS NOT NULL")
    latest = F.max(F.struct("finished_at", "run_id", "processed_at", clean_hash("file_hash").alias("hash")))
    return rows.groupBy(F.col("source_file").alias("key")).agg(latest.alias("m")).select("key", F.col("m.hash").alias("value"))


def files_to_update(parse_status: DataFrame, processed_file: DataFrame, update_run: DataFrame) -> DataFrame:
    """``(source_file, file_hash)``: files whose ready version no successful run has taken over, once each.

    The versions taken over are published as a run of an ``IncrementalStore`` in the shared folder; the
    next run compares the ready versions with the tree saved by it, and its output is the result.
    """
    store, _ = _taken_over(processed_file, update_run)
    run = store.run(ready_versions(parse_status), lambda todo: todo)
    return store.output(run).select(F.col("key").alias("source_file"), F.col("value").alias("file_hash"))


def _taken_over(processed_file: DataFrame, update_run: DataFrame) -> tuple[IncrementalStore, str]:
    spark = processed_file.sparkSession
    store = IncrementalStore(spark, f"{shared_folder(spark)}/incremental-{uuid.uuid4().hex}")
    return store, store.run(taken_versions(processed_file, update_run), lambda todo: todo)


def update_runs(parse_status: DataFrame, processed_file: DataFrame, update_run: DataFrame) -> DataFrame:
    """``(run_no, n_records, n_processed)``: the run of ``files_to_update`` between that of the versions taken over and one that finds nothing new."""
    store, first = _taken_over(processed_file, update_run)
    ready = cut(ready_versions(parse_status))
    runs = [first, store.run(ready, lambda todo: todo), store.run(ready, lambda todo: todo)]
    counts = [store.output(r).agg(F.lit(k).alias("run_no"), F.lit(store.entry(r)["n_records"]).cast("long").alias("n_records"), F.count(F.lit(1)).alias("n_processed")) for k, r in enumerate(runs, 1)]
    return reduce(DataFrame.unionByName, counts)


class IncrementalStore:
    """Saved state, its Merkle tree and the outputs of runs, in one folder.

    ``state/<run>`` holds the rows of the leaves a run changed, partitioned by the first bits of their
    leaves, so of the saved rows only partitions with differing leaves are read; ``tree/<run>`` the leaf
    digests with the run that last wrote each leaf, ``output/<run>`` what the run produced. A run counts
    only once its entry is published (``Publications``), so output and tree are published together or
    not at all: a run that dies before leaves files nobody reads and the next run sees the same changes
    again; one that dies after has done its work. Of two runs at once the second to publish fails.

    A tree has leaves of about ``leaf_rows`` records. Once the number of records has changed eightfold
    a run shapes the tree anew and writes all of the state.
    """

    TREE = "leaf BIGINT, n BIGINT, d1 BIGINT, d2 BIGINT, run STRING"
    STATE = "key STRING, value STRING, leaf BIGINT, part INT"
    #: Bits of a leaf's number by which state is partitioned, at most: 1,024 folders.
    MOST_PART_BITS = 10

    def __init__(self, spark: SparkSession, path: str, leaf_rows: int = merkle.LEAF_ROWS, part_rows: int = 50_000):
        self.spark, self.path, self.leaf_rows, self.part_rows = spark, path.rstrip("/"), leaf_rows, part_rows
        self.published = Publications(spark, f"{self.path}/runs")

    def runs(self) -> list[dict]:
        """The entries of the published runs in order."""
        return self.published.entries()

    def entry(self, run: str) -> dict:
        return next(e for e in self.runs() if e["run"] == run)

    def saved_tree(self, runs: list[dict] | None = None) -> DataFrame:
        runs = self.runs() if runs is None else runs
        if not runs:
            return self.spark.createDataFrame([], self.TREE)
        return self.spark.read.schema(self.TREE).parquet(f"{self.path}/tree/{runs[-1]['run']}")

    def saved_state(self, leaves: DataFrame | None = None, runs: list[dict] | None = None) -> DataFrame:
        """The saved rows ``(key, value, leaf)``, of ``leaves(leaf)`` only if given."""
        runs = self.runs() if runs is None else runs
        if not runs:
            return self.spark.createDataFrame([], "key STRING, value STRING, leaf BIGINT")
        first = max((i for i, r in enumerate(runs) if r["whole"]), default=0)
        parts = [self.spark.read.schema(self.STATE).parquet(f"{self.path}/state/{r['run']}").withColumn("run", F.lit(r["run"])) for r in runs[first:]]
        holds, every = self.saved_tree(runs).select("leaf", "run"), reduce(DataFrame.unionByName, parts)
        if leaves is not None:
            holds = holds.join(leaves, "leaf", "left_semi")
            if runs[-1]["part_bits"]:
                wanted = [r[0] for r in leaves.select(self._part(runs[-1])).distinct().collect()]  # 1,024 at most
                every = every.where(F.col("part").isin(wanted))
        return every.drop("part").join(holds, ["leaf", "run"], "left_semi").drop("run")

    @staticmethod
    def _part(shape: dict) -> Column:
        return F.shiftright("leaf", max(shape["depth"] * shape["bits"] - shape["part_bits"], 0)).cast("int").alias("part")

    def output(self, run: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/output/{run}")

    def outputs(self) -> DataFrame | None:
        """The outputs of all published runs."""
        runs = [r for r in self.runs() if not r.get("compacted")]
        return self.spark.read.parquet(*(f"{self.path}/output/{r['run']}" for r in runs)) if runs else None

    def _write_state(self, rows: DataFrame, run: str, shape: dict) -> None:
        parted = rows.select("key", "value", "leaf", self._part(shape))
        parted.repartition("part").write.mode("error").partitionBy("part").parquet(f"{self.path}/state/{run}")

    def compact(self) -> str:
        """Gathers the rows of all runs in one folder, published as a run without output; then a reader opens one folder only."""
        runs, run = self.runs(), uuid.uuid4().hex
        self._write_state(self.saved_state(runs=runs), run, runs[-1])
        self.saved_tree(runs).withColumn("run", F.lit(run)).write.mode("error").parquet(f"{self.path}/tree/{run}")
        self.published.publish(len(runs) + 1, {**runs[-1], "run": run, "compacted": True, "whole": True})
        return run

    def run(self, current: DataFrame, process: Callable[[DataFrame], DataFrame]) -> str:
        """Process the records of ``current(key, value)`` that are new or changed since the last published run.

        ``process`` gets ``(key, value)`` and returns what to write. Records gone from ``current``
        leave the state. Returns the run's name.
        """
        runs, run = self.runs(), uuid.uuid4().hex
        current = cut(current.select(F.col("key").cast("string"), F.col("value").cast("string")))
        n_records = current.count()
        depth, bits = merkle.plan_shape(n_records, self.leaf_rows)
        kept_shape = bool(runs) and abs(depth * bits - runs[-1]["depth"] * runs[-1]["bits"]) <= 3
        part_bits = min(math.ceil(math.log2(max(n_records / self.part_rows, 1))), self.MOST_PART_BITS, depth * bits)
        if kept_shape:
            depth, bits, part_bits = (runs[-1][k] for k in ("depth", "bits", "part_bits"))
        shape = {"depth": depth, "bits": bits, "part_bits": part_bits}
        keyed = cut(with_digests(current, depth, bits))
        fresh = cut(merkle.leaves(keyed))
        whole, n_differing = not kept_shape, None
        if not runs:
            process(keyed.select("key", "value")).write.mode("error").parquet(f"{self.path}/output/{run}")
        else:
            if kept_shape:
                saved, old_rows = self.saved_tree(runs), lambda leaves: self.saved_state(leaves, runs)
            else:
                state = cut(with_digests(self.saved_state(runs=runs).drop("leaf"), depth, bits))
                saved, old_rows = cut(merkle.leaves(state)), lambda leaves: state.join(leaves, "leaf", "left_semi")
            trees = [merkle.tree(x.select("leaf", "n", "d1", "d2"), depth, bits=bits) for x in (fresh, saved)]
            differ = small(merkle.differing_leaves(*trees, depth, bits=bits))
            n_differing = differ.count()
            now = keyed.join(differ, "leaf", "left_semi")
            old = old_rows(differ).select("key", F.col("value").alias("before"), F.lit(True).alias("known"))
            pairs = now.select("key", "value").join(old, "key", "left")
            todo = pairs.where(F.col("known").isNull() | ~F.col("value").eqNullSafe(F.col("before"))).select("key", "value")
            process(todo).write.mode("error").parquet(f"{self.path}/output/{run}")
        if whole:
            self._write_state(keyed, run, shape)
            tree = fresh.withColumn("run", F.lit(run))
        else:
            self._write_state(now, run, shape)
            wrote = fresh.join(differ, "leaf", "left_semi").withColumn("run", F.lit(run))
            tree = saved.join(differ, "leaf", "left_anti").unionByName(wrote)
        tree.write.mode("error").parquet(f"{self.path}/tree/{run}")
        facts = {"n_records": n_records, "n_leaves": fresh.count(), "n_differing": n_differing}
        self.published.publish(len(runs) + 1, {"run": run, **shape, "whole": whole, **facts})
        return run
