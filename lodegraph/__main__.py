"""``python -m lodegraph TABLES COMMAND ...``: questions to a folder of tables from the command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lodegraph.api import CodeGraph
from lodegraph.operators import build
from lodegraph.sources import parse_results


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodegraph", description=__doc__)
    p.add_argument("tables", help="folder of the tables; for import and incremental, where they are written")
    p.add_argument("--rows", type=int, default=50, help="rows to print")
    c = p.add_subparsers(dest="command", required=True)
    for name in ("search-class", "search-func", "inheritance", "callers", "callees", "overrides", "code-docs"):
        s = c.add_parser(name)
        s.add_argument("name")
        s.add_argument("--cls")
        s.add_argument("--depth", type=int, default=0)
        s.add_argument("--direction", default="ancestors", choices=["ancestors", "descendants"])
    s = c.add_parser("file-symbols")
    s.add_argument("path")
    s = c.add_parser("traverse")
    s.add_argument("names", nargs="+")
    s.add_argument("--relations", nargs="*")
    s.add_argument("--direction", default="outgoing")
    s.add_argument("--depth", type=int, default=2)
    s.add_argument("--mode", default="bfs", choices=["bfs", "dfs"])
    s = c.add_parser("search-docs")
    s.add_argument("query")
    s.add_argument("--tag")
    s.add_argument("--min-confidence", type=float, default=0.0)
    s = c.add_parser("blast-radius")
    s.add_argument("--symbols", nargs="*")
    s.add_argument("--files", nargs="*")
    s.add_argument("--depth", type=int, default=3)
    s = c.add_parser("include")
    s.add_argument("files", nargs="+")
    c.add_parser("stats")
    for name in ("import", "full-parse", "incremental"):
        c.add_parser(name).add_argument("results", help="folder of parse results (JSON)")
    return p


def answer(spark: SparkSession, a: argparse.Namespace):
    if a.command in ("import", "full-parse"):
        nodes, edges, includes, statuses = build.build(parse_results.read(spark, a.results))
        for name, df in (("nodes", nodes), ("edges", edges), ("includes", includes), ("statuses", statuses)):
            df.write.mode("overwrite").parquet(f"{a.tables}/{name}")
        return spark.read.parquet(f"{a.tables}/statuses").groupBy("status").count()
    if a.command == "incremental":
        from lodegraph.streaming.jobs import GraphRefresher

        job = GraphRefresher(spark, a.tables)
        job.start(a.results).awaitTermination()
        return job.pending()
    g = CodeGraph.load(spark, a.tables)
    return {
        "search-class": lambda: g.search_class(a.name),
        "search-func": lambda: g.search_function(a.name, a.cls),
        "inheritance": lambda: g.inheritance(a.name, a.direction, a.depth),
        "callers": lambda: g.callers(a.name, a.cls),
        "callees": lambda: g.callees(a.name, a.cls),
        "overrides": lambda: g.overrides(a.name, a.cls),
        "code-docs": lambda: g.code_docs(a.name),
        "file-symbols": lambda: g.file_symbols(a.path),
        "traverse": lambda: g.traverse(a.names, a.relations, a.direction, a.depth, a.mode),
        "search-docs": lambda: g.search_docs(a.query, a.tag, min_confidence=a.min_confidence),
        "blast-radius": lambda: g.blast_radius(a.symbols, a.files, a.depth),
        "include": lambda: g.include_impact(*a.files),
        "stats": g.stats,
    }[a.command]()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lodegraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    answer(spark, a).show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
