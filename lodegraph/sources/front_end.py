"""Running a C++ front end over compile commands on the cluster (E-01, E-02).

The front end itself is not part of this package: it is a function of a file and its arguments that
returns a parse result as in ``parse_results`` (its node and edge rows are E-03 to E-10).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.sources import parse_results

Parser = Callable[[str, list[str]], dict]


def parse_units(entries: DataFrame, make_parser: Callable[[], Parser], units_per_task: int = 16) -> DataFrame:
    """Parse results of ``entries(file, arguments)``, one row each, as ``parse_results.read`` gives them.

    ``make_parser`` is called once per task and may hold what a worker keeps between units. A unit whose
    parsing raises is a row of status failed with the error; the others go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = make_parser()
        for b in batches:
            out = []
            for file, arguments in zip(b["file"], b["arguments"], strict=True):
                try:
                    result = {"source_path": file, "status": "success", **parse(file, [] if arguments is None else list(arguments))}
                except Exception as e:  # noqa: BLE001
                    result = {"source_path": file, "status": "failed", "error_message": f"{type(e).__name__}: {e}"[:500]}
                out.append(json.dumps(result))
            yield pd.DataFrame({"result": out})

    tasks = max(1, -(-entries.count() // units_per_task))
    rows = entries.select("file", "arguments").repartition(tasks).mapInPandas(run, "result string")
    parsed = rows.select(F.from_json("result", parse_results.SCHEMA).alias("r")).select("r.*")
    lists = ("nodes", "edges", "includes")
    return parsed.select("source_path", "status", "error_message", *(F.coalesce(c, F.array().cast(parsed.schema[c].dataType)).alias(c) for c in lists))
