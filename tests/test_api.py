import os

import pytest

from lodegraph import __main__ as cli
from lodegraph.api import CodeGraph, DocGraph
from lodegraph.operators import questions
from tests.conftest import rows
from tests.test_code_graph import edges_of, nodes_of
from tests.test_documents_and_store import FIND, doc, finding

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    n = nodes_of(
        spark, (1, "class", "Base"), (2, "struct", "Derived"), (3, "function", "run", {"namespace": "Base", "parent_class": "Base"}), (4, "function", "run", {"namespace": "Derived", "parent_class": "Derived"}),
        (5, "function", "main", {"file_path": "m.cpp"}), (9, "doc_section", "Guide"), (10, "doc_section", "Other"),
    )
    from pyspark.sql import functions as F

    n = n.withColumns({"doc_title": F.lit("T"), "content_preview": F.when(F.col("id") == 10, "see Derived twice: Derived").otherwise("lock the queue"), "tags": F.array(F.lit("x"))})
    e = edges_of(spark, (2, 1, "inherits_public"), (4, 3, "overrides"), (5, 3, "calls_virtual", 4), (9, 1, "doc_describes_code"), (3, 1, "belongs_to"), (4, 2, "belongs_to"))
    inc = spark.createDataFrame([("m.cpp", "a.h", False)], "source_file string, included_file string, is_system boolean")
    return CodeGraph(n, e.withColumn("confidence", F.lit(0.8)), inc)


def test_code_questions(small):
    assert rows(small.search_class("Base"), "id") == [(1,)] and rows(small.search_class("deriv"), "id") == [(2,)] and small.search_class("zzz").count() == 0
    assert rows(small.search_function("run", "Derived"), "id") == [(4,)]
    assert rows(small.inheritance("Derived"), "node", "depth") == [(1, 1)] and rows(small.inheritance("Base", "descendants"), "node") == [(2,)]
    assert rows(small.callers("run", "Derived"), "caller_name", "call_type") == [("main", "calls_virtual_expanded")]
    assert small.callers("run").count() == 1
    assert rows(small.callees("main"), "node", "via") == [(3, "calls_virtual"), (4, "calls_virtual_expanded")]
    assert rows(small.overrides("run", "Base"), "node") == [(4,)]
    assert rows(small.call_chain("run", "Base"), "node") == [(5,)]
    assert rows(small.traverse(["Base"], depth=1), "node") == [(1,), (2,), (3,)]
    assert rows(small.traverse(["main"], ["calls_virtual"], mode="dfs"), "node") == [(3,), (5,)]
    with pytest.raises(ValueError, match="depth"):
        small.traverse(["Base"], depth=0)
    assert rows(small.blast_radius(["Base::run"], depth=1), "name") == [("main",), ("run",)]
    assert rows(small.include_impact("a.h"), "affected") == [("m.cpp",)]
    assert rows(small.search_docs("queue lock"), "id", "hits", "related_code") == [(9, 2, ["Base"])] and small.search_docs(" ").count() == 0
    assert rows(small.code_docs("Base"), "doc_id", "source") == [(9, "link")] and rows(small.code_docs("Derived"), "doc_id", "source") == [(10, "word")]
    assert small.stats().count() == 9


def test_document_questions(spark, small):
    d = doc(spark, "---\ntype: task\n---\n# Lock guide\nabout locks `Base` [b](1.md)", "# Queue\n[[x]] text", None)
    g = DocGraph(d, small.nodes)
    out = g.search("locks")
    assert rows(out["starts"], "key") == [("doc:d-0",)]
    assert rows(out["reached"]) == [("doc:d-0", 0), ("doc:d-1", 1), ("symbol:Base", 1)]
    assert rows(out["code"], "node_id") == [(1,)]
    assert rows(g.list("task"), "doc_id") == [(0,)] and rows(g.list(part="queue"), "doc_id") == [(1,)]
    from datetime import datetime

    cols = [c.split()[0] for c in FIND.split(", ")]
    f = finding("Locks", datetime(2024, 1, 1), ["Gone"])
    g.record(spark.createDataFrame([tuple(f[c] for c in cols)], FIND))
    assert g.search_findings("locks").count() == 1 and rows(g.check_freshness(), "after") == [("stale",)]
    assert g.stats().count() >= 4


def test_lists(spark):
    n = nodes_of(spark, (1, "function", "f", {"file_path": "a.h"}), (2, "function", "f", {"file_path": "b.cpp"}), (3, "function", "g", {"file_path": None}))
    assert rows(questions.definition_first(n, ["name"]), "id") == [(2,), (3,)]
    a = spark.createDataFrame([("planner",), ("std",), (None,)], "name string")
    b = spark.createDataFrame([("src_planning",), ("x",)], "folder string")
    assert rows(questions.shared_grams(a, b)) == [("planner",)]
    assert rows(questions.by_ids(n, spark.createDataFrame([(1,), (1,)], "id long")), "id") == [(1,)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_command_line(spark, tmp_path, capsys):
    from tests.test_sources_build_streaming import ONE, TWO, write

    for args in (["search-class", "reader"], ["stats"], ["traverse", "nothing"], ["include", "include/common/base_support.h"]):
        assert cli.main([DATA, *args]) == 0
    write(tmp_path / "in", one=ONE, two=TWO)
    assert cli.main([str(tmp_path / "out"), "import", str(tmp_path / "in")]) == 0
    assert cli.main([str(tmp_path / "inc"), "incremental", str(tmp_path / "in")]) == 0
    assert "partial" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["x", "unknown"])
