import json
import subprocess
from datetime import datetime as T

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import build, stats
from lodegraph.operators.store import SnapshotTable
from lodegraph.sources import compile_commands, files, parse_results
from lodegraph.streaming import jobs
from tests.conftest import rows


def node(kind, name, path="a.cpp", ns="", line=1, key=None, **extra):
    key = key or f"{kind}|{ns}|{name}|{path}" + ("|" + ",".join(extra.get("param_types", [])) if kind == "function" else "")
    return {"type": kind, "name": name, "namespace": ns, "file_path": path, "start_line": line, "end_line": line + 5, "unique_key": key, "extra_info": extra}


def edge(rel, a, b="", **extra):
    return {"relation_type": rel, "from_unique_key": a, "to_unique_key": b, "extra_info": extra}


BASE, DER = "class||Base|a.h", "class||Derived|a.cpp"
BF, DF, MAIN = "function|Base|f|a.h|int", "function|Derived|f|a.cpp|int", "function||main|m.cpp|"
ONE = {
    "source_path": "a.cpp", "status": "success",
    "nodes": [
        node("class", "Base", "a.h"), node("class", "Derived"), node("function", "f", "a.h", "Base", 3, param_types=["int"], is_virtual=True, is_pure_virtual=True),
        node("function", "f", "a.cpp", "Derived", 9, param_types=["int"], is_override=True), node("class", "Base", "a.h"), node("weird", "W"),
    ],
    "edges": [
        edge("inherits_public", DER, BASE), edge("belongs_to", BF, BASE), edge("belongs_to", DF, DER),
        edge("overrides", DF, "", function_name="f", derived_class="Derived", _needs_resolution=True, _resolve_hint="override"),
        edge("odd_relation", DF, DER), edge("calls_direct", "function||nobody|x|", BF),
    ],
    "includes": [{"source_file": "a.cpp", "included_file": "a.h", "is_system": False}] * 2,
}
TWO = {
    "source_path": "m.cpp", "status": "partial",
    "nodes": [node("function", "main", "m.cpp", "", 1), node("class", "Al", "m.cpp")],
    "edges": [
        edge("calls_virtual", MAIN, "", callee_name="f", callee_parent_class="Base", callee_param_types=["int"], call_line=4, _needs_resolution=True),
        edge("calls_virtual", MAIN, "", callee_name="f", callee_parent_class="Base", callee_param_types=["int"], call_line=4, _needs_resolution=True),
        edge("type_alias", "class||Al|m.cpp", "", target_simple_name="Derived", _needs_resolution=True, _resolve_hint="type_alias"),
        edge("calls_direct", MAIN, "", callee_name="unknown", call_line=5, _needs_resolution=True),
    ],
    "includes": [{"source_file": "m.cpp", "included_file": "a.h"}],
}


def write(folder, **docs):
    folder.mkdir(parents=True, exist_ok=True)
    for name, doc in docs.items():
        (folder / f"{name}.json").write_text(doc if isinstance(doc, str) else json.dumps(doc))


def names(edges, nodes):
    n = nodes.select("id", F.concat_ws("::", "namespace", "name").alias("q"))
    j = edges.join(n.select(F.col("id").alias("src"), F.col("q").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("q").alias("b")), "dst")
    return rows(j, "a", "relation_type", "b")


WANT = [
    ("::Al", "type_alias", "::Derived"), ("::Derived", "inherits_public", "::Base"), ("::main", "calls_virtual", "Base::f"), ("Base::f", "belongs_to", "::Base"),
    ("Derived::f", "belongs_to", "::Derived"), ("Derived::f", "overrides", "Base::f"),
]


def test_parse_results_to_graph(spark, tmp_path):
    write(tmp_path / "x" / "deep", one=ONE)
    write(tmp_path / "x", two=TWO, bad="{not json")
    results = parse_results.read(spark, str(tmp_path / "x"))
    nodes, edges, includes, statuses = build.build(results)
    assert rows(nodes.groupBy("type").count()) == [("class", 4), ("function", 3)]
    assert names(edges, nodes) == WANT
    assert includes.count() == 2
    assert sorted(r.status for r in statuses.collect()) == ["failed", "partial", "success"]
    assert parse_results.edges(results).where("original_relation = 'odd_relation'").count() == 1
    assert parse_results.merged_status(results).first().status == "partial"
    assert rows(build.affected(includes, spark.createDataFrame([("M", "a.h"), ("M", "z.cpp")], "status string, file string"))) == [("a.cpp",), ("m.cpp",), ("z.cpp",)]


def test_refresh(spark, tmp_path):
    write(tmp_path / "x", one=ONE, two=TWO)
    nodes, edges, _, _ = build.build(parse_results.read(spark, str(tmp_path / "x")))
    none = spark.createDataFrame([], "status string, file string")
    same = build.refresh(nodes, edges, parse_results.read(spark, str(tmp_path / "x")), none)
    assert names(same[1], same[0]) == WANT and same[0].count() == nodes.count()

    shorter = {**TWO, "nodes": TWO["nodes"][:1], "edges": [edge("calls_direct", MAIN, DF, call_line=7)]}
    write(tmp_path / "y", two=shorter, failed={"source_path": "a.cpp", "status": "failed", "nodes": [], "edges": [], "includes": []})
    n2, e2 = build.refresh(nodes, edges, parse_results.read(spark, str(tmp_path / "y")), none)
    assert names(e2, n2) == sorted([x for x in WANT if x[0] not in ("::Al", "::main")] + [("::main", "calls_direct", "Derived::f")])
    gone = spark.createDataFrame([("D", "a.h")], "status string, file string")
    empty = parse_results.read(spark, str(tmp_path / "y")).limit(0)
    n3, e3 = build.refresh(n2, e2, empty, gone)
    assert n3.where("file_path = 'a.h'").count() == 0 and names(e3, n3) == [("::main", "calls_direct", "Derived::f"), ("Derived::f", "belongs_to", "::Derived")]


def test_graph_refresher_stream(spark, tmp_path):
    job = jobs.GraphRefresher(spark, str(tmp_path / "graph"))
    write(tmp_path / "in", one=ONE)
    job.start(str(tmp_path / "in")).awaitTermination()
    write(tmp_path / "in", two=TWO)
    job.start(str(tmp_path / "in")).awaitTermination()
    nodes, edges = job.state()
    assert names(edges, nodes) == WANT
    before = job.last_batch()
    job.take(spark.createDataFrame([], parse_results.schema()), before)  # a batch that comes again
    job.start(str(tmp_path / "in")).awaitTermination()  # nothing new
    assert job.last_batch() == before


def test_stream_takes_deletions_failures_and_changed_headers_over(spark, tmp_path):
    def unit(name, status="success", includes=(), nodes=()):
        return {
            "source_path": name, "status": status, "edges": [], "includes": [{"source_file": name, "included_file": i, "is_system": False} for i in includes],
            "nodes": [{"type": "function", "name": n, "namespace": "", "file_path": name, "start_line": 1, "end_line": 2, "unique_key": f"function|{n}"} for n in nodes],
        }

    job = jobs.GraphRefresher(spark, str(tmp_path / "graph"))
    folder = tmp_path / "in"

    def arrive(**docs):
        write(folder, **docs)
        job.start(str(folder)).awaitTermination()

    arrive(a=unit("src/a.cpp", includes=["src/x.h"], nodes=["fa"]), b=unit("src/b.cpp", includes=["src/y.h"], nodes=["fb"]), c=unit("src/c.cpp", "failed"), y=unit("src/y.h", includes=["src/x.h"]))
    assert rows(job.pending()) == [("src/c.cpp", "failed")]
    arrive(d=unit("src/x.h", "modified"))
    assert rows(job.pending()) == [("src/a.cpp", "include"), ("src/b.cpp", "include"), ("src/c.cpp", "failed")]
    arrive(e=unit("src/a.cpp", includes=["src/x.h"], nodes=["fa", "fa2"]), f=unit("src/b.cpp", "deleted"), g=unit("src/c.cpp", nodes=["fc"]))
    assert rows(job.pending()) == []
    nodes, _ = job.state()
    assert rows(nodes, "name") == [("fa",), ("fa2",), ("fc",)]
    assert rows(job.store.read("statuses"), "source_file") == [("src/a.cpp",), ("src/c.cpp",), ("src/y.h",)]
    assert rows(job.store.read("includes"), "source_file") == [("src/a.cpp",), ("src/y.h",)]
    assert job.store.version() == 3


def test_front_end(spark):
    from lodegraph.sources import front_end

    def make_parser():
        done = []

        def parse(file, arguments):
            if "bad" in file:
                raise OSError("no such file")
            done.append(file)
            return {**ONE, "source_path": file, "status": "partial" if "-x" in arguments else "success"}

        return parse

    entries = spark.createDataFrame([("a.cpp", ["-x"]), ("bad.cpp", []), ("c.cpp", None)], "file string, arguments array<string>")
    got = front_end.parse_units(entries, make_parser, 2)
    assert rows(got, "source_path", "status", "error_message") == [("a.cpp", "partial", None), ("bad.cpp", "failed", "OSError: no such file"), ("c.cpp", "success", None)]
    assert parse_results.nodes(got).count() == 5 and front_end.parse_units(entries.limit(0), make_parser).count() == 0


def test_snapshot_table(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    assert table.version() == 0
    assert table.publish(spark.range(3)) == 1 and table.publish(spark.range(5)) == 2
    assert table.read().count() == 5 and table.read(1).count() == 3


def test_a_writer_that_is_overtaken_changes_nothing(spark, tmp_path):
    from lodegraph.publish import TakenError

    table, other = SnapshotTable(spark, str(tmp_path / "t")), SnapshotTable(spark, str(tmp_path / "t"))
    base = table.version()
    assert other.publish(spark.range(3), base=base) == 1
    with pytest.raises(TakenError):
        table.publish(spark.range(99), base=base)
    assert table.read(1).count() == 3 and table.version() == 1
    assert len(table.sweep(hours=0)) == 1 and table.read().count() == 3 and table.publish(spark.range(4)) == 2
    from concurrent.futures import ThreadPoolExecutor

    def race(k):
        try:
            return table.store.published.publish(9, {"k": k}) or k
        except TakenError:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [k for k in pool.map(race, range(8)) if k is not None]
    assert len(won) == 1 and table.store.published.entry(9) == {"k": won[0]}


def test_compile_commands(spark, tmp_path):
    data = [
        {"file": "src/a.cpp", "directory": "/p", "command": 'g++ -O2 -Wall -isystem /usr/inc -D"X=1" -o a.o -c src/a.cpp -std=c++17'},
        {"file": "/p/src/b.h", "directory": "/p", "arguments": ["g++", "-pedantic", "-Iinc", "/p/src/b.h"]},
        {"file": "/p/third/c.cc", "directory": "/p", "arguments": ["g++", "-c", "/p/third/c.cc"]},
    ]
    (tmp_path / "c.json").write_text(json.dumps(data))
    entries = compile_commands.read(spark, str(tmp_path / "c.json"))
    got = {r.file: r.a for r in entries.select("file", compile_commands.clean_arguments("arguments").alias("a")).collect()}
    assert got == {"/p/src/a.cpp": ["-O2", "-isystem/usr/inc", "-DX=1", "-std=c++17"], "/p/src/b.h": ["-Iinc", "/p/src/b.h"], "/p/third/c.cc": []}
    assert [r.file for r in compile_commands.select(entries, ["/src/", "/third/"], ["third"]).collect()] == ["/p/src/a.cpp"]
    assert compile_commands.select(entries, [], ["third"], keep_headers=True).count() == 2
    wanted = spark.createDataFrame([("src/a.cpp",), ("/p/third/c.cc",), ("none.cc",), ("hird/c",), ("/root/p/third/c.cc",), ("c",), ("",)], "wanted string")
    assert rows(compile_commands.lookup(entries, wanted), "wanted", "file") == [
        ("/p/third/c.cc", "/p/third/c.cc"), ("/root/p/third/c.cc", "/p/third/c.cc"), ("c", "/p/src/a.cpp"), ("hird/c", "/p/third/c.cc"), ("src/a.cpp", "/p/src/a.cpp"),
    ]
    assert entries.select(compile_commands.cross_flags("arguments", "arm", ["/x"]).alias("a")).first().a[-2:] == ["--target=arm", "-isystem/x"]


def test_markdown_folder_and_frontmatter(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.md").write_text("# Größe\n中文")
    (tmp_path / "d" / "sub" / "2024-05-06-b.md").write_bytes("标题".encode("gbk"))
    (tmp_path / "d" / "skip.md").write_text("x")
    (tmp_path / "d" / "no.txt").write_text("x")
    got = files.read_markdown(spark, str(tmp_path / "d"), ["skip*"])
    assert rows(got, "path", "text") == [("a.md", "# Größe\n中文"), ("sub/2024-05-06-b.md", "标题")]
    head = files.with_frontmatter(got).where("path LIKE 'sub%'").first().text
    assert head.startswith("---\ndoc_id: 2024-05-06-b\ntype: doc\ndate: 2024-05-06\n---\n\n标题")
    tagged = files.with_frontmatter(got, {"标题": "title", "sub/": "folder", "zz": "none"}).where("path LIKE 'sub%'").first().text
    assert "\ntags: [folder]\n---" in tagged
    marked = files.with_marks(spark.createDataFrame([("- **关联**: Foo, `Bar`, ns::Baz() and x.cpp\nsee docs/a/b.md and [c](c.md) or `d.md`",)], "text string"))
    assert marked.first().text == "- **关联**: `Foo`, `Bar`, ns::Baz() and x.cpp\nsee [b](docs/a/b.md) and [c](c.md) or `d.md`"
    sites = spark.createDataFrame([("a.md", 1), ("a.md", 9)], "file string, line int")
    assert rows(files.site_lines(sites, got)) == [("a.md", 1, "# Größe")]


def test_configuration(spark):
    text = json.dumps({"project": {"name": "p"}, "source_paths": ["src"], "unknown": 1, "tag_rules": [{"path_pattern": "a/*", "tags": ["x"]}], "manual_links": [{"doc": "guide", "heading": "H", "code": ["A", "B"]}, {"doc": "all", "code": ["A"]}]})
    c = files.ProjectConfig.load(text)
    assert (c.name, c.source_paths, c.rules()) == ("p", ["src"], [("a/*", ["x"])])
    sections = spark.createDataFrame([(1, "docs/guide.md", "H"), (2, "docs/guide.md", "other"), (3, "all.md", None)], "id long, path string, heading string")
    code = spark.createDataFrame([(10, "A"), (11, "B")], "id long, name string")
    assert rows(files.configured_links(c.links(spark), sections, code), "doc_id", "code_id") == [(1, 10), (1, 11), (3, 10)]


def test_git_changes(spark, tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a.txt").write_text("one\n" * 30)
    (tmp_path / "b.txt").write_text("b")
    git("add", "-A")
    git("commit", "-qm", "x")
    (tmp_path / "a.txt").rename(tmp_path / "moved file.txt")
    (tmp_path / "b.txt").write_text("c")
    git("add", "-A")
    git("commit", "-qm", "y")
    spark.dataSource.register(files.GitChanges)
    got = spark.read.format("git_changes").option("path", str(tmp_path)).load()
    assert rows(got) == [("A", "moved file.txt"), ("D", "a.txt"), ("M", "b.txt")]
    assert len(files.git_head(str(tmp_path))) == 40 and files.git_head(str(tmp_path / "none")) is None
    assert files.admitted(got, 3) and not files.admitted(got, 2) and not files.admitted(got.limit(0), 3)
    assert rows(files.listed_changes(spark, ["q"])) == [("M", "q")]


def test_telemetry_batch_and_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    calls = [(T(2024, 1, 1, 0, i), "t", {"q": "x"}, i % 2, float(i)) for i in range(10)]
    files.append_telemetry(spark.createDataFrame(calls, files.TELEMETRY), path)
    (tmp_path / "log" / "more.json").write_text('{"ts":"2024-01-01T05:00:00.000Z","tool":"u","n_results":1,"duration_ms":2.0}\nbroken\n')
    got = files.read_telemetry(spark, path)
    assert got.count() == 11
    assert rows(stats.tool_usage(got)) == [("t", 10, 5, 0.5, 4.5, 9.0), ("u", 1, 0, 0.0, 2.0, 2.0)]
    q = jobs.windowed_usage(files.read_telemetry(spark, path, stream=True)).writeStream.format("memory").queryName("usage").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("usage"), "tool", "n", "n_empty") == [("t", 10, 5)]


def test_finding_states_stream(spark, tmp_path):
    schema = "id string, symbol string, known boolean"
    folder = tmp_path / "ev"
    spark.createDataFrame([("a", "X::f", False), ("a", "x.service", True), ("b", "Y", True)], schema).coalesce(1).write.json(str(folder / "1"))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(str(folder))
        q = jobs.finding_states(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return rows(spark.read.parquet(str(tmp_path / "out")))

    assert run() == [("a", "active", "stale")]
    spark.createDataFrame([("a", "Z", True), ("b", "Y", False)], schema).coalesce(1).write.json(str(folder / "2"))
    assert run() == [("a", "active", "stale"), ("a", "stale", "active"), ("b", "active", "stale")]


def test_truth_and_report(spark, tmp_path):
    data = {"classes": [{"name": "A", "supertypes": ["B"], "is_abstract": True}], "functions": [{"name": "f"}], "call_references": [{"symbol": "f", "references": [{"file": "x", "line": 3}]}]}
    (tmp_path / "t.json").write_text(json.dumps(data))
    truth = files.read_truth(spark, str(tmp_path / "t.json"))
    assert rows(truth["supertypes"]) == [("A", "B")] and truth["references"].first().line == 3
    lines = [r.line for r in files.report_lines(spark.createDataFrame([("a|b", 1)], "x string, n int"), "T").orderBy("place").collect()]
    assert lines == ["## T", "| x | n |", "|---|---|", "| a\\|b | 1 |"]
    files.write_graph_json(spark.range(2), spark.range(3), str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g" / "edges")).count() == 3
