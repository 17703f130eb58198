from datetime import datetime as T

from pyspark.sql import functions as F

from lodegraph.functions import text as t
from lodegraph.operators import documents as docs
from lodegraph.operators import findings, retrieval, stats, store
from tests.conftest import rows


def values(spark, f, *items):
    return [r[0] for r in spark.createDataFrame([(x,) for x in items], "c string").select(f("c")).collect()]


def test_name_functions(spark):
    assert values(spark, t.tail, "a::b", "a", None) == ["b", "a", None]
    assert values(spark, t.head, "a::b::c", "a") == ["a::b", "a"]
    assert values(spark, t.path_end, "/x/y/z.h", "z.h", "a\\b\\c") == ["y/z.h", "z.h", "b/c"]
    assert values(spark, lambda c: t.relative_path(c, ["proj/src", "gen"]), "/r/proj/src/a.h", "/q/gen/b.h", "/q/c.h") == ["a.h", "gen/b.h", "c.h"]
    assert values(spark, t.simple_type, "const std::vector<int> &", "ns::Foo *", "unsigned") == ["vector", "Foo", "unsigned"]
    assert values(spark, t.is_call_noise, "operator+", "operator", "operationsManager", "_M_x", "_Xfoo", "_x", "vector", "", None, "run") == [True, True, False, True, True, False, True, True, True, False]
    assert values(spark, t.is_likely_symbol, "ab", "API", "MCU_Boot", "kenum", "a.b", "Reader", None) == [False, False, False, False, False, True, False]
    assert values(spark, lambda c: t.in_scope(c, ["src"]), "a/src/b", "x", None) == [True, False, False]
    df = spark.createDataFrame([("a::B", "B", "f"), ("a", "B", "f"), ("", "", "f"), (None, "B", "f")], "n string, k string, f string")
    assert [r[0] for r in df.select(t.qualified_name("n", "k", "f")).collect()] == ["a::B::f", "a::B::f", "f", "B::f"]
    key = lambda kind, p, c: spark.range(1).select(t.node_key(F.lit(kind), F.lit("n"), F.lit("f"), F.lit(None).cast("string"), F.array(*map(F.lit, p)).cast("array<string>"), F.lit(c).cast("boolean"))).first()[0]
    assert (key("function", ["int", "T"], True), key("function", [], False), key("class", [], None)) == ("function|n|f||int,T|c", "function|n|f||", "class|n|f|")


def test_more_name_functions(spark):
    assert values(spark, t.last_segment, "a::b", "a", "a::", "", None) == ["b", "a", "a", None, None]
    assert values(spark, t.project_name, "/x/src/proj/db", "/x/src/_p/db", None) == ["proj", "", ""]
    assert values(spark, t.bare_references, "see task/a.md and [task/b.md](task/b.md)", None) == [["task/a.md"], []]
    assert rows(stats.time_range(spark.range(5), "id")) == [(0, 4)]


def test_word_functions(spark):
    assert values(spark, t.word_count, "中文 foo_bar 3", None, "") == [3, 0, 0]
    assert values(spark, t.terms, "kAppErrorMap 分区切换 x_1", None) == [["k", "app", "error", "map", "分", "区", "切", "换", "x", "1"], []]
    assert values(spark, t.names_in, "调用Foo函数 Bar, 3x _y") == [["Bar", "_y"]]
    df = spark.createDataFrame([("Foo_Bar",), ("fooXbar",), ("a\\b",)], "c string")
    assert [r[0] for r in df.select(t.contains_like("c", "foo_bar")).collect()] == [True, True, False]
    assert [r[0] for r in df.select(t.contains_like("c", "\\")).collect()] == [False, False, True]


def test_markdown_functions(spark):
    assert values(spark, t.wiki_links, "a [[ns::X]] [[Y]]") == [["ns::X", "Y"]]
    assert values(spark, t.backtick_symbols, "`A::b` `Reader` `API` `lower` `A::b`") == [["A::b", "Reader"]]
    assert values(spark, t.diary_symbols, "`init()` `x` `run now`") == [["init", "run now"]]
    assert values(spark, t.markdown_links, "[a](b.md) ![i](p.png) [w](https://x) [q](#z)") == [["b.md"]]
    assert values(spark, t.path_doc_id, "docs/a//b.md") == ["doc:docs-a-b"]
    df = spark.createDataFrame([("../x/y.md#s", "docs/a/b.md"), ("y.md", "b.md"), ("../../../q.md", "a/b.md")], "l string, s string")
    assert [r[0] for r in df.select(t.link_doc_id("l", "s")).collect()] == ["doc:docs-x-y", "doc:y", "doc:q"]
    assert values(spark, t.document_title, "x\n# T\n## U", "none", None) == ["T", "", ""]
    assert values(spark, t.severity, "### [P0] x", "x") == ["P0", None]
    assert values(spark, lambda c: t.diary_field(c, "结论"), "- **结论**: ok") == ["ok"]
    assert values(spark, lambda c: t.rule_tags(c, [("a/*", ["x", "y"]), ("*.md", ["y", "z"])]), "a/b.md", "q.txt") == [["x", "y", "z"], []]
    assert values(spark, lambda c: t.keyword_tags(c, {"lock": "sync", "queue": "data"}), "A Queue and a Lock") == [["data", "sync"]]
    assert values(spark, t.clean_heading, "[a](b) `c`") == ["a c"]
    d = spark.createDataFrame([("2024-01-02-x", "", T(2020, 1, 1)), ("x", "on 2023-03-04", T(2020, 1, 1)), ("x", "2023-99-99", T(2020, 1, 1))], "n string, b string, m timestamp")
    assert [str(r[0]) for r in d.select(t.document_date("n", "b", F.col("m"))).collect()] == ["2024-01-02", "2023-03-04", "2020-01-01"]


DOC = "doc_id long, path string, text string, title string, updated_at timestamp"


def doc(spark, *texts):
    return spark.createDataFrame([(i, f"d/{i}.md", x, None, T(2024, 1, 1)) for i, x in enumerate(texts)], DOC)


def test_sections(spark):
    d = doc(spark, "intro\n## A `x`\nbody\n### sub\nmore\n## B\n", "# T\nonly", "## C\n```\n## no\n```\nx", None, "")
    assert rows(docs.sections(d), "doc_id", "heading", "start_line", "end_line", "content") == [
        (0, "", 0, 0, "intro"), (0, "A x", 1, 4, "body\n### sub\nmore"), (0, "B", 5, 6, ""), (1, "T", 0, 1, "# T\nonly"),
        (2, "C", 0, 1, "```"), (2, "no", 2, 4, "```\nx"), (4, "4", 0, 0, ""),
    ]
    assert rows(docs.sections(d, fences=True).where("doc_id = 2"), "heading", "content") == [("C", "```\n## no\n```\nx")]
    long = " ".join(["word"] * 25)
    m = docs.merge_short(docs.sections(doc(spark, f"## A\nshort\n## B\nalso\n## C\n{long}\n## D\nx")))
    assert rows(m, "heading", "end_line", "content") == [("A", 3, "short\n\nalso"), ("C", 7, f"{long}\n\nx")]
    node = docs.section_nodes(m, [("d/*", ["q"])]).where("heading = 'A'").first()
    assert (node.unique_key, node.word_count, node.tags, len(node.content_hash)) == ("doc_section|d/0.md|0", 2, ["q"], 16)
    assert [r.in_code for r in docs.lines(doc(spark, "a\n```\nb\n```\nc")).orderBy("line_no").collect()] == [False, True, True, True, False]


def test_frontmatter_and_summary(spark):
    d = doc(spark, "---\ntype: task # c\ntags: [a, 'b']\nrelates_to:\n  - x-y\ncode_symbols: [Foo]\n---\n# T\n> q\n\n- i1\n\npara one\ntwo\n\nx", "---\nopen: 1", "- a\n1. b\n| t | u |\n```\nc\n```", None)
    fm = {r.doc_id: r.fields for r in docs.frontmatter(d).collect()}
    assert fm == {0: {"type": ["task"], "tags": ["a", "b"], "relates_to": ["x-y"], "code_symbols": ["Foo"]}, 1: {}, 2: {}, 3: {}}
    first = lambda x, skip, most: docs.first_paragraphs(doc(spark, x), skip, most).first()["summary"]
    assert first("# T\n> q\n\n- i\n\npara one\ntwo\n\nx", True, 200) == "para one two"
    assert first("# T\n> q\n>\n> r\n\npara", False, 200) == "q r" and first("# T\n> q\npara", True, 200) == "para"
    assert first("- a\n1. b\n- c\n- d", True, 200) == "a | b | c"
    assert first("x" * 300, True, 20) == "x" * 17 + "..." and first("```\ncode\n```\n| a | b |\nt", True, 20) == "t" and first(None, True, 9) == ""
    n = {r.doc_id: r for r in docs.document_nodes(d).collect()}
    assert (n[0].type, n[0].title, n[0].manual, n[1].manual, n[1].key) == ("task", "T", True, False, "doc:d-1")
    e = docs.document_edges(doc(spark, "---\nrelates_to: [d-1]\n---\n[a](1.md) `Foo`\n```\n`Bar`\n```\n"))
    assert rows(e) == [(0, "doc:d-1", "relates_to", True), (0, "symbol:Foo", "mentions_symbol", False)]
    k = docs.knowledge_nodes(doc(spark, "## Why X?\n- **类型**: fix\n- **结论**: done\n- **影响**：all\n- **会话**: 0af3 x\n### [P1] y\n```\n- **类型**: no\n```\n", "## Z\n- **影响**: some\n\nA text."))
    assert rows(k, "key", "summary", "kind", "conclusion", "session", "severity") == [
        ("know:0/000-why-x", "done", "fix", "done", "0af3", "P1"), ("know:1/000-z", "A text.", None, "some", None, None),
    ]
    e = docs.document_edges(doc(spark, "---\ndoc_id: own\n---\nx", "[a](0.md) [b](2.md)"))
    assert rows(e) == [(1, "doc:d-2", "relates_to", False), (1, "doc:own", "relates_to", False)]


def test_links_between_documents_and_code(spark):
    known = spark.createDataFrame([("doc:a-b",), ("doc:c-b2",), ("doc:x-b2",)], "key string")
    e = spark.createDataFrame([(1, "doc:a-b"), (2, "doc:b"), (3, "doc:b2"), (4, "doc:none")], "src long, dst string")
    assert rows(docs.repair_links(e, known)) == [(1, "doc:a-b"), (2, "doc:a-b")]
    parts = spark.createDataFrame([(1, "uses Reader and Reader::x, 调用Writer啊"), (2, None)], "part_id long, text string")
    names = spark.createDataFrame([("Reader",), ("Writer",), ("ab",)], "name string")
    assert rows(docs.content_mentions(parts, names)) == [(1, "Reader", 2)]
    titles = spark.createDataFrame([(1, "The MyReaderImpl"), (2, "none"), (3, None)], "part_id long, title string")
    assert rows(docs.title_mentions(titles, names)) == [(1, "Reader")]
    pairs = spark.createDataFrame([(1, 2, 0.7, "content"), (1, 2, 0.9, "title")], "doc_id long, code_id long, confidence double, method string")
    assert rows(docs.association_edges(pairs)) == [(1, 2, "doc_describes_code", 0.9, "title"), (2, 1, "code_refers_to_doc", 0.9, "title")]
    assert docs.one_way_edges(docs.association_edges(pairs)).count() == 0


def test_bm25_by_hand(spark):
    import math

    texts = spark.createDataFrame([(1, "lock lock queue"), (2, "queue"), (3, "none at all here")], "key long, text string")
    got = {r.key: r.score for r in retrieval.bm25(texts, "LOCK").collect()}
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    assert list(got) == [1] and abs(got[1] - idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / (8 / 3)))) < 1e-9
    assert retrieval.bm25(texts, "!?").count() == 0 == retrieval.bm25(texts.limit(0), "lock").count()


def test_fusion_with_backstops(spark):
    r = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 2, 0), ("b", 3, 1), ("c", 9, 0), ("c", 8, 1)], "route string, key long, rank int")
    got = retrieval.fuse(r, 1, ("a",))
    assert rows(got, "place", "key", "routes") == [(1, 2, "a+b"), (2, 1, "a"), (3, 9, "c")]
    assert rows(retrieval.fuse(r, 1), "key") == [(1,), (2,), (9,)]


def test_search_routes(spark):
    texts = spark.createDataFrame(
        [(1, "MyReaderImpl", "", "a", ""), (2, "x", "a reader here", "b", None), (3, "y", "z", None, ""), (4, "y", None, "docs/reader/q.md", "r"), (5, None, None, None, None)],
        "key long, title string, summary string, path string, tags string",
    )
    mentions = spark.createDataFrame([(3, "MyReader"), (3, "Reader"), (5, "xreaderx")], "key long, name string")
    got = retrieval.document_search(texts, mentions, "reader")
    assert rows(got, "key", "routes") == [(1, "bm25+part"), (2, "bm25+part"), (3, "symbol"), (4, "bm25+part"), (5, "symbol")]
    assert rows(retrieval.document_search(texts, mentions, "reader", fields=("title",)), "key", "routes") == [(1, "bm25+part"), (3, "symbol"), (5, "symbol")]
    expand = lambda q, words: retrieval.expand_query(retrieval.synonym_pairs(spark, words), q)
    assert expand("app crash", {"崩溃": ["crash", "abort"]}) == ["崩溃"] and expand("崩溃", {"崩溃": ["crash", "Abort"]}) == ["crash", "Abort"] and expand("crash 崩溃", {"崩溃": ["crash"]}) == []
    e = spark.createDataFrame([("a", "b", "relates_to"), ("b", "S", "mentions_symbol"), ("c", "b", "relates_to"), ("d", "S", "mentions_symbol")], "src string, dst string, rel string")
    start = spark.createDataFrame([("a",)], "key string")
    assert rows(retrieval.reach_documents(start, e, 2), "node", "hop") == [("S", 2), ("a", 0), ("b", 1), ("c", 2)]


def test_bridge(spark):
    n = spark.createDataFrame(
        [(1, "f", "function", "C"), (2, "f", "function", None), (3, "BigPartner", "class", None), (4, "caller", "function", None), (5, "f", "file", None), (6, "partly", "struct", None), (7, "part", "function", "Q")]
        + [(100 + i, "many", "function", None) for i in range(9)],
        "id long, name string, type string, parent_class string",
    )
    s = spark.createDataFrame([("C::f",), ("symbol:f",), ("X::PART",), ("zzz",), ("many",), ("g",), (None,)], "symbol string")
    got = retrieval.bridge_symbols(s, n)
    assert rows(got.where("symbol <> 'many'")) == [("C::f", 1, 1), ("C::f", 2, 1), ("X::PART", 3, 3), ("X::PART", 7, 3), ("g", 3, 3), ("symbol:f", 1, 1), ("symbol:f", 2, 1)]
    assert rows(got.where("symbol = 'many'"), "node_id") == [(100 + i,) for i in range(5)]
    e = spark.createDataFrame([(4, 1, "calls_direct"), (1, 3, "calls_virtual"), (2, 1, "overrides")], "src long, dst long, relation_type string")
    calls = retrieval.bridge_calls(got.where("symbol = 'C::f'"), e, n)
    assert rows(calls, "node_id", "callers", "callees") == [(1, ["caller"], ["BigPartner"]), (2, [], [])]


def test_vectors(spark):
    import numpy as np

    r = np.random.default_rng(3)
    v = r.normal(size=(300, 16))
    v[200:260] = v[:60] + 0.05 * r.normal(size=(60, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, [0.0] * 16), (901, None)], "id long, vec array<float>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.9), strict=True) if i != j}
    exact = {(r.a_id, r.b_id) for r in retrieval.nearest(df.where("id % 50 = 0"), df, 0.9).collect()}
    assert exact == {(i, j) for i, j in want if i % 50 == 0}
    found = {(r.a_id, r.b_id) for r in retrieval.similar_pairs(df, df, 0.9).collect()}
    assert found <= want and len(found) >= 0.9 * len(want)


def test_all_similar_pairs_at_the_threshold_of_the_reference(spark):
    import numpy as np

    r = np.random.default_rng(4)
    v = r.normal(size=(250, 16))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.45), strict=True) if i != j}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, [0.0] * 16), (901, None)], "id long, vec array<double>")
    for block in (4096, 60):
        found = [(x.a_id, x.b_id) for x in retrieval.similar_pairs(df, df, 0.45, block).collect()]
        assert len(found) == len(want) and set(found) == want


def finding(title, at, symbols=(), **x):
    return {"title": title, "detail": x.get("detail"), "ftype": x.get("ftype", "fact"), "symbols": list(symbols), "source": "s", "confidence": "confirmed", "tags": ["t"], "updated_at": at, "embedding": x.get("vec")}


FIND = "title string, detail string, ftype string, symbols array<string>, source string, confidence string, tags array<string>, updated_at timestamp, embedding array<float>"


def test_findings(spark, tmp_path):
    cols = [c.split()[0] for c in FIND.split(", ")]
    make = lambda *fs: spark.createDataFrame([tuple(f[c] for c in cols) for f in fs], FIND)
    first = make(finding("A", T(2024, 1, 1), ["X::f", "svc.service", ""], detail="lock order"), finding(" A ", T(2024, 1, 2), ["X::f"], detail="deadlock"), finding("B", T(2024, 1, 3), ["Gone"], detail="queue", vec=[1.0, 0.0]), finding("", T(2024, 1, 1)), finding(None, T(2024, 1, 1), ftype="bad"))
    empty = spark.createDataFrame([], findings.SCHEMA)
    s = findings.upsert(empty, first)
    assert rows(s, "title", "detail", "status") == [("A", "deadlock", "active"), ("B", "queue", "active")]
    ids = dict(rows(s, "title", "id"))
    again = findings.upsert(s, make(finding("A", T(2024, 2, 1), ["Y"], detail="new")))
    assert dict(rows(again, "title", "id")) == ids and rows(again, "title", "detail", "created_at") == [("A", "new", T(2024, 1, 1)), ("B", "queue", T(2024, 1, 3))]
    assert rows(findings.upsert(again, make(finding("A", T(2024, 2, 1), ["Y"], detail="new"))), *findings.SCHEMA.split(" ")[0:1]) == rows(again, "id")
    assert findings.rejected(first).count() == 2
    assert [r.title for r in findings.by_symbols(s, ["X"]).collect()] == ["A"]
    n = spark.createDataFrame([("function", "f")], "type string, name string")
    assert rows(findings.freshness(s, n), "before", "after", "missing") == [("active", "stale", ["Gone"])]
    stale = findings.with_freshness(s, n, F.lit(T(2025, 1, 1)))
    assert rows(stale, "title", "status") == [("A", "active"), ("B", "stale")]
    back = spark.createDataFrame([("class", "MyGoneThing")], "type string, name string")
    assert rows(findings.freshness(stale, back), "before", "after") == [("active", "stale"), ("stale", "active")]
    assert [r.title for r in findings.in_display_order(stale).collect()] == ["A", "B"]
    assert [r.id for r in findings.search(s, "queue").collect()] == [ids["B"]]
    assert [r.id for r in findings.search(s, "lock", synonyms={"lock": ["deadlock"]}).collect()] == [ids["A"]]
    assert findings.search(s, "nothing").count() == 0 and findings.search(s, "").count() == 2
    assert findings.search(s, "queue", vector=[1.0, 0.0]).first().routes == "vector+words"
    assert rows(findings.without_vector(s), "id") == [(ids["A"],)]
    findings.export(s, str(tmp_path / "f"))
    assert rows(findings.import_(spark, str(tmp_path / "f"), again), "title", "detail") == [("A", "new"), ("B", "queue")]
    assert rows(findings.import_(spark, str(tmp_path / "f")), "title") == [("A",), ("B",)]


def test_store_operators(spark):
    k = "k string, v string, w int"
    a = spark.createDataFrame([("a", "1", 1), ("b", "2", 2), (None, "n", 0)], k)
    b = spark.createDataFrame([("b", None, 3), ("c", "4", 4), (None, "m", 9)], k)
    assert rows(store.upsert(a, b, ["k"])) == [("a", "1", 1), ("b", None, 3), ("c", "4", 4), (None, "m", 9)]
    assert rows(store.upsert(a, b, ["k"], keep=("v",))) == [("a", "1", 1), ("b", "2", 3), ("c", "4", 4), (None, "n", 9)]
    once = store.upsert(a, b, ["k"])
    assert rows(store.upsert(once, b, ["k"])) == rows(once)
    assert rows(store.insert_new(a.where("k IS NOT NULL"), b.where("k IS NOT NULL"), ["k"])) == [("a", "1", 1), ("b", "2", 2), ("c", "4", 4)]
    assert rows(store.classify(a.where("k IS NOT NULL"), b.where("k IS NOT NULL"), "k", "v")) == [("a", "deleted"), ("b", "updated"), ("c", "created")]
    assert rows(store.import_counts(a.where("k = 'b'"), b.where("k IS NOT NULL"), ["k"], ["v"])) == [(1, 1, 0)]
    assert store.upsert(a.limit(0), b, ["k"]).count() == 3 and store.upsert(a, b.limit(0), ["k"]).count() == 3


def test_stats(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", None, 2.0), ("b", "x", None)], "p string, q string, v double")
    assert rows(stats.distribution(df, "p", "q")) == [("p", "a", 2), ("p", "b", 1), ("q", "x", 2), ("q", None, 1)]
    many = spark.range(100).select(F.lit("k").alias("p"), F.col("id").cast("double").alias("v"))
    assert rows(stats.nearest_rank(many, ["p"], "v")) == [("k", 95.0)]
    assert rows(stats.nearest_rank(many.limit(1), ["p"], "v")) == [("k", 0.0)]
    e = spark.createDataFrame([("d", 1), ("d", 2), ("e", 1)], "dim string, k int")
    g = spark.createDataFrame([("d", 2), ("d", 3)], "dim string, k int")
    assert rows(stats.precision_recall(e, g, ["k"], "dim", 0.6, 0.5)) == [("d", 1, 1, 1, 0.5, 0.5, False), ("e", 0, 0, 1, 1.0, 0.0, False)]
    assert rows(stats.duplicates(df, ["p"])) == [("a", 2)]
    assert rows(stats.top_counts(df, ["p"], 1)) == [("a", 2)]
    assert rows(stats.numbered(df, "p", F.col("v")), "p", "number") == [("a", 1), ("a", 2), ("b", 1)]
