import random
from datetime import datetime

import pytest

pytest.importorskip("lodegraph.llm")

from lodegraph.llm import markup as m  # noqa: E402
from tests.conftest import rows  # noqa: E402

PLAIN = [
    "if (i<n && n>0) the loop is entered.", "The test a < b && c > d holds.", "Use std::map<Key, Value> as the store.", "std::vector<std::pair<int, bool>> is returned.",
    "Usage grew by 15% and costs 3$ per unit.", "Set $HOME before the first start.", "The path C:\\temp\\new is created.", "Flag ~0 means all, and !ready means wait.",
    "The destructor ~Handle() runs last.", "Call it with (*ptr)->next or ptr[0], never both.", "argv[1] names the output file.", "x_1 and x_2 bound it, with x_1 <= x_2.",
    "The field max_retry_count is read once.", "R&D boards use the C# bindings.", "The product 4 * 3 * 2 gives the size.", "operator<< and operator>> are both overloaded.",
    "Indices lie in [0, 10).", "2 * N buffers", "~Handle and friends", "Error code #2788", "Cost in $ per unit", "[[nodiscard]] int f();", "3.52 Startup of storage", "#include <map>",
    "auto f = [](int x) { return x; };", "__attribute__ and __FILE__ are set", "it costs $5 and $6", "v[i](x) is called", "vector<a> and list<b>", "a &b; c", "", "  ", "问题记录 2504",
]
MARKED = [
    "<p>Text</p>", "line<br>next", '<a href="x.html#y">F</a>: z', "<P ALIGN=left>Text", "&nbsp;x", "a &#8211; b", "<!-- page -->Text", "<pre><code>f(1);</code></pre>", '<ref name="a">b</ref>', "<nowiki>x</nowiki>",
    "## Heading", "Title ###", "Rules {#sec-76}", "**bold** x", "It is _rarely_ used", "an *own* word", "__Ablauf in lidar__", "~~gone~~ x", "call `f()` now", "see [a](../b/c.md)", "![p](img/a_1.png)", "[argv[0] handling](q.md)",
    "- item", "* item", "1. first", "- [ ] open", "- [x] done", "> quoted", "| a | b |\n|---|---|\n| 1 | c |", "```cpp\nf();\n```", "~~~\ng;\n~~~", "'''Bold''' x", "''it'' x", "== board ==", "[[A|b]]", "[[argv[0] handling]]", "[[ctl::Mock]]",
    "{{note|graph}}", '{| class="wikitable"\n|-\n| a || 1\n|}', "\\subsection{X}", "\\textbf{X}", "\\ref{sec:timer} x", "so.~\\cite{board80}", "$O(n \\log n)$", "$$ x_{1} \\leq \\sum_i y_i $$", "\\[ t = \\frac{1}{k} \\]",
    "\\begin{itemize}\n\\item a\n\\end{itemize}", "\\begin{verbatim}\nf(1);\n\\end{verbatim}",
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_stays(text):
    for heading in (False, True):
        assert m.clean(text, heading) == (text, [], 0)


@pytest.mark.parametrize("text", MARKED)
def test_markup_is_found(text):
    assert m.clean(text, heading=text.endswith("#"))[1]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<h3>Lock &amp; key</h3><p>One <b>two</b>.</p>", "### Lock & key\n\nOne two."),
        ("## A\n**b** and [c](d.md)\n- x\n- [ ] y", "## A\nb and c\n- x\n- y"),
        ("a\n```cpp\nif (a < b) *p = `x`;\n```\nb", "a\n\n```\nif (a < b) *p = `x`;\n```\n\nb"),
        ("| a | b |\n|---|---|\n| 1 | `c` |", "| a | b |\n| 1 | c |"),
        ('{| class="w"\n|-\n| a || 1\n|-\n| b || 2\n|}', "| a | 1 |\n| b | 2 |"),
        ("\\begin{itemize}\n\\item one\n\\item \\textbf{two}\n\\end{itemize}", "- one\n- two"),
        ("The cost is $O(n \\log n)$ and \\[ t = 1 \\]", "The cost is $O(n \\log n)$ and $t = 1$"),
        ("'''X''' uses [[ns::Y|the y]].", "X uses the y."),
        ("== H ==\nText<!-- c -->", "## H\nText"),
        ("<ul><li>a</li><li>b</li></ul>", "- a\n- b"),
        ("<table><tr><td>a</td><td>1</td></tr></table>x", "| a | 1 |\n\nx"),
        ("{{note|x}}\nText goes on", "Text goes on"),
        ("<div><!-- c --></div>", ""),
    ],
)
def test_clean_text_keeps_structure(text, want):
    assert m.clean(text)[0] == want


def test_heading_field():
    assert m.clean("## **Why X** exists ###", heading=True)[0] == "Why X exists"
    assert m.clean("\\subsection{A <b>c</b>}", heading=True)[0] == "A c"


def test_region_is_the_best_of_all():
    r = random.Random(9)
    for _ in range(200):
        text = "".join(r.choice(["word ", "two words ", "<b>", "</b>", "<!-- x -->", "{{t|a}}"]) for _ in range(r.randrange(12)))
        found = m.lex(text)
        weights = {"word": 1.0, "tag": -1.5, "comment": -2.5, "template": -2.5, "other": -1.0}
        bounds = sorted({0, len(text), *(x for c in found for x in (c.start, c.end))})

        def score(a, b, text=text, found=found, weights=weights):
            at, s = a, 0.0
            for c in found:
                if c.start >= a and c.end <= b:
                    s += len(m._SCORED.findall(text, at, c.start)) + weights[c.kind]
                    at = c.end
            return s + len(m._SCORED.findall(text, at, b))

        a, b = m.content_region(text, found, weights)
        assert score(a, b) == max([0.0, *(score(x, y) for x in bounds for y in bounds if x <= y)])


def test_weights_from_labelled_pages(spark):
    nav = "<div><b><a>home</a></b></div>{{menu|x}}<!-- nav -->"
    data = [(f"{nav} This page {i} tells a <b>long</b> story of words {nav}", f"This page {i} tells a <b>long</b> story of words") for i in range(30)]
    data += [("x", None), (None, "y"), ("x", "not in it")]
    weights = m.fit_weights(spark.createDataFrame(data, "text string, content string"))
    assert weights["word"] > 0 > weights["template"] and weights["tag"] < 0
    held_out = f"{nav} Another page has <b>other</b> words {nav}"
    a, b = m.content_region(held_out, m.lex(held_out), weights)
    assert held_out[a:b].strip() == "Another page has <b>other</b> words"
    assert m.fit_weights(spark.createDataFrame([], "text string, content string")) == m.WEIGHTS


def test_sections(spark):
    at = [datetime(2024, 1, d) for d in (1, 2, 3)]
    data = [
        (1, "doc_section", "## A", "plain", at[0], 9), (1, "doc_section", "A", "<p>x</p>", at[1], 9), (1, "doc_section", "A", "<p>x</p>", at[1], 9),
        (2, "function", "## f", "<p>x</p>", at[0], 9), (3, "doc_section", None, "", at[0], 9), (4, "doc_section", "`c`", None, None, 9),
        (None, "doc_section", "## z", None, at[0], 9), (5, "doc_section", "long", "**b** " * 60_000, at[0], 9), (6, "doc_section", "## A", None, at[0], 9), (6, "class", None, None, at[2], 9),
    ]
    node = spark.createDataFrame(data, "id long, type string, heading string, content_preview string, updated_at timestamp, field int")
    out = m.clean_sections(node)
    assert rows(out.where("n_constructs > 0"), "node_id", "field") == [(1, "content_preview"), (4, "heading"), (5, "content_preview")]
    assert rows(out.where("node_id IN (1, 3, 4)"), "node_id", "field", "clean_text") == [(1, "content_preview", "x"), (1, "heading", "A"), (3, "content_preview", ""), (4, "heading", "c")]
    assert m.clean_sections(node.limit(0)).count() == 0


CODE = "if (a < b) { call(a, *b); }\n"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A text. <script>" + CODE * 40_000 + "</script> More of it.", "A text.  More of it."),
        ("A text. `" + "f(x) " * 200_000 + "` More of it.", "A text. " + ("f(x) " * 200_000).strip() + " More of it."),
        ("A text. $$" + "x_1 + " * 170_000 + "y$$ More of it.", "A text. $" + "x_1 + " * 170_000 + "y$ More of it."),
        ("**" + "word " * 200_000 + "end** x", "word " * 200_000 + "end x"),
        ("{{infobox|name={{lang|en|Reader}}|x=1}}\nThe reader takes all of it.", "The reader takes all of it."),
        ("{{a|" * 3_000 + "x" + "}}" * 3_000 + " The text goes on.", "The text goes on."),
        ("\\textbf{" * 3_000 + "the text" + "}" * 3_000, "the text"),
        ("[[" + "a|" * 3_000 + "the text]]", "the text"),
        ("~~**" * 2_000 + "the text" + "**~~" * 2_000, None),
        ("1234567. the text", "1234567. the text"),
        ("******** deep item", "- deep item"),
        ("vector<a> and " + "word " * 3_000 + '<a href="x.html">y</a>', "vector<a> and " + "word " * 3_000 + "y"),
    ],
)
def test_no_distance_or_depth_is_limited(text, want):
    import time

    start = time.process_time()
    got = m.clean(text)
    assert time.process_time() - start < 20
    assert got.kinds or want == text
    assert want is None or got.text == want


def test_marks_far_apart_in_a_table_and_in_the_tables(spark):
    long_ones = ["`" + "f(x) " * 200_000 + "`", "$$" + "x " * 500_000 + "$$", "<script>" + CODE * 30_000 + "</script>x"]
    node = spark.createDataFrame([(i, "doc_section", None, t, None) for i, t in enumerate(long_ones)], "id long, type string, heading string, content_preview string, updated_at timestamp")
    assert rows(m.clean_sections(node).where("n_constructs > 0"), "node_id") == [(0,), (1,), (2,)]


LONG = [
    "**a ", "__a b", "~~a ", "`a", "''a ", "<p>", "v<a> ", "<math>", "\\[x ", "\\(x ", "$$a", "[a", "[[a", "{{a|", "\\cmd{", "| a ", "# a  ", "*a", "_a", "&a", "<!--", "(", "'''", "> ", "- [", "<a x=", "a\n\n", "<",
    "{", "\\begin{a}", "<pre>", "$a", "~~~", "== a ",
]


@pytest.mark.parametrize("piece", LONG)
def test_time_is_in_proportion_to_length(piece):
    import time

    took = []
    for n in (4_000, 16_000):
        start = time.process_time()
        m.clean(piece * n)
        m.clean(piece + " " * n + "x")
        took.append(time.process_time() - start)
    assert took[1] < max(10 * took[0], 3.0)
