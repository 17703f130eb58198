"""Markup residue in text: HTML, Markdown, wiki and LaTeX to clean text that keeps its structure.

A text is read once, from left to right, into constructs and the plain text between them. A construct
that encloses text (emphasis, a link, a heading, a command) is an opening mark and a closing one; what
lies between is read on like any other text, so nesting has no bound. Partners of marks are looked up in
indexes that one pass over the text makes for each kind when it is first needed: braces and brackets
from a stack of the open ones, other marks by bisection. No distance and no depth is limited, and the
time stays in proportion to the text (times the logarithm of its marks).

Words score positive and markup negative, and one scan over these scores finds the contiguous region
with the largest sum: the content, without the markup, comments and templates around it. The region is
then written as plain text in which headings (``#``), list items (``-``), table rows (``|``), code
blocks (fences) and formulas (``$``) are kept in one form.

C++ code, comparison signs, paths, arithmetic and currency signs are no markup: a tag needs a known
name, emphasis must hug its text, a formula must contain more than a number, an attribute such as
``[[nodiscard]]`` is no link, and so on.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from html.entities import html5
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: names of public markup languages ----------------------------------------------

_BLOCK_TAGS = (
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul"
).split()
_INLINE_TAGS = (
    "a abbr acronym audio b bdi bdo big br button canvas cite code col colgroup data del dfn em embed font gallery i iframe img "
    "input ins kbd label link map mark math meta nowiki object option output picture q ref references rp rt ruby s samp script "
    "select small source span strike strong style sub sup svg syntaxhighlight template textarea time track tt u var video wbr"
).split()
_TAGS = {*_BLOCK_TAGS, *_INLINE_TAGS}
_VOID = {"br", "hr", "img", "wbr", "input", "meta", "link", "col", "source", "track", "embed"}
_CPP_ATTRIBUTES = {
    "assume", "carries_dependency", "deprecated", "fallthrough", "likely", "maybe_unused", "no_unique_address", "nodiscard", "noreturn", "unlikely", "indeterminate",
}
_LATEX_BARE = (
    "item maketitle noindent newline newpage clearpage par centering hline tableofcontents appendix bfseries itshape ttfamily small "
    "large Large LaTeX TeX ldots dots quad qquad smallskip medskip bigskip"
).split()
_DUNDERS = re.compile(r"[A-Z0-9_]+|(?:attribute|cplusplus|cdecl|declspec|stdcall|fastcall|asm|inline|restrict|thread|func|init|main|name|has_\w+|builtin_\w+|extension|typeof|volatile|const|int\d+|float\d+)")
_MATH_ENVS = {"equation", "align", "gather", "multline", "eqnarray", "displaymath", "math"}
_CODE_ENVS = {"verbatim", "lstlisting", "minted", "alltt"}

# --- weights --------------------------------------------------------------------------------------

#: Score of a word, and of each kind of construct; used where no labelled pages are given. Constructs are
#: left out wherever they stand, so their cost only decides which words lie outside: it is kept small.
WEIGHTS: dict[str, float] = {
    "word": 1.0, "tag": -0.3, "comment": -0.5, "template": -0.5, "entity": -0.2, "image": -0.5, "footnote": -0.5, "anchor": -0.5,
    "rule": -0.5, "definition": -0.5, "frontmatter": -1.0, "command": -0.3, "other": -0.2,
}
#: Labelled pages that weights are fitted on, at most.
FIT_PAGES = 10_000


class Construct(NamedTuple):
    """A piece of markup: its kind, its place, how it is written as plain text.

    ``holds``: the text in it is content (code, a formula), so its words score. ``part``: the closing
    mark of an earlier construct, which is not counted again.
    """

    kind: str
    start: int
    end: int
    write: str
    holds: bool = False
    part: bool = False


_WORD = re.compile(r"[\u4E00-\u9FFF]|[^\W_]+")
#: What scores as a word: a word, or a run of other marks such as punctuation.
_SCORED = re.compile(r"[\u4E00-\u9FFF]|[^\W_]+|[^\w\s]+|_+")
_STRUCTURE_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "td", "th", "dt", "dd"}
_ATTR = r"""(?:\s++[A-Za-z_:@][\w:.@-]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s"'<>=`]+))?)*+\s*+"""

_Rule = tuple[str, re.Pattern, Callable]
_AT: dict[str, list[_Rule]] = {}
_LINE: list[_Rule] = []


def _rule(chars: str, kind: str, pattern: str, flags: int = 0):
    def add(f: Callable) -> Callable:
        for c in chars:
            _AT.setdefault(c, []).append((kind, re.compile(pattern, flags), f))
        return f

    return add


def _line_rule(kind: str, pattern: str, flags: int = 0):
    def add(f: Callable) -> Callable:
        _LINE.append((kind, re.compile(pattern, flags | re.M), f))
        return f

    return add


#: Places that partners of marks are looked up in: the pattern matches at each of them.
_PLACES = {
    "blank": re.compile(r"\n(?=[^\S\n]*\n)"),
    "newline": re.compile(r"\n"),
    "angle": re.compile(r"[<>]"),
    "ticks": re.compile(r"`+"),
    "**": re.compile(r"(?<=\S)(?=\*\*(?!\*))"),
    "***": re.compile(r"(?<=\S)(?=\*{3}(?!\*))"),
    "__": re.compile(r"(?<=[^\s_])(?=__(?!\w))"),
    "~~": re.compile(r"(?<=[^\s~])(?=~~(?!~))"),
    "''": re.compile(r"(?<=[^\s'])(?='{2}(?!'))"),
    "'''": re.compile(r"(?<=[^\s'])(?='{3}(?!'))"),
    "'''''": re.compile(r"(?<=[^\s'])(?='{5}(?!'))"),
    "$$": re.compile(r"(?=\$\$)"),
    "\\]": re.compile(r"\\\]"),
    "\\)": re.compile(r"\\\)"),
    "]]>": re.compile(r"\]\]>"),
    "?>": re.compile(r"\?>"),
    "-->": re.compile(r"-->"),
}
for _n in ("pre", "syntaxhighlight", "source", "script", "style", "nowiki", "math"):
    _PLACES["</" + _n] = re.compile(rf"</{_n}\s*+>", re.I)
for _n in (*_MATH_ENVS, *_CODE_ENVS):
    _PLACES["\\end" + _n] = re.compile(rf"\\end\{{{_n}\*?\}}")
_BRACE, _BRACKET = re.compile(r"\\.|[{}]", re.S), re.compile(r"\\.|[\[\]\n]", re.S)
_ANY_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)\b")
_DEFINED = re.compile(r"^ {0,3}\[([^\]\n]+)\]:", re.M)


class _Reader:
    """A text being read: the indexes of its marks, and what is open where the reader stands."""

    def __init__(self, text: str):
        self.text = text
        self.found: dict[str, list[int]] = {}
        self.partner: dict[str, dict[int, int]] = {}
        self.floor = 0  # where the innermost open construct's text begins
        self.done = 0  # the end of the last construct
        self.limit = len(text)
        self.environments: list[str] = []
        self.tables: list[bool] = []  # of each open wiki table, whether a row is open

    def places(self, name: str) -> list[int]:
        got = self.found.get(name)
        if got is None:
            got = self.found[name] = [m.start() for m in _PLACES[name].finditer(self.text)]
        return got

    def next(self, name: str, at: int, end: int | None = None) -> int:
        """The first place from ``at`` on and before ``end`` (the limit), or -1."""
        got = self.places(name)
        k = bisect_left(got, at)
        return got[k] if k < len(got) and got[k] < (self.limit if end is None else end) else -1

    def last(self, name: str, at: int) -> int:
        """The last place before ``at``, or -1."""
        got = self.places(name)
        k = bisect_left(got, at)
        return got[k - 1] if k else -1

    def line_end(self, at: int) -> int:
        e = self.next("newline", at)
        return self.limit if e < 0 else e

    def paragraph_end(self, at: int) -> int:
        e = self.next("blank", at)
        return self.limit if e < 0 else e

    def pair(self, kind: str, at: int) -> int:
        """The partner of an opening brace, bracket (within its line) or tag, or -1."""
        got = self.partner.get(kind)
        if got is None:
            got = self.partner[kind] = {"{": self._braces, "[": self._brackets, "<": self._tags}[kind]()
        e = got.get(at, -1)
        return e if e < self.limit else -1

    def _braces(self) -> dict[int, int]:
        open_, out = [], {}
        for m in _BRACE.finditer(self.text):
            if m[0] == "{":
                open_.append(m.start())
            elif m[0] == "}" and open_:
                out[open_.pop()] = m.start()
        return out

    def _brackets(self) -> dict[int, int]:
        open_, out = [], {}
        for m in _BRACKET.finditer(self.text):
            if m[0] == "[":
                open_.append(m.start())
            elif m[0] == "\n" or m[0][-1] == "\n":
                open_.clear()
            elif m[0] == "]" and open_:
                out[open_.pop()] = m.start()
        return out

    def _tags(self) -> dict[int, int]:
        open_: dict[str, list[int]] = {}
        out = {}
        for m in _ANY_TAG.finditer(self.text):
            name = m[2].lower()
            if not m[1]:
                open_.setdefault(name, []).append(m.start())
            elif open_.get(name):
                out[open_[name].pop()] = m.start()
        return out

    def ticks(self, at: int, size: int, end: int) -> int:
        """The next run of exactly ``size`` backticks."""
        name = f"ticks{size}"
        if name not in self.found:
            self.found[name] = [m.start() for m in _PLACES["ticks"].finditer(self.text) if m.end() - m.start() == size]
        return self.next(name, at, end)

    def labels(self) -> set[str]:
        """Labels that a definition of a link gives, in lower case."""
        if "labels" not in self.partner:
            self.partner["labels"] = dict.fromkeys((m[1].lower() for m in _DEFINED.finditer(self.text)), 1)
        return self.partner["labels"]

    def before(self, at: int) -> str:
        """The character before, none where the text of a construct begins."""
        return self.text[at - 1] if at > self.floor else ""

    def back(self, at: int) -> int:
        """``at``, moved before the blanks there."""
        while at > self.done and self.text[at - 1] in " \t":
            at -= 1
        return at

    def ahead(self, at: int) -> int:
        """``at``, moved after the blanks there."""
        while at < self.limit and self.text[at] in " \t":
            at += 1
        return at


class _Found(NamedTuple):
    """What a rule gives: where its mark ends and how it is written, and the closing marks that follow, ``(start, end, write)``."""

    end: int
    write: str
    closers: tuple = ()
    holds: bool = False
    start: int = -1
    kind: str = ""  # where it is not the rule's


def _enclosed(m, close: int, size: int, end: int | None = None) -> _Found:
    """Text between marks that vanish."""
    return _Found(m.end() if end is None else end, "", ((close, close + size, ""),))


def _after_name(r: _Reader, at: int) -> bool:
    c = r.before(at)
    return c != "" and c.isascii() and (c.isalnum() or c in "_:)]")


def _fence(code: str) -> str:
    return "\n```\n" + code.strip("\n") + "\n```\n"


def _whole(m, write: str, holds: bool = False) -> _Found:
    return _Found(m.end(), write, (), holds)


# A rule's function gets the match and the reader; it returns what it found, or None where it is no markup.


@_rule("<", "comment", r"<!--|<!DOCTYPE[^<>]*>|<!\[CDATA\[|<\?(?:xml|php)\b", re.I)
def _comment(m, r):
    if m[0][-1] == ">":
        return _whole(m, "")
    close = "-->" if m[0] == "<!--" else "]]>" if m[0][1] == "!" else "?>"
    e = r.next(close, m.end())
    if e < 0:
        return _Found(r.limit, "") if close == "-->" else None
    return _Found(e + len(close), "")


@_rule("<", "code", r"<(pre|syntaxhighlight|source)\b" + _ATTR + ">", re.I)
def _pre(m, r):
    name = m[1].lower()
    e = r.next("</" + name, m.end())
    if e < 0 and name == "source":
        return None
    body = re.sub(r"</?(?:code|span)\b[^>]*>", "", r.text[m.end() : e if e >= 0 else r.limit])
    return _Found(r.text.index(">", e) + 1 if e >= 0 else r.limit, _fence(html.unescape(body)), (), True)


@_rule("<", "comment", r"<(script|style)\b" + _ATTR + ">", re.I)
def _script(m, r):
    e = r.next("</" + m[1].lower(), m.end())
    return None if e < 0 else _Found(r.text.index(">", e) + 1, "")


@_rule("<", "span", r"<(nowiki|math)\b" + _ATTR + ">", re.I)
def _raw(m, r):
    e = r.next("</" + m[1].lower(), m.end())
    if e < 0:
        return None
    body = r.text[m.end() : e]
    return _Found(r.text.index(">", e) + 1, f"${body.strip()}$" if m[1].lower() == "math" else body, (), True)


_TAG = r"<(/?)([A-Za-z][A-Za-z0-9]*+)(" + _ATTR + r")(/?)>"


@_rule("<", "structure", _TAG)
def _structure_tag(m, r):
    return _tag(m, r) if m[2].lower() in _STRUCTURE_TAGS else None


def _template_argument(r: _Reader, at: int) -> bool:
    """Whether a ``<`` follows a name, another template's arguments or ``#include``."""
    if _after_name(r, at):
        return True
    start = max(r.last("newline", at) + 1, r.floor)
    mark = r.last("angle", at)
    if mark > start and r.text[mark] == "<" and (r.text[mark - 1].isalnum() or r.text[mark - 1] == "_"):
        return True
    e = at
    while e > start and r.text[e - 1].isspace():
        e -= 1
    if r.text[max(start, e - 7) : e] != "include":
        return False
    e -= 7
    while e > start and r.text[e - 1].isspace():
        e -= 1
    return e > start and r.text[e - 1] == "#"


@_rule("<", "tag", _TAG)
def _tag(m, r):
    name = m[2].lower()
    if name not in _TAGS:
        return None
    if not m[1] and not m[4] and not m[3].strip() and name not in _VOID and _template_argument(r, m.start()) and r.pair("<", m.start()) < 0:
        return None  # template arguments, or a header's name
    if name[0] == "h" and name[1:].isdigit():
        write = "\n" if m[1] else "\n" + "#" * int(name[1:]) + " "
    elif name == "li" and not m[1]:
        write = "\n- "
    elif name in ("td", "th"):
        write = " |" if m[1] else " "
    elif name == "tr":
        write = "\n" if m[1] else "\n|"
    elif name == "img":
        alt = re.search(r"""\balt\s*=\s*(?:"([^"]*)"|'([^']*)')""", m[3])
        write = (alt[1] or alt[2] or "") if alt else ""
    elif name in ("br", "hr") or name in _BLOCK_TAGS:
        write = "\n"
    else:
        write = " " if name in ("ref", "references") else ""
    return _whole(m, write)


@_rule("<", "link", r"<((?:https?|ftp|mailto):[^\s<>]+)>")
def _autolink(m, r):
    return _whole(m, m[1], True)


@_rule("&", "entity", r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
def _entity(m, r):
    return None if m[0][1] != "#" and m[0][1:] not in html5 else _whole(m, html.unescape(m[0]).replace("\xa0", " "))


@_rule("&", "environment", "&")
def _column(m, r):
    if r.environments[-1:] != ["tabular"] or r.before(m.start()) == "\\":
        return None
    return _Found(r.ahead(m.end()), " | ", (), False, r.back(m.start()))


@_rule("`", "quote", r"``([^`'\n]+)''")
def _latex_quote(m, r):
    return _whole(m, f"\u201c{m[1]}\u201d", True)


@_rule("`", "span", r"`+")
def _code_span(m, r):
    size = m.end() - m.start()
    e = r.ticks(m.end() + 1, size, r.paragraph_end(m.end()))
    return None if e < 0 else _Found(e + size, r.text[m.end() : e].strip(), (), True)


@_rule("*", "emphasis", r"\*{2,3}(?=[^\s*])")
def _strong(m, r):
    e = r.next(m[0], m.end() + 1, r.paragraph_end(m.end()))
    return None if e < 0 or not _WORD.search(r.text, m.end(), e) else _enclosed(m, e, len(m[0]))


@_rule("*", "emphasis", r"\*(?=[^\s*/])([^*\n]+?)(?<=[^\s*(])\*(?![\w*/])")
def _star(m, r):
    s, c = m[1], r.before(m.start())
    if c and (c.isalnum() or c in "_*/)]") or s.count("(") != s.count(")") or not _WORD.search(s) or re.search(r"[;=]|->", s):
        return None
    return _enclosed(m, m.end() - 1, 1, m.start() + 1)


def _in_word(c: str) -> bool:
    return c != "" and (c.isalnum() or c == "_")


@_rule("_", "emphasis", r"__(?=[^\s_])")
def _under2(m, r):
    if _in_word(r.before(m.start())):
        return None
    e = r.next("__", m.end() + 1, r.paragraph_end(m.end()))
    if e < 0 or not _WORD.search(r.text, m.end(), e) or _DUNDERS.fullmatch(r.text, m.end(), e):
        return None
    return _enclosed(m, e, 2)


@_rule("_", "emphasis", r"_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w(])")
def _under(m, r):
    if _in_word(r.before(m.start())) or not _WORD.search(m[1]) or re.search(r"[;=()]|->", m[1]):
        return None
    return _enclosed(m, m.end() - 1, 1, m.start() + 1)


@_rule("~", "emphasis", r"~~(?=[^\s~])")
def _strike(m, r):
    e = r.next("~~", m.end() + 1, r.paragraph_end(m.end()))
    return None if e < 0 else _enclosed(m, e, 2)


@_rule("~", "command", r"~(?=\\[A-Za-z]+\{)")
def _tie(m, r):
    return _whole(m, " ")


@_rule("[", "link", r"\[\[")
def _wiki_link(m, r):
    at, a, b = m.start(), r.pair("[", m.start()), r.pair("[", m.start() + 1)
    if a < 0 or a != b + 1 or b == m.end():
        return None
    body = r.text[m.end() : b]
    head = re.match(r"\s*([\w:]+)", body)
    if head and (head[1] in _CPP_ATTRIBUTES or head[1].split("::")[0] in ("gnu", "clang", "msvc", "using")) or body.strip().isdigit():
        return None
    if _after_name(r, at) and not _WORD.search(body):
        return None
    if "|" not in body and re.match(r"(?i)(file|image|category|datei|bild|kategorie):", body):
        return _Found(a + 1, "")
    return _Found(m.end() + body.rfind("|") + 1, "", ((b, a + 1, ""),))


@_rule("[", "link", r"\[(?:https?|ftp)://[^\s\]]+(?:[ \t]+([^\]\n]*))?\](?!\()")
def _wiki_external(m, r):
    return _whole(m, m[1] or "")


@_rule("[", "footnote", r"\[\^[^\s\]]+\]:?")
def _footnote(m, r):
    return _whole(m, "")


_URL = re.compile(r"""\(\s*+(<[^<>\n]*>|[^()\s]*+(?:\([^()\s]*\)[^()\s]*+)*+)(?:\s++(?:"[^"]*"|'[^']*'))?\s*+\)""")


@_rule("!", "image", r"!(?=\[)")
def _image(m, r):
    e = r.pair("[", m.end())
    url = _URL.match(r.text, e + 1, r.limit) if e >= 0 else None
    return _Found(url.end(), r.text[m.end() + 1 : e]) if url else None


@_rule("[", "link", r"\[")
def _link(m, r):
    e = r.pair("[", m.start())
    u = _URL.match(r.text, e + 1, r.limit) if e >= 0 else None
    if u is None:
        return None
    label, url = r.text[m.end() : e], u[1]
    if not label.strip() or label.strip() in ("&", "=", "this", "*this"):
        return None  # a lambda
    if not re.search(r"[./#:]|^<", url) or re.search(r"::|->|;", url) and "//" not in url:
        return None  # a call of an element
    if _after_name(r, m.start()) and not re.search(r"//|\.\w+(?:#.*)?$", url):
        return None
    return _Found(m.end(), "", ((e, u.end(), ""),))


@_rule("[", "link", r"\[([^\[\]\n]{3,})\] ?\[([^\[\]\n]*)\]")
def _reference_link(m, r):
    if _after_name(r, m.start()) or not re.search(r"[^\W\d_]", m[1]) or (m[2] or m[1]).lower() not in r.labels():
        return None
    return _whole(m, m[1], True)


@_rule("{", "template", r"\{\{\s*+[^\W\d][\w .:/-]*+(?=\||\}\})")
def _template(m, r):
    a, b = r.pair("{", m.start()), r.pair("{", m.start() + 1)
    return None if a < 0 or a != b + 1 else _Found(a + 1, "")


@_rule("{", "anchor", r"\{[#.][A-Za-z][\w:.-]*(?: +[#.]?[\w:.-]+(?:=\S+)?)*\}")
def _anchor(m, r):
    return None if m[0][1] == "." and ("=" in m[0] or r.text[m.end() : m.end() + 1] == ";") else _whole(m, "")


def _dollars(body: str) -> str:
    return f"${' '.join(body.split())}$"


@_rule("$", "formula", r"\$\$")
def _display(m, r):
    e = r.next("$$", m.end() + 1)
    return None if e < 0 else _Found(e + 2, _dollars(r.text[m.end() : e]), (), True)


@_rule("$", "formula", r"\$(?=[^\s$])([^$\n]+?)(?<=[^\s$\\])\$(?![\w$])")
def _math(m, r):
    body, c = m[1], r.before(m.start())
    if _in_word(c) or c in ("\\", "$") or re.fullmatch(r"[\d.,\s%-]+", body) or not re.search(r"[\\^_={}<>+*/()|]", body) and not re.fullmatch(r"-?\w{1,3}'*", body):
        return None
    if re.fullmatch(r"\{?[A-Z_][A-Z0-9_]+\}?[/:;].*", body) or re.match(r"[({]?[A-Z][A-Z_]{2,}\b", body) and "\\" not in body:
        return None  # variables of a shell
    return _whole(m, _dollars(body), True)


@_rule("\\", "formula", r"\\[\[(]")
def _bracket_math(m, r):
    if r.before(m.start()) == "\\":
        return None
    e = r.next("\\]" if m[0][1] == "[" else "\\)", m.end() + 1)
    return None if e < 0 else _Found(e + 2, _dollars(r.text[m.end() : e]), (), True)


_ROWS = re.compile(r"(?:\s|\\hline\b|\\\\)*+")


@_rule("\\", "environment", r"\\begin\{([A-Za-z]+)\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
def _environment(m, r):
    name = m[1]
    if name in _MATH_ENVS or name in _CODE_ENVS:
        e = r.next("\\end" + name, m.end())
        body = r.text[m.end() : e if e >= 0 else r.limit]
        return _Found(r.text.index("}", e) + 1 if e >= 0 else r.limit, _dollars(body) if name in _MATH_ENVS else _fence(body), (), True)
    tabular = name.startswith("tabular")
    r.environments.append("tabular" if tabular else name)
    if tabular:
        e = _ROWS.match(r.text, m.end(), r.limit).end()
        return _Found(e, "\n" if r.text.startswith("\\end{", e) else "\n| ")
    return _whole(m, "\n")


@_rule("\\", "environment", r"\\\\(?:\[[^\]\n]*\])?|\\hline\b")
def _row_end(m, r):
    if r.environments[-1:] != ["tabular"]:
        return None
    e = _ROWS.match(r.text, m.end(), r.limit).end()
    return _Found(e, " |" if r.text.startswith("\\end{", e) else " |\n| ", (), False, r.back(m.start()))


@_rule("\\", "command", r"\\end\{([A-Za-z]+)\*?\}")
def _end(m, r):
    name = "tabular" if m[1].startswith("tabular") else m[1]
    if r.environments[-1:] == [name]:
        r.environments.pop()
        return _Found(m.end(), "\n", (), False, -2)
    return _whole(m, "\n")


@_rule("\\", "command", r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{")
def _command(m, r):
    c, e = r.before(m.start()), r.pair("{", m.end() - 1)
    if e < 0 or c and (c in "\\:/." or c.isascii() and c.isalnum()):
        return None
    name = m[1]
    level = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}.get(name)
    if level:
        return _Found(m.end(), "\n" + "#" * level + " ", ((e, e + 1, "\n"),), kind="heading")
    if name in ("ref", "eqref", "pageref", "label", "cite", "citep", "citet", "vspace", "hspace", "usepackage", "documentclass", "input", "include", "bibliography"):
        return _Found(e + 1, "")
    if name in ("frac", "sqrt", "sum", "int"):
        return _Found(e + 1, r.text[m.start() : e + 1], (), True)
    return _Found(m.end(), "", ((e, e + 1, ""),))


@_rule("\\", "command", r"\\(" + "|".join(_LATEX_BARE) + r")(?![A-Za-z_{\\/.])[ \t]?")
def _bare_command(m, r):
    c = r.before(m.start())
    if c and (c in "\\:/." or c.isascii() and c.isalnum()):
        return None
    if m[1] == "item":
        return _Found(m.end(), "\n- ", kind="list")
    return _whole(m, "..." if m[1] in ("ldots", "dots") else " ")


@_rule("'", "emphasis", r"(?:'{5}|'{3}|'{2})(?=[^\s'])")
def _wiki_emphasis(m, r):
    e = r.next(m[0], m.end() + 1, r.line_end(m.end())) if r.before(m.start()) != "'" else -1
    return None if e < 0 or not _WORD.search(r.text, m.end(), e) else _enclosed(m, e, len(m[0]))


@_line_rule("frontmatter", r"\A---[ \t]*+\n(?:[^\n:]*+:[^\n]*+\n|[ \t]++[^\n]*+\n|- [^\n]*+\n)++---[ \t]*$")
def _frontmatter(m, r):
    return _whole(m, "")


@_line_rule("code", r"^ {0,3}(`{3,}+|~{3,}+)[ \t]*+([\w+#.-]*+)[^\n`]*+\n(.*?)(?:^ {0,3}\1[`~]*+[ \t]*$|\Z)", re.S)
def _code_block(m, r):
    return _whole(m, _fence(m[3]), True)


@_line_rule("code", r"^ {0,3}(?:`{3,}+|~{3,}+)[ \t]*[\w+#.-]*[ \t]*$")
def _stray_fence(m, r):
    return _whole(m, "")


@_line_rule("table", r"^[ \t]*+\{\|[^\n]*\n?")
def _wiki_table(m, r):
    r.tables.append(False)
    return _whole(m, "\n")


@_line_rule("table", r"^[ \t]*+\|[-}][^\n|]*$")
def _stray_table(m, r):
    return _whole(m, "")


@_line_rule("table", r"^[ \t]*+\|?(?:[ \t]*+:?-{3,}+:?[ \t]*+\|)++(?:[ \t]*+:?-{3,}+:?)?[ \t]*$")
def _delimiter_row(m, r):
    return _whole(m, "")


@_line_rule("table", r"^([ \t]*+\|)(?!\|)([^\n]+)\|[ \t]*$")
def _table_row(m, r):
    if not m[2].strip("| \t"):
        return None
    closers, at = [], r.ahead(m.end(1))
    done, p = at, r.text.find("|", at, m.end(2))
    while p >= 0:
        s = p
        while s > done and r.text[s - 1] in " \t":
            s -= 1
        done = r.ahead(p + 1)
        closers.append((s, done, " | "))
        p = r.text.find("|", done, m.end(2))
    s = m.end(2)
    while s > done and r.text[s - 1] in " \t":
        s -= 1
    return _Found(at, "| ", (*closers, (max(s, done), m.end(), " |")))


@_line_rule("heading", r"^ {0,3}(#{1,6})[ \t]++(?=\S)[^\n]*")
def _atx(m, r):
    at = m.end(1)
    at, line = r.ahead(at), m.end()
    body = r.text[at:line].rstrip()
    bare = body.rstrip("#")
    if bare != body and bare[-1:] in ("", " ", "\t"):
        body = bare.rstrip()
    return _Found(at, m[1] + " ", ((at + len(body), line, ""),))


@_line_rule("heading", r"^[ \t]*+(={2,6})[ \t]*+([^=\s][^\n]*)")
def _wiki_heading(m, r):
    body = m[2].rstrip(" \t")
    inner = body.removesuffix(m[1])
    if inner == body or not inner.strip():
        return None
    return _Found(m.start(2), "#" * len(m[1]) + " ", ((m.start(2) + len(inner.rstrip(" \t")), m.end(), ""),))


@_line_rule("rule", r"^ {0,3}(?:={3,}+|-{3,}+|(?:\*[ \t]*+){3,}+|(?:_[ \t]*+){3,}+|(?:-[ \t]++){3,}+)[ \t]*$")
def _rule_line(m, r):
    return _whole(m, "")


@_line_rule("definition", r"^ {0,3}\[[^\]\n]+\]:[ \t]++\S++(?:[ \t]++(?:\"[^\"\n]*\"|'[^'\n]*'))?[ \t]*$")
def _definition(m, r):
    return _whole(m, "")


@_line_rule("list", r"^([ \t]*+)(?:[-+]|\*+)[ \t]++(?:\[[ xX]\][ \t]++)?(?=\S)")
def _bullet(m, r):
    return _whole(m, m[1] + "- ")


#: Digits of a list's number, at most: as CommonMark has it.
@_line_rule("list", r"^([ \t]*+)(\d{1,9})[.)][ \t]++(?=\S)")
def _number(m, r):
    return _whole(m, f"{m[1]}{m[2]}. ")


@_line_rule("quote", r"^ {0,3}(?:>[ \t]?)++(?=[^\s>=])")
def _quote(m, r):
    return _whole(m, "")


@_line_rule("list", r"^[:;]++[ \t]++(?=\S)")
def _indent(m, r):
    return _whole(m, "")


_CELL_STYLE = r"(?:[^|\[\]{}\n]*=[^|\n]*\|(?!\|))?[ \t]*+"
_TABLE_END, _TABLE_ROW = re.compile(r"[ \t]*+\|\}[^\n]*"), re.compile(r"[ \t]*+\|-[^\n]*\n?")
_TABLE_CELL, _TABLE_NEXT = re.compile(r"[ \t]*+(?:\|\+|[|!])" + _CELL_STYLE), re.compile(r"(?:\|\||!!)" + _CELL_STYLE)
_TABLE_LINE = re.compile(r"\n(?=([ \t]*+[|!])?)")


def _in_table(r: _Reader, at: int) -> _Found | None:
    """The marks of an open wiki table, at a line's begin or end."""
    row = r.tables[-1]
    if m := _TABLE_LINE.match(r.text, at):
        return _Found(m.end(), "" if m[1] or not row else " ", (), False, r.back(at))
    if at and r.text[at - 1] != "\n" and at != r.done:
        return None
    if m := _TABLE_END.match(r.text, at):
        r.tables.pop()
        return _whole(m, (" |" if row else "") + "\n")
    if m := _TABLE_ROW.match(r.text, at):
        r.tables[-1] = False
        return _whole(m, " |\n" if row else "")
    if m := _TABLE_CELL.match(r.text, at):
        r.tables[-1] = True
        line, closers = r.line_end(m.end()), []
        done = m.end()
        for x in _TABLE_NEXT.finditer(r.text, m.end(), line):
            start = x.start()
            while start > done and r.text[start - 1] in " \t":
                start -= 1
            done = x.end()
            closers.append((start, done, " | "))
        return _Found(m.end(), " | " if row else "| ", tuple(closers))
    return None


_STARTS = re.compile(r"(?m)^(?=[ \t]*+[-#=`~|{>+*_\[:;\d])|[<&`*_~\[!{$\\']")
_TABLE_STARTS = re.compile(r"(?m)^(?=[ \t]*+[|!{])|[<&`*_~\[!{$\\'\n]")
_CLOSER = re.compile(r"(?<=[ \t])#{2,6}[ \t]*\Z")
#: Constructs that are structure, not residue around the content: they cost nothing.
_CONTENT = {"heading", "list", "table", "code", "formula", "span", "emphasis", "link", "quote", "environment", "structure"}


def lex(text: str, heading: bool = False) -> list[Construct]:
    """The constructs of a text in order; they don't overlap."""
    out: list[Construct] = []
    r = _Reader(text)
    open_: list[tuple[int, int, str, str]] = []  # closing marks to come, the next one last
    at, n = 0, len(text)
    while at < n or open_:
        r.limit = open_[-1][0] if open_ else n
        s = (_TABLE_STARTS if r.tables else _STARTS).search(text, at, r.limit) if at < r.limit else None
        if s is None or s.start() >= r.limit:
            if not open_:
                break
            start, end, kind, write = open_.pop()
            if end > start:
                out.append(Construct(kind, start, end, write, False, True))
            at = r.done = end
            continue
        at = s.start()
        kind, found = "table", None
        if r.tables and not open_:
            found = _in_table(r, at)
        if found is None and not open_ and (at == 0 or text[at - 1] == "\n"):
            for kind, pattern, f in _LINE:
                if r.tables and f is not _wiki_table or heading and f is _number:
                    continue
                if (m := pattern.match(text, at)) and (found := f(m, r)):
                    break
        if found is None:
            for kind, pattern, f in _AT.get(text[at], ()):
                if (m := pattern.match(text, at, r.limit)) and (found := f(m, r)):
                    break
        if found is None:
            at += 1
            continue
        part = found.start == -2 or kind == "table" and bool(r.tables) and text[at] == "\n"
        kind = "environment" if found.start == -2 else found.kind or kind
        out.append(Construct(kind, found.start if found.start >= 0 else at, found.end, found.write, found.holds, part))
        at = r.done = found.end
        if found.closers:
            r.floor = at
            open_ += [(a, b, kind, w) for a, b, w in reversed(found.closers)]
    if any(r.tables) or "tabular" in r.environments:
        out.append(Construct("table", n, n, " |", False, True))
    if heading and (m := _CLOSER.search(text)) and (not out or out[-1].end < m.start()):
        out.append(Construct("heading", m.start() - 1, n, ""))
    return out


def content_region(text: str, constructs: list[Construct], weights: dict[str, float] | None = None) -> tuple[int, int]:
    """Bounds of the contiguous region with the largest score, by one scan; the longest of equal ones.

    Plain text and constructs that hold content score by their words, other constructs by their kind's
    weight. A text without any word has the empty region.
    """
    w = weights or WEIGHTS
    word = w["word"]
    best, best_span, run, run_start, at = 0.0, (0, 0), 0.0, 0, 0

    def add(score: float, start: int, end: int) -> None:
        nonlocal best, best_span, run, run_start
        if run < 0:
            run, run_start = 0.0, start
        run += score
        if run > best or run == best and best_span[1] > best_span[0] and end - run_start > best_span[1] - best_span[0]:
            best, best_span = run, (run_start, end)

    for c in constructs:
        if c.start > at:
            add(word * len(_SCORED.findall(text, at, c.start)), at, c.start)
        cost = 0.0 if c.part or c.kind in _CONTENT else w.get(c.kind, w["other"])
        add(word * (len(_SCORED.findall(text, c.start, c.end)) if c.holds else 0) + cost, c.start, c.end)
        at = c.end
    if at < len(text):
        add(word * len(_SCORED.findall(text, at)), at, len(text))
    return best_span


_MANY_LINES = re.compile(r"\n{3,}")
_LOOSE = re.compile(r"(?m)^([ \t]*+(?:- |\d+\. |\|).*)\n\n(?=[ \t]*+(?:- |\d+\. |\| ))")


def _written(text: str, constructs: list[Construct], start: int, end: int) -> str:
    parts, at = [], start
    for c in constructs:
        if c.start >= start and c.end <= end:
            parts += [text[at : c.start], c.write]
            at = c.end
    return "".join([*parts, text[at:end]])


class Cleaned(NamedTuple):
    """The clean text, the kinds of all constructs found, and how many of them the content region keeps."""

    text: str
    kinds: list[str]
    n_kept: int


def clean(text: str, heading: bool = False, weights: dict[str, float] | None = None) -> Cleaned:
    """The content of a text as clean text, with the constructs that the scan kept or rejected.

    Of a ``heading`` the mark of its level is left out: it is a heading anyway.
    """
    constructs = lex(text, heading)
    if not constructs:
        return Cleaned(text, [], 0)
    start, end = content_region(text, constructs, weights)
    out = _written(text, constructs, start, end)
    out = _LOOSE.sub(r"\1\n", _MANY_LINES.sub("\n\n", "\n".join(x.rstrip(" \t") for x in out.split("\n")))).strip()
    if heading:
        out = re.sub(r"\s+", " ", re.sub(r"^#{1,6} +", "", out))
    counted = [c for c in constructs if not c.part]
    return Cleaned(out, [c.kind for c in counted], sum(c.start >= start and c.end <= end for c in counted))


SCHEMA = "id long, field string, clean_text string, n_constructs long, n_kept long, n_rejected long, kinds string"


def clean_fields(rows: DataFrame, row_id: str, fields: list[str], heading_fields: tuple[str, ...] = ("heading",), weights: dict[str, float] | None = None) -> DataFrame:
    """``(id, field, clean_text, n_constructs, n_kept, n_rejected, kinds)`` for each text field of each row.

    The scan over the scores keeps the constructs within the region of content and rejects the others.
    ``kinds`` lists the kinds of constructs in a field, sorted. Fields are cleaned where they are
    read, whole; nothing is shuffled. Null fields give no row; empty and blank ones stay as they are,
    with no constructs; so do texts without markup, however long. Rows that repeat an id each give
    their own rows; other columns are ignored.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for k, name in enumerate(fields, 1):
                for i, t in zip(ids, batch.column(k).to_pylist(), strict=True):
                    if t is not None:
                        text, kinds, kept = clean(t, name in heading_fields, weights)
                        out.append((i, name, text, len(kinds), kept, len(kinds) - kept, ",".join(sorted(set(kinds)))))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    picked = rows.select(F.col(row_id).cast("long").alias("id"), *(F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)))
    return picked.mapInArrow(convert, SCHEMA)


def current_sections(node: DataFrame) -> DataFrame:
    """``(id, heading, content_preview)`` of the nodes whose current row (largest updated_at) is a doc_section.

    Of rows with equal times, that with the largest values counts. Only the columns named are
    shuffled, and a node delivered many times is reduced to one row before.
    """
    columns = [F.col(c) for c in ("type", "heading", "content_preview")]
    newest = F.max(F.struct("updated_at", *columns)).alias("m")
    sections = node.where("id IS NOT NULL").groupBy("id").agg(newest)
    return sections.where("m.type = 'doc_section'").select("id", "m.heading", "m.content_preview")


def clean_sections(node: DataFrame) -> DataFrame:
    """Clean text of the headings and previews of current sections: as ``clean_fields``, with ``node_id``."""
    return clean_fields(current_sections(node), "id", ["heading", "content_preview"]).withColumnRenamed("id", "node_id")


def fit_weights(pages: DataFrame, text: str = "text", content: str = "content", limit: int = FIT_PAGES) -> dict[str, float]:
    """Weights from labelled pages: ``content`` is the part of ``text`` that is its content.

    A kind's weight is the log of how much likelier it is inside content than outside, with one added
    to all counts. At most ``limit`` pages are used; pages whose content isn't in their text, or is
    null, are left out. Without any usable page the default weights are returned.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for t, c in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                a = t.find(c)
                if a < 0:
                    continue
                found, at = lex(t), 0
                for x in [*found, Construct("", len(t), len(t), str)]:
                    inside = len(_SCORED.findall(t, max(at, a), min(x.start, a + len(c)))) if x.start > a and at < a + len(c) else 0
                    n["word", True] += inside
                    n["word", False] += len(_SCORED.findall(t, at, x.start)) - inside
                    if x.kind:
                        n[x.kind, a <= x.start and x.end <= a + len(c)] += 1
                    at = x.end
        keys = list(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([n[k] for k in keys], pa.int64())], names=["kind", "inside", "n"]
        )

    rows = pages.select(F.col(text).alias("t"), F.col(content).alias("c")).where("t IS NOT NULL AND c IS NOT NULL AND c <> ''").limit(limit)
    counts = {(r["kind"], r["inside"]): r["n"] for r in rows.mapInArrow(count, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return dict(WEIGHTS)
    kinds = {k for k, _ in counts}
    total = {i: sum(v for (_, x), v in counts.items() if x == i) + len(kinds) for i in (True, False)}
    got = {k: math.log((counts.get((k, True), 0) + 1) / total[True]) - math.log((counts.get((k, False), 0) + 1) / total[False]) for k in kinds}
    return {"word": WEIGHTS["word"], "other": WEIGHTS["other"]} | got
