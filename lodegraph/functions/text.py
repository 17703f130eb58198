"""Column functions on names, paths, keys and Markdown text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- patterns and names ------------------------------------------------------------------------------


def contains_like(c: Column | str, word: str) -> Column:
    """Contains ``word`` anywhere, without regard to case; ``%`` and ``_`` stand for any text or character (F-01, F-02)."""
    return _c(c).ilike("%" + word.replace("\\", "\\\\") + "%")


def tail(c: Column | str, sep: str = "::") -> Column:
    """The part after the last separator, or all of it (F-14)."""
    return F.element_at(F.split(_c(c), sep), -1)


def head(c: Column | str, sep: str = "::") -> Column:
    """The part before the last separator; the name itself where there is none (F-14)."""
    return F.regexp_replace(_c(c), f"{sep}(?!.*{sep}).*$", "")


def last_segment(c: Column | str) -> Column:
    """The last part of a namespace that is not empty, also where there is only one; null without any (P-28)."""
    return F.get(F.reverse(F.filter(F.split(_c(c), "::"), lambda x: x != "")), F.lit(0))


def project_name(path: Column | str) -> Column:
    """The folder under ``app`` or ``src`` in a path, or empty (F-48)."""
    return F.regexp_extract(F.coalesce(_c(path), F.lit("")), "/(?:app|src)/([^/_][^/]*)/", 1)


def bare_references(c: Column | str) -> Column:
    """Mentions of task documents in plain text that should be links (D-08)."""
    return F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(r"(?<![\[(])task/\S+\.md"), F.lit(0))


def basename(c: Column | str) -> Column:
    """The last part of a path (F-15)."""
    return tail(c, "/")


def path_end(c: Column | str, parts: int = 2) -> Column:
    """The last parts of a path, with empty ones left out (F-16)."""
    pieces = F.filter(F.split(F.replace(_c(c), F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    return F.array_join(F.slice(pieces, F.greatest(F.size(pieces) - parts + 1, F.lit(1)), F.lit(parts)), "/")


def relative_path(c: Column | str, roots: list[str]) -> Column:
    """The path from the first of ``roots`` it contains, else its last part (F-17)."""
    path, out = _c(c), None
    for root in roots:
        rest = F.regexp_replace(F.substring(path, F.instr(path, root) + len(root), F.length(path)), "^/+", "")
        value = rest if "/" in root else F.concat(F.lit(root + "/"), rest)
        out = F.when(path.contains(root), value) if out is None else out.when(path.contains(root), value)
    return basename(path) if out is None else out.otherwise(basename(path))


def in_scope(c: Column | str, parts: list[str]) -> Column:
    """Whether a path contains any of ``parts``; not for a null or without parts (P-20)."""
    if not parts:
        return F.lit(False)
    return F.coalesce(F.exists(F.array(*map(F.lit, parts)), lambda p: _c(c).contains(p)), F.lit(False))


def plain_signature(c: Column | str) -> Column:
    """A signature without default values, parameter spacing and qualifiers at its end (F-18)."""
    s = F.regexp_replace(_c(c), r"\s+", " ")
    s = F.regexp_replace(s, r"\s*([(),*&<>])\s*", "$1")
    return F.trim(F.regexp_replace(s, r"\s*(?:override|final|noexcept)\b", ""))


def qualified_name(namespace: Column | str, cls: Column | str, name: Column | str) -> Column:
    """``ns::Class::name`` with the class only once if the namespace already ends with it (F-19)."""
    ns, k = F.coalesce(_c(namespace), F.lit("")), F.coalesce(_c(cls), F.lit(""))
    doubled = (ns == k) | ns.endswith(F.concat(F.lit("::"), k)) | (k == "")
    scope = F.when(doubled, ns).when(ns == "", k).otherwise(F.concat(ns, F.lit("::"), k))
    return F.when(scope == "", _c(name)).otherwise(F.concat(scope, F.lit("::"), _c(name)))


def base_destructor(name: Column | str, base: Column | str) -> Column:
    """A derived class's destructor under its base's name; other names stay (F-20)."""
    return F.when(_c(name).startswith("~"), F.concat(F.lit("~"), _c(base))).otherwise(_c(name))


def simple_type(c: Column | str) -> Column:
    """A type without template arguments, qualifiers, pointers and ``const`` (F-21)."""
    bare = F.regexp_replace(F.split(_c(c), "<")[0], r"\b(?:const|volatile|struct|class|typename)\b", "")
    return F.regexp_replace(tail(F.regexp_replace(bare, r"[&*\s]+", "")), r"\s", "")


#: Names of the standard library that are no calls of interest.
LIBRARY_NAMES = (
    "basic_string", "allocator", "pair", "tuple", "vector", "map", "set", "unordered_map", "unordered_set", "shared_ptr", "unique_ptr", "weak_ptr",
    "make_shared", "make_unique", "make_pair", "basic_ostream", "basic_istream",
)


def is_call_noise(c: Column | str) -> Column:
    """Whether a callee is an operator, compiler internal or library name, or missing (P-19)."""
    n = _c(c)
    noise = n.rlike(r"^operator($|[^\p{L}\p{N}])") | n.rlike(r"^(_M_|_r_|__|_\p{Lu})") | n.isin(*LIBRARY_NAMES) | (n == "")
    return F.coalesce(noise, F.lit(True))


def is_likely_symbol(c: Column | str) -> Column:
    """Whether a word in code marks is a class or function name rather than an abbreviation, constant or path (P-22)."""
    s = _c(c)
    shape = (F.length(s) >= 3) & ~s.rlike(r"[./]") & s.rlike(r"\p{Ll}") & ~s.rlike(r"^[A-Z]{2,}_") & ~s.rlike(r"^k\p{Ll}")
    return F.coalesce(shape, F.lit(False))


def is_code_symbol(c: Column | str) -> Column:
    """Whether a name has the shape of a C++ name (P-23)."""
    return F.coalesce(_c(c).rlike(r"^[A-Za-z_][\p{L}\p{N}_:~]*$"), F.lit(False))


# --- keys and hashes ---------------------------------------------------------------------------------


def content_hash(c: Column | str) -> Column:
    """The first 16 hexadecimal digits of a text's SHA-256 (F-10)."""
    return F.substring(F.sha2(_c(c).cast("binary"), 256), 1, 16)


def finding_id(title: Column | str, at: Column) -> Column:
    """An id of a time and the first 4 digits of the title's MD5 (F-11)."""
    return F.concat(F.lit("f-"), F.date_format(at, "yyyyMMddHHmmss"), F.lit("-"), F.substring(F.md5(_c(title).cast("binary")), 1, 4))


def node_key(type_: Column, namespace: Column, name: Column, path: Column, params: Column, const: Column) -> Column:
    """``type|namespace|name|path``, for functions with ``|params`` (also when empty) and ``|c`` if const (F-13)."""
    base = F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in (type_, namespace, name, path)))
    listed = F.array_join(F.coalesce(params, F.array().cast("array<string>")), ",")
    return F.when(type_ == "function", F.concat(base, F.lit("|"), listed, F.when(const, F.lit("|c")).otherwise(F.lit("")))).otherwise(base)


def node_id(key: Column | str) -> Column:
    """A stable id of a key."""
    return F.xxhash64(_c(key))


# --- words -------------------------------------------------------------------------------------------

CJK = r"\x{4E00}-\x{9FFF}"


def word_count(c: Column | str) -> Column:
    """Chinese characters plus identifiers (F-12)."""
    text = F.coalesce(_c(c), F.lit(""))
    return F.regexp_count(text, F.lit(f"[{CJK}]")) + F.regexp_count(text, F.lit("[a-zA-Z_][a-zA-Z0-9_]*"))


def split_words(c: Column | str) -> Column:
    """Text with blanks between Chinese characters and at the joints of camelCase and snake_case (F-22)."""
    text = F.replace(F.coalesce(_c(c), F.lit("")), F.lit("_"), F.lit(" "))
    text = F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.regexp_replace(text, f"([{CJK}])(?=[{CJK}])", "$1 ")


def split_cjk(c: Column | str) -> Column:
    """Text with a blank after every Chinese character (F-23)."""
    return F.trim(F.regexp_replace(_c(c), f"([{CJK}])", "$1 "))


def terms(c: Column | str) -> Column:
    """Search terms in lower case: runs of Latin letters or digits, single Chinese characters, with camelCase split (F-24)."""
    return F.transform(F.regexp_extract_all(split_words(c), F.lit(rf"[{CJK}]|[\p{{L}}&&[^{CJK}]]+|\d+"), F.lit(0)), F.lower)


def names_in(c: Column | str) -> Column:
    """Whole words of a text that can be names of code; a Chinese character ends none (F-25)."""
    return F.regexp_extract_all(_c(c), F.lit(r"(?<![\p{L}\p{N}_])[A-Za-z_][A-Za-z0-9_]*(?![\p{L}\p{N}_])"), F.lit(0))


# --- Markdown ----------------------------------------------------------------------------------------


def wiki_links(c: Column | str) -> Column:
    """What stands in ``[[ ]]`` (F-26)."""
    return F.transform(F.regexp_extract_all(_c(c), F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), F.trim)


#: Names in code marks, qualified and plain; a link's and a code mark's text. Fixed values.
QUALIFIED_SYMBOL = "`([A-Z][A-Za-z0-9_]*(?:::[A-Za-z0-9_~]+)+)`"
PLAIN_SYMBOL = "`([A-Z][A-Za-z0-9_]{2,})`"
LINK_TEXT, CODE_TEXT = r"\[([^\]]+)\]\([^)]+\)", "`([^`]+)`"


def backtick_symbols(c: Column | str) -> Column:
    """Names in code marks: qualified ones, and plain ones that look like names; sorted, once each (F-27)."""
    qualified = F.regexp_extract_all(_c(c), F.lit(QUALIFIED_SYMBOL), F.lit(1))
    plain = F.filter(F.regexp_extract_all(_c(c), F.lit(PLAIN_SYMBOL), F.lit(1)), is_likely_symbol)
    return F.array_sort(F.array_distinct(F.concat(qualified, plain)))


def diary_symbols(c: Column | str) -> Column:
    """Names in code marks of at least two characters, without ``()`` (F-28)."""
    found = F.transform(F.regexp_extract_all(_c(c), F.lit("`([^`]+)`"), F.lit(1)), lambda x: F.regexp_replace(F.trim(x), r"\(\)$", ""))
    return F.filter(found, lambda x: x.rlike("^[A-Za-z_].+"))


def markdown_links(c: Column | str) -> Column:
    """Targets of links to other documents (F-29)."""
    return F.filter(F.regexp_extract_all(_c(c), F.lit(r"(?<!!)\[[^\]\n]*\]\(([^)\s]+)\)"), F.lit(1)), lambda x: ~x.rlike(r"^(?:https?:|mailto:|#)"))


def path_doc_id(c: Column | str) -> Column:
    """The document id of a path (F-31)."""
    p = F.regexp_replace(F.replace(_c(c), F.lit("\\"), F.lit("/")), r"\.md$", "")
    return F.concat(F.lit("doc:"), F.regexp_replace(F.regexp_replace(F.replace(p, F.lit("/"), F.lit("-")), "-+", "-"), "^-|-$", ""))


def link_doc_id(link: Column | str, source: Column | str) -> Column:
    """The document id that a link in ``source`` leads to: ``..`` taken back, anchors and dots left out (F-30)."""
    target = F.regexp_replace(F.regexp_replace(_c(link), "#.*$", ""), r"\.md$", "")
    folder = F.when(_c(source).contains("/"), F.regexp_replace(_c(source), "/[^/]*$", "/")).otherwise(F.lit(""))
    parts = F.split(F.concat(folder, target), "/")
    step = lambda acc, x: (
        F.when((x == "") | (x == "."), acc)
        .when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, x))
    )
    flat = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "-")
    return F.concat(F.lit("doc:"), F.regexp_replace(F.regexp_replace(F.regexp_replace(flat, r"\.+", ""), "-+", "-"), "^-|-$", ""))


def clean_heading(c: Column | str) -> Column:
    """A heading without links and code marks (F-33)."""
    return F.regexp_replace(F.regexp_replace(_c(c), LINK_TEXT, "$1"), CODE_TEXT, "$1")


def document_title(c: Column | str) -> Column:
    """The first heading of level one, or empty (F-34)."""
    return F.trim(F.regexp_extract(F.coalesce(_c(c), F.lit("")), r"(?m)^[ \t]*# ([^\n]*)$", 1))


#: Types of documents by their path, in lower case, or text: the first that fits counts. Fixed values.
DOCUMENT_TYPES = [
    ("path", r"(^|/)diary/", "diary"),
    ("path", r"(^|/)review_reports/", "review"),
    ("path", r"(^|/)task/", "task"),
    ("path", "completion status", "report"),
    ("text", r"## [^\n]+\n-\s*\*\*类型\*\*", "diary"),
]
#: The names of the lines of a diary's entry. Fixed values.
DIARY_FIELDS = {"kind": "类型", "conclusion": ("结论", "影响"), "symbols": "关联", "session": "会话"}


def document_type(path: Column | str, text: Column | str, declared: Column, types: list[tuple[str, str, str]] | None = None) -> Column:
    """The declared type, else that of the first of ``types(field, pattern, type)`` that fits, else ``doc`` (F-35, F-36)."""
    fields = {"path": F.lower(F.coalesce(_c(path), F.lit(""))), "text": F.coalesce(_c(text), F.lit(""))}
    rules = DOCUMENT_TYPES if types is None else types
    found = [F.when(fields[field].rlike(pattern), F.lit(kind)) for field, pattern, kind in rules]
    return F.coalesce(F.nullif(declared, F.lit("")), *found, F.lit("doc"))


def document_date(name: Column | str, text: Column | str, modified: Column) -> Column:
    """The date in a file's name, else in the first 500 characters of its text, else that of its change (F-37)."""
    pattern = r"(\d{4}-\d{2}-\d{2})"
    found = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1), F.lit(""))
    return F.coalesce(F.try_to_date(found(_c(name))), F.try_to_date(found(F.substring(_c(text), 1, 500))), F.to_date(modified))


def keyword_tags(c: Column | str, words: dict[str, str], most: int = 5) -> Column:
    """Tags whose key word is in the text: sorted, ``most`` at most (F-38)."""
    text = F.lower(F.coalesce(_c(c), F.lit("")))
    found = F.array(*(F.when(text.contains(k.lower()), F.lit(t)) for k, t in words.items())) if words else F.array().cast("array<string>")
    return F.slice(F.array_sort(F.array_distinct(F.array_compact(found))), 1, most)


def slug(number: Column, heading: Column | str) -> Column:
    """An id of a section: its number in three digits and its heading's letters (F-39)."""
    body = F.lower(F.substring(F.regexp_replace(_c(heading), r"[^\p{L}\p{N}]+", "-"), 1, 40))
    return F.concat(F.lpad(number.cast("string"), 3, "0"), F.lit("-"), F.regexp_replace(body, "^-|-$", ""))


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for ``rlike``; ``*`` crosses ``/`` (F-44)."""
    out = []
    for ch in pattern:
        out.append(".*" if ch == "*" else "." if ch == "?" else "\\" + ch if ch in r"\.^$+{}()|[]" else ch)
    return "^" + "".join(out) + "$"


def matches_any(c: Column | str, patterns: list[str]) -> Column:
    """Whether a path matches any of some shell patterns (F-44, S-08, S-09)."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | _c(c).rlike(glob_regex(p))
    return F.coalesce(hit, F.lit(False))


def rule_tags(c: Column | str, rules: list[tuple[str, list[str]]]) -> Column:
    """The tags of all rules (pattern, tags) that a path matches, in order, once each (F-40)."""
    empty = F.array().cast("array<string>")
    found = [F.when(_c(c).rlike(glob_regex(p)), F.array(*map(F.lit, tags))).otherwise(empty) for p, tags in rules]
    return F.array_distinct(F.concat(*found)) if found else empty


def preview(c: Column | str, most: int = 300) -> Column:
    """A text's first characters and dots where it goes on (F-45)."""
    return F.when(F.length(_c(c)) > most, F.concat(F.substring(_c(c), 1, most), F.lit("..."))).otherwise(_c(c))


def severity(c: Column | str) -> Column:
    """The severity of a review's heading such as ``### [P0] ...``, or null (F-42, D-05)."""
    return F.nullif(F.regexp_extract(F.coalesce(_c(c), F.lit("")), r"(?m)^#{2,4}\s*\[(P\d)\]", 1), F.lit(""))


def diary_field(c: Column | str, name: str) -> Column:
    """The value of a diary's line ``- **name**: value``, or null (F-43, D-04)."""
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(_c(c), F.lit("")), rf"(?m)^-\s*\*\*{name}\*\*\s*[:：]\s*([^\n]*)$", 1)), F.lit(""))


def dot(a: Column | str, b: Column | str) -> Column:
    """The dot product of two vectors of one length; of normalised ones the cosine (F-41)."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    """A vector of length one; the zero vector stays (R-15)."""
    norm = F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(_c(v), lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def access_of(relation: Column | str) -> Column:
    """The access in a relation such as ``inherits_public`` (F-46)."""
    return F.regexp_replace(_c(relation), "^inherits_", "")


def call_types(kind: str | None) -> list[str]:
    """The relations of a kind of call; all for an unknown one (F-47)."""
    known = {"direct": ["calls_direct"], "virtual": ["calls_virtual"], "callback": ["calls_callback"]}
    return known.get(kind or "", [x for v in known.values() for x in v])
