"""Markdown documents to sections, symbols, links and a document graph."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.functions import text as t
from lodegraph.runtime import small, strip

MIN_WORDS = 20


def lines(documents: DataFrame) -> DataFrame:
    """``(doc_id, path, line_no, line, in_code)``: the lines of texts; code fences are told apart (W-11)."""
    rows = documents.where("text IS NOT NULL").select("doc_id", "path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    fence = F.when(F.trim("line").startswith("```"), 1).otherwise(0)
    by = W.partitionBy("doc_id").orderBy("line_no")
    count = F.sum(fence).over(by.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("in_code", ((count % 2) == 1) | (fence == 1))


_INT_ARRAY, _TEXT_ARRAY = "array<int>", "array<string>"


def _with_lines(rows: DataFrame) -> DataFrame:
    """``rows`` with the array of the lines of their ``text``, made once."""
    return rows.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))


def _heading_places(fences: bool) -> Column:
    """The numbers of the lines that are headings of level two, from ``lines``; one walk along the array, which counts fences if asked."""
    is_heading = lambda x: x.rlike(r"^\s*##\s+\S")
    if not fences:
        marked = F.transform("lines", lambda x, i: F.when(is_heading(x), i))
        return F.array_compact(marked)
    walk = lambda acc, x: F.struct(
        (acc["at"] + 1).alias("at"),
        (acc["code"] != x.rlike(r"^\s*```")).alias("code"),
        F.when(~acc["code"] & is_heading(x), F.array_append(acc["found"], acc["at"])).otherwise(acc["found"]).alias("found"),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("code"), F.array().cast(_INT_ARRAY).alias("found"))
    return F.aggregate("lines", start, walk, lambda acc: acc["found"])


def sections(documents: DataFrame, fences: bool = False) -> DataFrame:
    """``(doc_id, path, section_no, heading, section_level, start_line, end_line, content)``: texts cut at headings of level two (W-10).

    Lines before the first such heading are a section of their own; it keeps an empty heading unless it
    is the only one, then it is called by the document's title or its path. With ``fences`` headings
    within code are none. A text is cut within its row by array functions, so no document's lines are
    shuffled; null texts have no sections.
    """
    rows = _with_lines(documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "path", "text"))
    file_name = F.regexp_replace(F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1), r"\.[^./]*$", "")
    title = F.trim(F.regexp_extract("text", r"(?m)^[ \t]*# (?!#)[ \t]*([^\n]*)$", 1))
    rows = rows.select("doc_id", "path", "lines", _heading_places(fences).alias("heads"), F.coalesce(F.nullif(title, F.lit("")), file_name).alias("name"))
    opens = F.concat(F.when((F.size("heads") == 0) | (F.get("heads", F.lit(0)) > 0), F.array(F.lit(0))).otherwise(F.array().cast(_INT_ARRAY)), "heads")
    rows = rows.withColumn("opens", opens)
    rows = rows.withColumn("headless", F.size("opens") - F.size("heads")).withColumn("last", F.size("lines") - 1)

    def part(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("opens", k + 1) - 1, F.col("last"))
        own = F.when(k >= F.col("headless"), 1).otherwise(0)
        heading = F.when(own == 1, F.regexp_extract(F.get("lines", start), r"^\s*##\s+(.*?)\s*$", 1)).when(F.size("heads") == 0, F.col("name")).otherwise("")
        return F.struct(
            k.cast("long").alias("section_no"), heading.alias("heading"), F.lit(2).cast("long").alias("section_level"), start.cast("long").alias("start_line"),
            end.cast("long").alias("end_line"), strip(F.array_join(F.slice("lines", start + 1 + own, end - start + 1 - own), "\n")).alias("content"),
        )

    cut_up = rows.select("doc_id", "path", F.inline(F.transform("opens", part)))
    return cut_up.withColumn("heading", t.clean_heading("heading"))


def merge_short(parts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Sections with fewer than ``min_words`` words joined to the one before; a document's first stays (W-09)."""
    own = parts.withColumn("words", t.word_count("content"))
    by = W.partitionBy("doc_id").orderBy("section_no")
    kept = F.when((F.row_number().over(by) == 1) | (F.col("words") >= min_words), 1).otherwise(0)
    grouped = own.withColumn("kept", kept).withColumn("part", F.sum("kept").over(by.rowsBetween(W.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_no", "content"))), lambda x: x["content"]), "\n\n")
    first = F.min(F.struct("section_no", "path", "heading", "section_level", "start_line")).alias("m")
    out = grouped.groupBy("doc_id", "part").agg(first, F.max("end_line").alias("end_line"), joined.alias("content"))
    return out.select("doc_id", "m.path", "m.section_no", "m.heading", "m.section_level", "m.start_line", "end_line", "content")


def section_nodes(parts: DataFrame, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Sections with key, hash, number of words and tags (D-12)."""
    return parts.select(
        F.concat_ws("|", F.lit("doc_section"), F.coalesce("path", F.lit("")), F.col("start_line").cast("string")).alias("unique_key"),
        "doc_id", "path", "heading", "section_level", "start_line", "end_line", "content",
        t.content_hash("content").alias("content_hash"), t.word_count("content").alias("word_count"), t.rule_tags("path", rules or []).alias("tags"),
    )


#: The head of a text, between two lines of dashes.
HEAD = r"(?ms)\A[ \t]*---[ \t\r]*\n.*?^[ \t]*---[ \t\r]*$"
_HEAD = re.compile(r"\A[ \t]*---[ \t\r]*\n(.*?)^[ \t]*---[ \t\r]*$", re.S | re.M)
_ENTRY = re.compile(r"^(?P<key>\w+)[ \t]*:[ \t]*(?P<value>[^\n]*)$|^[ \t]*-[ \t]+(?P<item>[^\n]*)$", re.M)


def _unquoted(s: str) -> str:
    return s.strip().strip("'\"")


def _values(s: str) -> list[str]:
    """One value, or those of a list in brackets; none of an empty one, which a list may follow."""
    if s[:1] == "[" and s[-1:] == "]":
        return [_unquoted(v) for v in s[1:-1].split(",") if v.strip()]
    return [_unquoted(re.split(r"\s+#", s, maxsplit=1)[0])] if s else []


def _frontmatter(text: str) -> dict[str, list[str]]:
    head = _HEAD.match(text)
    fields: dict[str, list[str]] = {}
    following: list[str] | None = None
    for m in _ENTRY.finditer(head[1]) if head else ():
        if m["key"] is None:
            if following is not None:
                following.append(_unquoted(m["item"]))
            continue
        value = m["value"].strip()
        fields[m["key"]] = _values(value)
        following = None if value else fields[m["key"]]
    return fields


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
def _fields(text: pd.Series) -> pd.Series:
    return text.map(_frontmatter)


def head_fields(text: Column | str) -> Column:
    """The fields at the head of a text; only the head goes to Python."""
    return _fields(F.regexp_extract(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), HEAD, 0))


def frontmatter(documents: DataFrame) -> DataFrame:
    """``(doc_id, fields MAP<STRING, ARRAY<STRING>>)``: the fields at the head of a text; empty without one (F-32).

    ``key: value``, ``key: [a, b]`` and lists of ``- value`` lines; a comment after a value is left out.
    """
    return documents.where("doc_id IS NOT NULL").select("doc_id", head_fields("text").alias("fields"))


#: Lines by what they are, a letter each: the first pattern that a line, without blanks around it, matches.
_LINE_LETTERS = [(r"^(?:```|#|$)", "b"), (r"^(?:---|\*\*\*|___)$", "b"), (r"^>[>\s]*$", "n"), (r"^>", "q"), (r"^[^|]*\|[^|]*\|", "b"), (r"^(?:[-*]|\d+\.)\s", "i")]


def _with_summary(rows: DataFrame, skip_quotes: bool, most: int) -> DataFrame:
    """``rows(text, ...)`` with ``summary``: see ``first_paragraphs``."""
    body = F.regexp_replace(F.regexp_replace("text", HEAD, ""), CODE_BLOCK, "```")
    bare = _with_lines(rows.withColumn("_text", F.col("text")).withColumn("text", body)).withColumn("text", F.col("_text")).drop("_text")
    bare = bare.withColumn("lines", F.transform("lines", strip))

    def letter(line: Column) -> Column:
        kind = F.when(F.lit(False), "")
        for pattern, k in _LINE_LETTERS:
            kind = kind.when(line.rlike(pattern), k)
        return kind.otherwise("p")

    # the kinds of all lines as one word, in which a paragraph is a run of letters
    bare = bare.withColumn("kinds", F.array_join(F.transform("lines", letter), ""))
    run = "p[p]*" if skip_quotes else "[pq][pqn]*"
    at, size = F.regexp_instr("kinds", F.lit(run)), F.length(F.regexp_extract("kinds", run, 0))
    prose = F.filter(F.transform(F.slice("lines", F.greatest(at, F.lit(1)), size), lambda x: x if skip_quotes else strip(F.regexp_replace(x, "^>+", ""))), lambda x: x != "")
    items = F.transform(F.slice(F.filter("lines", lambda x: letter(x) == "i"), 1, 3), lambda x: F.regexp_replace(x, r"^(?:[-*]|\d+\.)\s+", ""))
    bare = bare.withColumn("summary", F.when(size > 0, F.array_join(prose, " ")).otherwise(F.array_join(items, " | ")))
    long = F.concat(F.substring("summary", 1, most - 3), F.lit("..."))
    return bare.withColumn("summary", F.when(F.length("summary") > most, long).otherwise(F.col("summary"))).drop("lines", "kinds")


def first_paragraphs(documents: DataFrame, skip_quotes: bool = True, most: int = 200) -> DataFrame:
    """``(doc_id, summary)``: the first paragraph of prose, else the first three list items (W-12).

    Lines after the head are told apart by their kind; code blocks count as one line. A paragraph ends at any line that is
    not prose; quotes are prose unless skipped. Longer summaries end in dots.
    """
    return _with_summary(documents.where("doc_id IS NOT NULL").select("doc_id", "text"), skip_quotes, most).select("doc_id", "summary")


# --- document graph ----------------------------------------------------------------------------------


def document_nodes(documents: DataFrame) -> DataFrame:
    """``(doc_id, key, type, title, summary, path, tags, date, manual)`` of each document, from one reading of it (D-01)."""
    rows = documents.where("doc_id IS NOT NULL").select("doc_id", "path", "text", "title", "updated_at", head_fields("text").alias("fields"))
    rows = _with_summary(rows, True, 200)
    field = lambda name: F.get(F.col("fields")[name], F.lit(0))
    return rows.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("doc:"), field("doc_id")), t.path_doc_id("path")).alias("key"),
        t.document_type("path", "text", field("type")).alias("type"),
        F.coalesce(F.nullif(field("title"), F.lit("")), F.nullif(t.document_title("text"), F.lit("")), "title").alias("title"),
        F.coalesce(F.nullif(field("summary"), F.lit("")), "summary").alias("summary"),
        "path",
        F.array_join(F.coalesce(F.col("fields")["tags"], F.array().cast(_TEXT_ARRAY)), ",").alias("tags"),
        t.document_date("path", "text", F.col("updated_at")).alias("date"),
        (F.size(F.map_keys("fields")) > 0).alias("manual"),
    )


def document_aliases(documents: DataFrame) -> DataFrame:
    """``(alias, key)``: of documents whose head gives an id, the key made of their path and the one made of that id (D-09)."""
    given = F.get(head_fields("text")["doc_id"], F.lit(0))
    rows = documents.select(t.path_doc_id("path").alias("alias"), F.concat(F.lit("doc:"), given).alias("key"))
    return rows.where("alias <> key").groupBy("alias").agg(F.min("key").alias("key"))


#: A block of code, up to the end of the text where it isn't closed.
CODE_BLOCK = r"(?ms)^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\z)"


def prose(documents: DataFrame) -> DataFrame:
    """Documents without the lines of their code blocks."""
    return documents.withColumn("text", F.regexp_replace("text", CODE_BLOCK, ""))


def document_edges(documents: DataFrame) -> DataFrame:
    """``(src, dst, rel, manual)``: links, mentioned symbols and what the heads of documents declare, once each (D-02, D-06, D-07, U-22).

    A declared edge counts before one found in the text; a link to a document with an id of its own
    leads to that.
    """
    none = F.array().cast(_TEXT_ARRAY)
    rows = prose(documents.where("doc_id IS NOT NULL").select("doc_id", "path", head_fields("text").alias("fields"), "text"))

    def edges(found: Column, dst, rel: str, manual: bool) -> Column:
        return F.transform(F.coalesce(found, none), lambda x: F.struct(dst(x).alias("dst"), F.lit(rel).alias("rel"), F.lit(manual).alias("manual")))

    symbol = lambda x: F.concat(F.lit("symbol:"), x)
    every = F.concat(
        edges(F.col("fields")["relates_to"], lambda x: F.concat(F.lit("doc:"), F.regexp_replace(x, "^doc:", "")), "relates_to", True),
        edges(F.col("fields")["code_symbols"], symbol, "mentions_symbol", True),
        edges(t.markdown_links("text"), lambda x: t.link_doc_id(x, F.coalesce("path", F.lit(""))), "relates_to", False),
        edges(t.backtick_symbols("text"), symbol, "mentions_symbol", False),
    )
    found = rows.select(F.col("doc_id").alias("src"), F.inline(every))
    aliases = small(document_aliases(documents).withColumnRenamed("alias", "dst"))
    named = found.join(aliases, "dst", "left").select("src", F.when(~F.col("manual"), F.coalesce("key", "dst")).otherwise(F.col("dst")).alias("dst"), "rel", "manual")
    return named.groupBy("src", "dst", "rel").agg(F.max("manual").alias("manual"))


def knowledge_nodes(documents: DataFrame) -> DataFrame:
    """``(doc_id, key, heading, summary, kind, conclusion, session, severity)``: a node per section outside code (D-03..D-05).

    A diary's lines before the first code block give its kind, conclusion (else its impact) and session.
    """
    parts = sections(documents, fences=True).where("heading <> ''").withColumnRenamed("content", "text")
    parts = _with_summary(parts, True, 200).withColumn("diary", F.regexp_replace("text", r"(?ms)^[ \t]*```.*", ""))
    field = lambda name: t.diary_field("diary", name)
    conclusion = F.coalesce(*(field(x) for x in t.DIARY_FIELDS["conclusion"]))
    return parts.select(
        "doc_id",
        F.concat(F.lit("know:"), F.col("doc_id").cast("string"), F.lit("/"), t.slug(F.col("section_no"), "heading")).alias("key"),
        "heading",
        F.coalesce(field(t.DIARY_FIELDS["conclusion"][0]), "summary").alias("summary"),
        field(t.DIARY_FIELDS["kind"]).alias("kind"),
        conclusion.alias("conclusion"),
        F.nullif(F.regexp_extract(F.coalesce(field(t.DIARY_FIELDS["session"]), F.lit("")), "^[0-9a-f]+", 0), F.lit("")).alias("session"),
        t.severity("text").alias("severity"),
    )


def repair_links(edges: DataFrame, known: DataFrame) -> DataFrame:
    """``edges(src, dst)`` to documents of ``known(key)``: dangling ones are led to the only document whose key ends like theirs, or dropped (D-10, J-30).

    The end is the part after the last ``-``, by which both sides are joined; more than one fitting
    document is no repair.
    """
    good = edges.join(known.select(F.col("key").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    end = lambda c: F.element_at(F.split(F.regexp_replace(c, "^doc:", ""), "-"), -1)
    bad = edges.join(known.select(F.col("key").alias("dst")).distinct(), "dst", "left_anti").withColumn("end", end("dst"))
    ends = known.groupBy(end("key").alias("end")).agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1")
    fixed = bad.join(ends, "end").where(F.col("key").endswith(F.regexp_replace("dst", "^doc:", ""))).select("src", F.col("key").alias("dst"))
    return good.unionByName(fixed).distinct()


def missing_symbols(edges: DataFrame, known: DataFrame) -> DataFrame:
    """``(key)`` of symbols that edges lead to and no node has (D-11, U-21)."""
    return edges.where("rel = 'mentions_symbol'").select(F.col("dst").alias("key")).distinct().join(known.select("key"), "key", "left_anti")


# --- documents and code ------------------------------------------------------------------------------


def content_mentions(parts: DataFrame, names: DataFrame, min_length: int = 4) -> DataFrame:
    """``(part_id, name, n)``: names of code that stand as whole words in texts (J-15).

    ``parts(part_id, text)`` are taken apart into words where they are read, counted, and joined with
    ``names(name)``, so no pattern grows with the number of names. A word next to a Chinese letter is no
    whole word.
    """
    words = parts.select("part_id", F.explode(t.names_in("text")).alias("name")).where(F.length("name") >= min_length)
    counted = words.groupBy("part_id", "name").agg(F.count("*").alias("n"))
    return counted.join(names.select("name").distinct(), "name", "left_semi").select("part_id", "name", "n")


def title_mentions(titles: DataFrame, names: DataFrame, min_length: int = 4) -> DataFrame:
    """``(part_id, name)``: classes whose name is part of a title (J-14).

    A name that is a whole word of a title is found by an equi join on words; one inside a longer
    identifier by a join on its first four letters at every place of the title, then compared.
    """
    named = names.where(F.length("name") >= min_length).select("name", F.lower(F.substring("name", 1, 4)).alias("gram")).distinct()
    size = F.length("title")
    places = F.when(size >= 4, F.sequence(F.lit(1), size - 3)).otherwise(F.array().cast("array<int>"))
    grams = titles.where("title IS NOT NULL").select("part_id", "title", F.explode(F.array_distinct(F.transform(places, lambda i: F.lower(F.substring(F.col("title"), i, F.lit(4)))))).alias("gram"))
    return grams.join(named, "gram").where(F.col("title").contains(F.col("name"))).select("part_id", "name").distinct()


def link_targets(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(doc_id, link, target, tier)``: what ``[[ns::Name]]`` links lead to (J-16, D-13).

    Tier 1 a class, 2 a function, 3 a struct of that name; within a tier one whose namespace is the
    link's counts first, then the smallest id.
    """
    links = documents.select("doc_id", F.explode(t.wiki_links("text")).alias("link")).distinct()
    links = links.withColumn("name", F.regexp_replace(t.tail("link"), r"\|.*$", "")).withColumn("ns", F.when(F.col("link").contains("::"), t.head("link")))
    rank = F.when(F.col("type") == "class", 1).when(F.col("type") == "function", 2).when(F.col("type") == "struct", 3)
    cand = nodes.select("id", "name", F.coalesce("namespace", F.lit("")).alias("namespace"), rank.alias("tier")).where("tier IS NOT NULL")
    off = F.when(F.col("ns").isNotNull() & (F.col("namespace") == F.col("ns")), 0).otherwise(1)
    best = links.join(cand, "name").groupBy("doc_id", "link").agg(F.min(F.struct("tier", off.alias("off"), "id")).alias("m"))
    return best.select("doc_id", "link", F.col("m.id").alias("target"), "m.tier")


def docs_for_code(edges: DataFrame, sections_: DataFrame) -> DataFrame:
    """``(code_id, doc_id, confidence)``: sections about a piece of code, over both directions of edges, with the best confidence (J-22, O-05)."""
    to = edges.where("relation_type = 'code_refers_to_doc'").select(F.col("src").alias("code_id"), F.col("dst").alias("doc_id"), "confidence")
    back = edges.where("relation_type = 'doc_describes_code'").select(F.col("dst").alias("code_id"), F.col("src").alias("doc_id"), "confidence")
    every = to.unionByName(back).join(sections_.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return every.groupBy("code_id", "doc_id").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def association_edges(pairs: DataFrame) -> DataFrame:
    """Both directions of ``pairs(doc_id, code_id, confidence, method)``: ``(src, dst, relation_type, confidence, match_method)`` (U-17)."""
    both = F.array(
        F.struct(F.col("doc_id").alias("src"), F.col("code_id").alias("dst"), F.lit("doc_describes_code").alias("relation_type")),
        F.struct(F.col("code_id").alias("src"), F.col("doc_id").alias("dst"), F.lit("code_refers_to_doc").alias("relation_type")),
    )
    out = pairs.select(F.explode(both).alias("e"), "confidence", F.col("method").alias("match_method")).select("e.*", "confidence", "match_method")
    best = F.max(F.struct("confidence", "match_method")).alias("m")
    return out.groupBy("src", "dst", "relation_type").agg(best).select("src", "dst", "relation_type", "m.confidence", "m.match_method")


def one_way_edges(edges: DataFrame) -> DataFrame:
    """Document edges without their counterpart: ``(src, dst, relation_type)`` (O-07)."""
    a = edges.where("relation_type = 'doc_describes_code'").select("src", "dst", "relation_type")
    b = edges.where("relation_type = 'code_refers_to_doc'").select("src", "dst", "relation_type")
    turned = lambda x: x.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return a.join(turned(b), ["src", "dst"], "left_anti").unionByName(b.join(turned(a), ["src", "dst"], "left_anti"))
