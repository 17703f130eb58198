"""SQL of the queries to documents: sections, heads, summaries, links and search, for DuckDB."""

from __future__ import annotations


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


#: A text without the lines of its code blocks, which ``{}`` stands for.
_NO_CODE = r"regexp_replace({}, '(?ms)^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\z)', '{}', 'g')"


def _summary(rows: str, text: str) -> str:
    """``summary``: of each of ``rows`` the first run of prose lines, else the first three items."""
    body = rf"regexp_replace(coalesce({text}, ''), '(?ms)\A[ \t]*---[ \t\r]*\n.*?^[ \t]*---[ \t\r]*$', '')"
    lines = f"list_transform(string_split({_NO_CODE.format(body, '```')}, chr(10)), lambda x: {_strip('x')})"
    letter = r"""CASE WHEN regexp_matches(x, '^(?:```|#|$)') OR regexp_matches(x, '^(?:---|\*\*\*|___)$') THEN 'b' WHEN regexp_matches(x, '^>[>\s]*$') THEN 'n'
      WHEN regexp_matches(x, '^>') THEN 'q' WHEN regexp_matches(x, '^[^|]*\|[^|]*\|') THEN 'b' WHEN regexp_matches(x, '^(?:[-*]|\d+\.)\s') THEN 'i' ELSE 'p' END"""
    return rf"""SELECT * EXCLUDE (lines, kinds, s), CASE WHEN length(s) > 200 THEN substr(s, 1, 197) || '...' ELSE s END AS summary FROM (SELECT *,
  CASE WHEN contains(kinds, 'p') THEN array_to_string(lines[strpos(kinds, 'p'):strpos(kinds, 'p') + length(regexp_extract(kinds, 'p+')) - 1], ' ')
  ELSE array_to_string(list_transform(list_filter(lines, lambda x: {letter} = 'i')[1:3], lambda x: regexp_replace(x, '^(?:[-*]|\d+\.)\s+', '')), ' | ') END AS s
  FROM (SELECT *, array_to_string(list_transform(lines, lambda x: {letter}), '') AS kinds FROM (SELECT *, {lines} AS lines FROM {rows})))"""


# --- the heads of documents

_HEAD = r"heads AS (SELECT *, regexp_extract(coalesce(text, ''), '(?ms)\A[ \t]*---[ \t\r]*\n(.*?)^[ \t]*---[ \t\r]*$', 1) AS head FROM documents WHERE doc_id IS NOT NULL)"


def _bare(c: str) -> str:
    return rf"trim(trim({c}), '''" + '"' + "')"


def _values(name: str) -> str:
    """The values of a field of a head: none of one without, those in brackets, one, or those of the lines after it."""
    value = rf"trim(regexp_extract(head, '(?m)^{name}[ \t]*:[ \t]*([^\n]*)$', 1))"
    after = rf"regexp_extract(head, '(?m)^{name}[ \t]*:[ \t]*\n((?:[ \t]*-[ \t]+[^\n]*\n)*)', 1)"
    uncommented = rf"regexp_replace({value}, '\s+#.*$', '')"
    items = rf"regexp_extract_all({after}, '(?m)^[ \t]*-[ \t]+([^\n]*)$', 1)"
    return (
        f"CASE WHEN {value} = '' THEN list_transform({items}, lambda x: {_bare('x')}) WHEN {value}[1] = '[' AND {value}[-1] = ']' "
        rf"THEN list_transform(list_filter(string_split({value}[2:-2], ','), lambda x: trim(x) <> ''), lambda x: {_bare('x')}) "
        f"ELSE [{_bare(uncommented)}] END"
    )


def _path_id(c: str) -> str:
    return rf"'doc:' || regexp_replace(regexp_replace(replace(regexp_replace(replace({c}, '\', '/'), '\.md$', ''), '/', '-'), '-+', '-', 'g'), '^-|-$', '', 'g')"


_ITEM = rf"""summed AS ({_summary('heads', 'text')}),
item AS (SELECT doc_id, path, text, coalesce('doc:' || ({_values('doc_id')})[1], {_path_id('path')}) AS key,
  CASE WHEN coalesce(({_values('type')})[1], '') <> '' THEN ({_values('type')})[1] WHEN regexp_matches(lower(path), '(^|/)diary/') THEN 'diary'
    WHEN regexp_matches(lower(path), '(^|/)review_reports/') THEN 'review' WHEN regexp_matches(lower(path), '(^|/)task/') THEN 'task'
    WHEN contains(lower(path), 'completion status') THEN 'report' WHEN regexp_matches(text, '## [^\n]+\n-\s*\*\*类型\*\*') THEN 'diary' ELSE 'doc' END AS type,
  coalesce(nullif(({_values('title')})[1], ''), nullif(trim(regexp_extract(coalesce(text, ''), '(?m)^[ \t]*# ([^\n]*)$', 1)), ''), title) AS title,
  coalesce(nullif(({_values('summary')})[1], ''), summary) AS summary, array_to_string({_values('tags')}, ',') AS tags,
  coalesce(try_cast(nullif(regexp_extract(coalesce(path, ''), '(\d{{4}}-\d{{2}}-\d{{2}})', 1), '') AS DATE),
    try_cast(nullif(regexp_extract(substr(coalesce(text, ''), 1, 500), '(\d{{4}}-\d{{2}}-\d{{2}})', 1), '') AS DATE), updated_at::DATE) AS date,
  regexp_matches(head, '(?m)^\w+[ \t]*:') AS manual FROM summed)"""
DOCUMENT_NODES = f"WITH {_HEAD}, {_ITEM} SELECT doc_id, key, type, title, summary, path, tags, date, manual FROM item"

# --- links and symbols

_SYMBOLS = r"""list_concat(regexp_extract_all(body, '`([A-Z][A-Za-z0-9_]*(?:::[A-Za-z0-9_~]+)+)`', 1),
  list_filter(regexp_extract_all(body, '`([A-Z][A-Za-z0-9_]{2,})`', 1), lambda x: regexp_matches(x, '\p{Ll}') AND NOT regexp_matches(x, '^[A-Z]{2,}_')))"""
_PLACE = r"regexp_replace(coalesce(path, ''), '[^/]*$', '') || regexp_replace(regexp_replace(link, '#.*$', ''), '\.md$', '')"
_UP = _PLACE
for _ in range(4):
    _UP = rf"regexp_replace({_UP}, '(^|/)[^/]*[^/.][^/]*/\.\./', '\1')"
_LINK_ID = rf"'doc:' || regexp_replace(regexp_replace(regexp_replace(replace({_UP}, '/', '-'), '\.+', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"
_EDGES = rf"""{_HEAD}, bodies AS (SELECT doc_id, path, head, {_NO_CODE.format('text', '')} AS body FROM heads),
links AS (SELECT doc_id, path, unnest(regexp_extract_all(body, '(?:^|[^!])\[[^\]\n]*\]\(([^)\s]+)\)', 1)) AS link FROM bodies),
alias AS (SELECT {_path_id('path')} AS alias, min('doc:' || ({_values('doc_id')})[1]) AS key FROM heads WHERE ({_values('doc_id')})[1] IS NOT NULL GROUP BY 1),
every AS (
  SELECT doc_id AS src, 'doc:' || regexp_replace(unnest({_values('relates_to')}), '^doc:', '') AS dst, 'relates_to' AS rel, true AS manual FROM heads
  UNION ALL SELECT doc_id, 'symbol:' || unnest({_values('code_symbols')}), 'mentions_symbol', true FROM heads
  UNION ALL SELECT doc_id, coalesce(key, id), 'relates_to', false FROM (SELECT doc_id, {_LINK_ID} AS id FROM links WHERE NOT regexp_matches(link, '^(?:https?:|mailto:|#)')) LEFT JOIN alias ON alias = id
  UNION ALL SELECT doc_id, 'symbol:' || unnest({_SYMBOLS}), 'mentions_symbol', false FROM bodies),
edges AS (SELECT src, dst, rel, bool_or(manual) AS manual FROM every GROUP BY ALL)"""
DOCUMENT_EDGES = f"WITH {_EDGES} SELECT * FROM edges"

_REACH = """found AS (SELECT key AS src, dst, rel FROM edges JOIN item ON edges.src = doc_id),
starts AS (SELECT src AS start FROM found GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10),
arcs AS (SELECT src AS a, dst AS b FROM found WHERE rel <> 'mentions_symbol' UNION SELECT dst, src FROM found WHERE rel <> 'mentions_symbol'),
one AS (SELECT start, b AS node FROM starts JOIN arcs ON a = start), two AS (SELECT start, b AS node FROM one JOIN arcs ON a = node),
near AS (SELECT start, node, min(hop) AS hop FROM (SELECT start, start AS node, 0 AS hop FROM starts UNION ALL SELECT *, 1 FROM one UNION ALL SELECT *, 2 FROM two) GROUP BY ALL),
leaf AS (SELECT start, dst AS node, min(hop) + 1 AS hop FROM near JOIN found ON src = node WHERE rel = 'mentions_symbol' AND hop < 2 GROUP BY ALL)"""
DOCUMENT_REACH = f"WITH {_EDGES}, {_ITEM}, {_REACH} SELECT * FROM near UNION ALL SELECT * FROM leaf"

REPAIRED_LINKS = rf"""WITH {_EDGES}, {_ITEM}, known AS (SELECT DISTINCT key FROM item WHERE key IS NOT NULL),
link AS (SELECT DISTINCT src, dst FROM edges WHERE rel = 'relates_to'),
ends AS (SELECT split_part(regexp_replace(key, '^doc:', ''), '-', -1) AS tail, min(key) AS key FROM known GROUP BY 1 HAVING count(*) = 1)
SELECT src, dst FROM link WHERE dst IN (FROM known)
UNION SELECT src, key FROM link JOIN ends ON tail = split_part(regexp_replace(dst, '^doc:', ''), '-', -1) WHERE dst NOT IN (FROM known) AND ends_with(key, regexp_replace(dst, '^doc:', ''))"""


def missing_symbols(nodes: str) -> str:
    return f"""WITH {nodes}, {_EDGES} SELECT DISTINCT dst AS key FROM edges WHERE rel = 'mentions_symbol'
AND dst NOT IN (SELECT 'symbol:' || name FROM n WHERE type IN ('class', 'struct', 'function') AND name IS NOT NULL)"""


def associations(nodes: str) -> str:
    return rf"""WITH {nodes}, code AS (SELECT id, name FROM n WHERE type IN ('class', 'struct') AND length(name) >= 4),
words AS (SELECT DISTINCT id, unnest(regexp_extract_all(content_preview, '[\p{{L}}\p{{N}}_]+')) AS name FROM n WHERE type = 'doc_section'),
pairs AS (SELECT words.id AS doc_id, code.id AS code_id, 0.6 AS confidence, 'content' AS method FROM words JOIN code USING (name) WHERE regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$')
  UNION ALL SELECT n.id, code.id, 0.8, 'title' FROM n JOIN code ON contains(n.heading, code.name) WHERE n.type = 'doc_section'),
best AS (SELECT doc_id, code_id, max(confidence)::DOUBLE AS confidence, arg_max(method, confidence) AS match_method FROM pairs GROUP BY ALL)
SELECT doc_id AS src, code_id AS dst, 'doc_describes_code' AS relation_type, confidence, match_method FROM best
UNION ALL SELECT code_id, doc_id, 'code_refers_to_doc', confidence, match_method FROM best"""


# --- sections


def _sections(fences: bool) -> str:
    code = r"(sum(regexp_matches(line, '^\s*```')::INT) OVER (PARTITION BY doc_id ORDER BY no)) % 2 = 1" if fences else "false"
    name = r"coalesce(nullif(trim(regexp_extract(text, '(?m)^[ \t]*# ([^#\n][^\n]*)$', 1)), ''), regexp_replace(split_part(coalesce(path, ''), '/', -1), '\.[^./]*$', ''))"
    heading = r"regexp_replace(regexp_replace({}, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '`([^`]+)`', '\1', 'g')"
    return rf"""ln AS (SELECT doc_id, path, {name} AS name, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
fenced AS (SELECT *, {code} AS code FROM ln),
marked AS (SELECT *, NOT code AND regexp_matches(line, '^\s*##\s+\S') AS h FROM fenced),
parted AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY no) AS part, bool_or(h) OVER (PARTITION BY doc_id) AS any_h FROM marked),
raw AS (SELECT doc_id, path, part, CASE WHEN bool_or(h) THEN max(regexp_extract(line, '^\s*##\s+(.*?)\s*$', 1)) FILTER (h) WHEN bool_or(any_h) THEN '' ELSE any_value(name) END AS heading,
  min(no) AS start_line, max(no) AS end_line, {_strip("coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT h), '')")} AS content FROM parted GROUP BY doc_id, path, part),
section AS (SELECT doc_id, path, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS section_no, {heading.format('heading')} AS heading, start_line, end_line, content FROM raw)"""


_WORDS = r"(len(regexp_extract_all({0}, '[\x{{4E00}}-\x{{9FFF}}]')) + len(regexp_extract_all({0}, '[a-zA-Z_][a-zA-Z0-9_]*')))::INT"
SECTION_NODES = rf"""WITH {_sections(False)},
kept AS (SELECT *, (section_no = 0 OR {_WORDS.format('content')} >= 20)::INT AS k FROM section),
grouped AS (SELECT *, sum(k) OVER (PARTITION BY doc_id ORDER BY section_no) AS part FROM kept),
merged AS (SELECT doc_id, min(section_no) AS no, arg_min(path, section_no) AS path, arg_min(heading, section_no) AS heading, min(start_line)::BIGINT AS start_line, max(end_line)::BIGINT AS end_line,
  string_agg(content, chr(10) || chr(10) ORDER BY section_no) AS content FROM grouped GROUP BY doc_id, part)
SELECT 'doc_section|' || coalesce(path, '') || '|' || start_line AS unique_key, doc_id, path, heading, 2::BIGINT AS section_level, start_line, end_line,
  substr(sha256(content), 1, 16) AS content_hash, {_WORDS.format('content')} AS word_count,
  CASE WHEN regexp_matches(path, '^docs/.*telemetry.*$') THEN ['telemetry', 'docs'] WHEN regexp_matches(path, '^docs/.*$') THEN ['docs'] ELSE [] END AS tags FROM merged"""


def _diary(name: str) -> str:
    return rf"nullif(trim(regexp_extract(regexp_replace(content, '(?ms)^[ \t]*```.*', ''), '(?m)^-\s*\*\*{name}\*\*\s*[:：]\s*([^\n]*)$', 1)), '')"


KNOWLEDGE_NODES = rf"""WITH {_sections(True)}, headed AS (SELECT * FROM section WHERE heading <> ''), summed AS ({_summary('headed', 'content')})
SELECT doc_id, 'know:' || doc_id || '/' || lpad(section_no::VARCHAR, 3, '0') || '-'
  || regexp_replace(lower(substr(regexp_replace(heading, '[^\p{{L}}\p{{N}}]+', '-', 'g'), 1, 40)), '^-|-$', '', 'g') AS key, heading,
  coalesce({_diary('结论')}, summary) AS summary, {_diary('类型')} AS kind, coalesce({_diary('结论')}, {_diary('影响')}) AS conclusion,
  nullif(regexp_extract(coalesce({_diary('会话')}, ''), '^[0-9a-f]+'), '') AS session, nullif(regexp_extract(content, '(?m)^#{{2,4}}\s*\[(P\d)\]', 1), '') AS severity FROM summed"""

# --- search

TERMS = r"list_transform(regexp_extract_all(regexp_replace(regexp_replace(replace({}, '_', ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([\x{{4E00}}-\x{{9FFF}}])', ' \1 ', 'g'), '[\x{{4E00}}-\x{{9FFF}}]|\p{{L}}+|\d+'), lambda x: lower(x))"
_COLUMNS = ("title", "summary", "path", "tags")
DOCUMENT_SEARCH = rf"""WITH {_EDGES}, {_ITEM},
d AS (SELECT doc_id AS key, {TERMS.format("concat_ws(' ', title, summary, path, tags)")} AS terms FROM item),
st AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM d), p AS (SELECT key, len(terms) AS size, unnest(terms) AS term FROM d),
h AS (SELECT key, size, term, count(*) AS tf FROM p WHERE term = 'reader' GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
score AS (SELECT key, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS s FROM h JOIN f USING (term), st GROUP BY 1),
parts AS (SELECT doc_id AS key, {" + ".join(f"coalesce(contains(lower({c}), 'reader'), false)::INT" for c in _COLUMNS)} AS n FROM item),
named AS (SELECT src AS key, count(*) AS n FROM edges WHERE rel = 'mentions_symbol' AND contains(lower(dst), 'reader') GROUP BY 1),
routes AS (
  SELECT 'bm25' AS route, key, row_number() OVER (ORDER BY round(s, 9) DESC, key) - 1 AS rank FROM score
  UNION ALL SELECT 'part', key, row_number() OVER (ORDER BY n DESC, key) - 1 FROM parts WHERE n > 0
  UNION ALL SELECT 'symbol', key, row_number() OVER (ORDER BY n DESC, key) - 1 FROM named),
fused AS (SELECT key, round(sum(1 / (61 + rank)), 6) AS score, array_to_string(list_sort(list(DISTINCT route)), '+') AS routes,
  max(CASE WHEN route = 'bm25' THEN rank < 10 ELSE rank = 0 END) AS kept FROM routes WHERE rank < 30 GROUP BY 1),
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS place FROM fused)
SELECT key, score, routes, place FROM placed WHERE place <= 10 OR kept"""

_STORE = r"""store AS (SELECT trim(title) AS title, min(updated_at) AS first, max(updated_at) AS last,
  'f-' || strftime(min(updated_at), '%Y%m%d%H%M%S') || '-' || substr(md5(trim(title)), 1, 4) AS id FROM documents WHERE trim(title) <> '' GROUP BY 1)"""


def freshness(nodes: str) -> str:
    symbols = _SYMBOLS.replace("body", "coalesce(text, '')")
    return rf"""WITH {nodes}, {_STORE},
rows AS (SELECT trim(title) AS title, updated_at, text AS detail, list_sort(list_distinct({symbols})) AS symbols, source, [doc_type] AS tags FROM documents WHERE trim(title) <> ''),
latest AS (SELECT title, symbols FROM rows QUALIFY row_number() OVER (PARTITION BY title ORDER BY updated_at DESC NULLS LAST, detail DESC NULLS LAST) = 1),
anchor AS (SELECT DISTINCT id, symbol FROM (SELECT id, unnest(symbols) AS symbol FROM latest JOIN store USING (title)) WHERE regexp_matches(symbol, '^[A-Za-z_][\p{{L}}\p{{N}}_:~]*$')),
code AS (SELECT DISTINCT name, lower(name) AS low, type IN ('class', 'struct', 'function') AS own FROM n WHERE name IS NOT NULL),
known AS (SELECT DISTINCT symbol FROM (SELECT DISTINCT symbol, split_part(symbol, '::', -1) AS short FROM anchor) s JOIN code ON own AND name = short OR length(short) >= 3 AND contains(low, lower(short))),
per AS (SELECT id, bool_or(symbol IN (FROM known)) AS left_over, count(*) FILTER (symbol NOT IN (FROM known)) AS n_missing FROM anchor GROUP BY 1)
SELECT id, 'active' AS before, 'stale' AS after, n_missing::INT AS n_missing FROM per WHERE NOT left_over"""


FINDING_SEARCH = rf"""WITH {_STORE},
rows AS (SELECT trim(title) AS title, updated_at, text AS detail, [doc_type] AS tags FROM documents WHERE trim(title) <> ''),
latest AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY title ORDER BY updated_at DESC NULLS LAST, detail DESC NULLS LAST) = 1),
hit AS (SELECT id, last FROM latest JOIN store USING (title) WHERE list_has_any({TERMS.format("concat_ws(' ', title, detail, array_to_string(tags, ' '))")}, ['deadlock', 'queue', 'wait'])),
ranked AS (SELECT id, row_number() OVER (ORDER BY last DESC, id) - 1 AS rank FROM hit)
SELECT id, round(1 / (61 + rank), 6) AS score, 'words' AS routes, row_number() OVER (ORDER BY rank) AS place FROM ranked WHERE rank < 10"""
