"""Queries to the code graph over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import code, graph, questions
from lodegraph.plans.views import CALLS, INHERITS, NE, E, N, edges, nodes, sql_in
from lodegraph.runtime import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def hottest(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """Seeds: the k functions with the most calls to them."""
    e = edges(spark, d, relations=CALLS)
    fn = nodes(spark, d, "type").where("type = 'function'").select(F.col("id").alias("dst"))
    top = e.join(fn, "dst", "left_semi").groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(k)
    return top.select(F.col("dst").alias("seed"), F.col("dst").alias("node"))


_CALLS, _INH = sql_in(CALLS), sql_in(INHERITS)
_HOT = f"""hot AS (SELECT dst AS seed FROM e WHERE relation_type IN {_CALLS} AND dst IN (SELECT id FROM n WHERE type = 'function')
  GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 5)"""
_OWN = """own AS (SELECT src AS member, arg_min(name, e.id) AS owner_name FROM e JOIN n ON e.dst = n.id
  WHERE relation_type = 'belongs_to' GROUP BY src)"""
_SITES = f"""sites AS (SELECT src AS caller_id, dst AS callee_id, a.name AS caller_name, b.name AS callee_name, a.file_path AS caller_file,
  call_line, relation_type AS call_type, b.namespace AS callee_namespace FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst
  WHERE relation_type IN {_CALLS} AND a.type = 'function' AND b.type = 'function')"""


# --- search -----------------------------------------------------------------------------------------


@query(f"WITH {N} SELECT id, type, name, namespace, file_path FROM n WHERE name = 'Reader' OR contains(lower(name), 'reader') ORDER BY name, id LIMIT 100")
def search_name(spark, d):
    """Names with a pattern, without regard to case, the first 100 by name (P-03, T-01, F-01)."""
    return nodes(spark, d, "type", "name", "namespace", "file_path").where(F.col("name").ilike("%reader%")).orderBy("name", "id").limit(100)


@query(f"""WITH {N}, hits AS (SELECT id, name, type FROM n WHERE type IN ('class', 'struct') AND contains(lower(name), 'writer'))
SELECT id, name FROM hits WHERE type = (SELECT min(type) FROM hits)""")
def search_class(spark, d):
    """Classes with a pattern, structs only where no class has it (P-04, O-01)."""
    hits = cut(nodes(spark, d, "type", "name").where("type IN ('class', 'struct')").where(F.col("name").ilike("%writer%")))
    return hits.where(F.col("type") == hits.agg(F.min("type")).scalar()).select("id", "name")


@query(f"""WITH {N} SELECT id, name, namespace, split_part(namespace, '::', -1) AS class_name FROM n
WHERE type = 'function' AND contains(lower(name), 'now') AND contains(namespace, '::') AND
  (split_part(namespace, '::', -1) LIKE '%Store' OR contains(namespace, 'nav'))""")
def search_function(spark, d):
    """Functions by pattern and class or part of the namespace (P-05, P-27)."""
    n = nodes(spark, d, "type", "name", "namespace").where("type = 'function'").where(F.col("name").ilike("%now%"))
    n = n.withColumn("class_name", code.name_tail("namespace"))
    return n.where(F.col("class_name").isNotNull() & (F.col("class_name").endswith("Store") | F.col("namespace").contains("nav"))).select("id", "name", "namespace", "class_name")


@query(f"WITH {N} SELECT id, type, name, file_path, start_line FROM n WHERE contains(lower(file_path), 'src/planner')")
def file_symbols(spark, d):
    """Symbols of files with a path part (P-06)."""
    return nodes(spark, d, "type", "name", "file_path", "start_line").where(F.col("file_path").ilike("%src/planner%"))


@query(f"WITH {N} SELECT parent_class, count(*) AS n_methods, count(DISTINCT name) AS n_names FROM n WHERE type = 'function' AND parent_class IS NOT NULL GROUP BY 1")
def class_methods(spark, d):
    """Methods per class (P-07)."""
    n = nodes(spark, d, "type", "name", "parent_class").where("type = 'function' AND parent_class IS NOT NULL")
    return n.groupBy("parent_class").agg(F.count("*").alias("n_methods"), F.countDistinct("name").alias("n_names"))


@query(f"""WITH {N} SELECT id, name, namespace FROM n
WHERE namespace = 'nav' OR starts_with(namespace, 'nav::') OR ends_with(namespace, '::nav') ORDER BY id LIMIT 5""")
def namespace_segment(spark, d):
    """The first five nodes with a namespace segment at either end (P-08, P-09, P-11)."""
    ns = F.col("namespace")
    return nodes(spark, d, "name", "namespace").where((ns == "nav") | ns.startswith("nav::") | ns.endswith("::nav")).orderBy("id").limit(5)


@query(f"""WITH {N} SELECT id, type, name FROM n WHERE type IN ('class', 'struct', 'function') AND (contains(namespace, 'nav') OR contains(namespace, 'diag'))
AND regexp_matches(name, '^(Open|Linked|Paged)') AND is_project""")
def path_filter(spark, d):
    """A composed node filter: types, namespaces, name pattern, project (P-12)."""
    n = nodes(spark, d, "type", "name", "namespace", "is_project").where(F.col("type").isin("class", "struct", "function") & F.col("is_project"))
    keep = F.exists(F.array(F.lit("nav"), F.lit("diag")), lambda p: F.col("namespace").contains(p)) & F.col("name").rlike("^(Open|Linked|Paged)")
    return n.where(keep).select("id", "type", "name")


# --- edges ------------------------------------------------------------------------------------------


@query(f"WITH {NE} SELECT src, dst, relation_type, call_line AS line, name AS dst_name, type AS dst_type FROM e JOIN n ON dst = n.id")
def out_edges(spark, d):
    """Every edge with its target's columns (J-01)."""
    n = nodes(spark, d, "name", "type").select(F.col("id").alias("dst"), F.col("name").alias("dst_name"), F.col("type").alias("dst_type"))
    return edges(spark, d).drop("edge_id").join(n, "dst")


@query(f"WITH {NE} SELECT dst, relation_type, count(*) AS n_edges, count(DISTINCT name) AS n_sources FROM e JOIN n ON src = n.id GROUP BY ALL")
def in_edges(spark, d):
    """Edges into every node with their sources, summed up (J-02)."""
    n = nodes(spark, d, "name").select(F.col("id").alias("src"), "name")
    return edges(spark, d).join(n, "src").groupBy("dst", "relation_type").agg(F.count("*").alias("n_edges"), F.countDistinct("name").alias("n_sources"))


@query(f"""WITH {NE} SELECT relation_type, count(*) AS n_edges, count(*) FILTER (coalesce(confidence, 0) >= 0.7) AS n_sure,
count(*) FILTER (src NOT IN (SELECT id FROM n) OR dst NOT IN (SELECT id FROM n)) AS n_dangling FROM e GROUP BY 1""")
def edge_quality(spark, d):
    """Edges per relation: all, sure ones, ones with an end that is gone (P-15, U-11)."""
    n = nodes(spark, d).withColumn("here", F.lit(True))
    e = edges(spark, d, "confidence").join(n.select(F.col("id").alias("src"), F.col("here").alias("a")), "src", "left").join(n.select(F.col("id").alias("dst"), F.col("here").alias("b")), "dst", "left")
    sure = F.coalesce("confidence", F.lit(0.0)) >= 0.7
    return e.groupBy("relation_type").agg(F.count("*").alias("n_edges"), F.count_if(sure).alias("n_sure"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_dangling"))


# --- calls ------------------------------------------------------------------------------------------


@query(f"""WITH {NE}, {_OWN}, {_SITES} SELECT callee_id, callee_name, caller_id, caller_name, owner_name AS caller_class, caller_file, call_line, call_type
FROM (FROM sites QUALIFY row_number() OVER (PARTITION BY callee_id, caller_name, caller_file, call_line ORDER BY caller_id, call_type) = 1)
LEFT JOIN own ON member = caller_id""")
def callers(spark, d):
    return code.callers(edges(spark, d, relations=[*CALLS, "belongs_to"]), nodes(spark, d, "type", "name", "file_path"))


@query(f"""WITH {NE}, {_OWN}, {_SITES} SELECT caller_id, callee_id, callee_name,
  coalesce(owner_name, CASE WHEN contains(callee_namespace, '::') THEN split_part(callee_namespace, '::', -1) END) AS callee_class, call_line, call_type
FROM (FROM sites QUALIFY row_number() OVER (PARTITION BY caller_id, callee_name, call_line ORDER BY callee_id, call_type) = 1)
LEFT JOIN own ON member = callee_id""")
def callees(spark, d):
    return code.callees(edges(spark, d, relations=[*CALLS, "belongs_to"]), nodes(spark, d, "type", "name", "file_path", "namespace"))


_OVER = """over(base, derived, depth) AS (SELECT dst, src, 1 FROM e WHERE relation_type = 'overrides'
  UNION SELECT base, e.src, depth + 1 FROM over JOIN e ON e.dst = over.derived AND relation_type = 'overrides' WHERE depth < 60),
closed AS (SELECT base, derived, min(depth) AS depth FROM over WHERE base <> derived GROUP BY ALL)"""


@query(f"WITH RECURSIVE {E}, {_OVER} SELECT * FROM closed")
def override_closure(spark, d):
    return code.override_closure(edges(spark, d, relations=["overrides"]))


_EXP = f"""expanded AS (SELECT src, dst, relation_type AS via FROM e WHERE relation_type IN {_CALLS}
  UNION SELECT src, derived, 'calls_virtual_expanded' FROM e JOIN closed ON dst = base WHERE relation_type = 'calls_virtual')"""


@query(f"WITH RECURSIVE {E}, {_OVER}, {_EXP} SELECT src, via, count(*) AS n_callees FROM expanded GROUP BY ALL")
def calls_expanded(spark, d):
    """Callees of every function with virtual calls expanded to all overrides (G-04, G-05)."""
    return code.expanded_calls(edges(spark, d, relations=[*CALLS, "overrides"])).groupBy("src", "via").agg(F.count("*").alias("n_callees"))


def _chain(a: str, b: str) -> str:
    return f"""WITH RECURSIVE {NE}, {_HOT}, walk(seed, node, depth) AS (SELECT seed, seed, 0 FROM hot
  UNION SELECT seed, {b}, depth + 1 FROM walk JOIN e ON {a} = node AND relation_type IN {_CALLS} WHERE depth < 3)
SELECT seed, node, min(depth) AS depth FROM walk GROUP BY ALL HAVING min(depth) > 0"""


@query(_chain("dst", "src"))
def call_chain_up(spark, d):
    return code.call_chain(hottest(spark, d), edges(spark, d, relations=CALLS), "up", 3)


@query(_chain("src", "dst"))
def call_chain_down(spark, d):
    return code.call_chain(hottest(spark, d), edges(spark, d, relations=CALLS), "down", 3)


@query(f"WITH {NE} SELECT id, name FROM n WHERE type = 'function' AND NOT EXISTS (FROM e WHERE dst = n.id AND relation_type IN {_CALLS})")
def uncalled(spark, d):
    """Functions that nothing calls (J-25, G-29)."""
    return code.uncalled(edges(spark, d, relations=CALLS), nodes(spark, d, "type", "name"))


# --- inheritance ------------------------------------------------------------------------------------

_ANC = f"""inh AS (SELECT DISTINCT src AS child, dst AS parent FROM e WHERE relation_type IN {_INH}),
up(seed, node, depth) AS (SELECT child, parent, 1 FROM inh UNION SELECT seed, parent, depth + 1 FROM up JOIN inh ON child = node WHERE depth < 60),
anc AS (SELECT seed, node, min(depth) AS depth FROM up WHERE seed <> node GROUP BY ALL)"""


@query(f"WITH RECURSIVE {E}, {_ANC} SELECT * FROM anc")
def ancestors(spark, d):
    """All ancestors of every class (G-01, G-02, G-10)."""
    return code.inheritance(edges(spark, d, relations=INHERITS))


@query(f"WITH RECURSIVE {E}, {_ANC} SELECT node AS seed, seed AS node, depth FROM anc WHERE depth <= 3")
def descendants(spark, d):
    """Descendants of every class to three levels (G-10)."""
    return code.inheritance(edges(spark, d, relations=INHERITS), "descendants", 3)


@query(f"""WITH RECURSIVE {E}, inh AS (SELECT DISTINCT src AS child, dst AS parent FROM e WHERE relation_type IN {_INH}),
path(seed, node, p, depth) AS (SELECT DISTINCT child, child, [child], 0 FROM inh WHERE child IN (SELECT child FROM inh GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT seed, parent, list_append(p, parent), depth + 1 FROM path JOIN inh ON child = node WHERE NOT list_contains(p, parent) AND depth < 6)
SELECT seed AS derived, node AS base, count(*) AS n_paths,
  array_to_string(list_sort(list_distinct(flatten(list(p[2:-2])))), ',') AS between FROM path WHERE depth > 0 GROUP BY ALL HAVING count(*) > 1""")
def diamonds(spark, d):
    """Diamond inheritance within six levels (G-03, A-09)."""
    return code.diamonds(edges(spark, d, relations=INHERITS), 6)


@query(f"""WITH RECURSIVE {E}, inh AS (SELECT DISTINCT src AS child, dst AS parent FROM e WHERE relation_type IN {_INH}),
path(seed, node, p, depth) AS (SELECT DISTINCT child, child, [child], 0 FROM inh WHERE child IN (SELECT child FROM inh GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT seed, parent, list_append(p, parent), depth + 1 FROM path JOIN inh ON child = node WHERE NOT list_contains(p, parent) AND depth < 10)
SELECT seed AS derived, node AS base, count(*) AS n_paths,
  array_to_string(list_sort(list_distinct(flatten(list(p[2:-2])))), ',') AS between FROM path WHERE depth > 0 GROUP BY ALL HAVING count(*) > 1""")
def diamonds_full(spark, d):
    """Diamond inheritance within the operator's ten levels, as the reference has it (G-03, A-09)."""
    return code.diamonds(edges(spark, d, relations=INHERITS))


_VIRT = """own AS (SELECT id AS class_id, id AS owner FROM n WHERE type IN ('class', 'struct')
  UNION SELECT seed, node FROM anc WHERE seed IN (SELECT id FROM n WHERE type IN ('class', 'struct')))"""


@query(f"""WITH RECURSIVE {NE}, {_ANC}, {_VIRT} SELECT DISTINCT class_id, n.id AS function_id, name, owner AS from_class, coalesce(is_pure_virtual, false) AS pure
FROM own JOIN e ON relation_type = 'belongs_to' AND e.dst = owner JOIN n ON n.id = e.src WHERE type = 'function' AND is_virtual""")
def virtual_functions(spark, d):
    return code.virtual_functions(edges(spark, d, relations=[*INHERITS, "belongs_to"]), nodes(spark, d, "type", "name", "is_virtual", "is_pure_virtual"))


_ABS = """abs AS (SELECT id AS class_id FROM n WHERE type IN ('class', 'struct') AND is_abstract
  UNION SELECT dst FROM e JOIN n ON n.id = src WHERE relation_type = 'belongs_to' AND type = 'function' AND is_pure_virtual)"""


@query(f"WITH RECURSIVE {NE}, {_ANC}, {_ABS} SELECT node AS interface, seed AS class_id, depth, seed IN (FROM abs) AS is_abstract FROM anc WHERE node IN (FROM abs)")
def implementations(spark, d):
    """Classes below every abstract class (G-11, G-12, J-28)."""
    return code.implementations(edges(spark, d, relations=[*INHERITS, "belongs_to"]), nodes(spark, d, "type", "is_abstract", "is_pure_virtual"), include_abstract=True)


@query(f"""WITH RECURSIVE {NE}, {_OVER}, {_OWN}, lab AS (SELECT base, derived, coalesce(owner_name, '') || '::' || name AS label
  FROM closed JOIN n ON n.id = derived LEFT JOIN own ON member = derived),
listed AS (SELECT base, count(*) AS k, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM lab GROUP BY 1)
SELECT DISTINCT c.id AS class_id, f.id AS function_id, coalesce(k, 0) AS n_overrides, coalesce(labels, '') AS overrides
FROM e JOIN n c ON c.id = e.dst JOIN n f ON f.id = e.src LEFT JOIN listed ON base = f.id
WHERE relation_type = 'belongs_to' AND c.type IN ('class', 'struct') AND f.type = 'function' AND f.is_virtual""")
def virtual_table(spark, d):
    """Virtual functions of every class with their overrides (G-13, G-14, A-08)."""
    return code.virtual_table(edges(spark, d, relations=["overrides", "belongs_to"]), nodes(spark, d, "type", "name", "is_virtual", "is_pure_virtual"))


# --- traversal --------------------------------------------------------------------------------------

_ORIENT = f"""arcs AS (SELECT CASE WHEN relation_type IN {sql_in(list(graph.FLIPPED))} THEN dst ELSE src END AS a,
  CASE WHEN relation_type IN {sql_in(list(graph.FLIPPED))} THEN src ELSE dst END AS b, relation_type FROM e)"""


@query(f"""WITH RECURSIVE {NE}, {_HOT}, {_ORIENT}, walk(node, depth) AS (SELECT seed, 0 FROM hot UNION SELECT b, depth + 1 FROM walk JOIN arcs ON a = node WHERE depth < 2),
best AS (SELECT node, min(depth) AS depth FROM walk GROUP BY 1),
into_ AS (SELECT b AS node, depth + 1 AS depth, min((a, relation_type)) AS m FROM best JOIN arcs ON a = node GROUP BY ALL)
SELECT node, depth, m[1] AS parent, m[2] AS relation_type FROM best LEFT JOIN into_ USING (node, depth) ORDER BY depth, node LIMIT 100""")
def traverse_bfs(spark, d):
    """The first 100 nodes within two steps of the hottest functions, over all relations (G-15, G-17, T-05)."""
    arcs = cut(graph.orient(edges(spark, d)))
    return graph.traverse(hottest(spark, d).select("node"), arcs, 2, 100)[0]


@query()
def traverse_dfs(spark, d):
    """Depth-first order from the function with the most calls (G-16); no SQL has this order."""
    arcs = cut(edges(spark, d, relations=CALLS).select("src", "dst"))
    start = arcs.groupBy("src").count().orderBy(F.desc("count"), "src").first()
    return graph.depth_first(start["src"] if start else 0, arcs, 3, 1_000_000)


_BLAST_SEEDS = """seeds AS (SELECT dst AS seed FROM e JOIN n ON n.id = dst WHERE relation_type = 'belongs_to' AND type IN ('class', 'struct')
  GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 3)"""


@query(f"""WITH RECURSIVE {NE}, {_OVER}, {_EXP}, {_BLAST_SEEDS}, inh AS (SELECT DISTINCT src AS child, dst AS parent FROM e WHERE relation_type IN {_INH}),
members AS (SELECT src AS member, dst AS owner FROM e WHERE relation_type = 'belongs_to'),
sub AS (SELECT seed, child AS node FROM seeds JOIN inh ON parent = seed),
s1 AS (SELECT seed, seed AS node, 0 AS depth FROM seeds UNION ALL SELECT seed, member, 0 FROM seeds JOIN members ON owner = seed
  UNION ALL SELECT seed, node, 1 FROM sub UNION ALL SELECT seed, member, 1 FROM sub JOIN members ON owner = node),
s2 AS (SELECT seed, node, min(depth) AS depth FROM (FROM s1 UNION ALL SELECT seed, derived, 1 FROM s1 JOIN closed ON base = node) GROUP BY ALL),
walk(seed, node, depth) AS (SELECT seed, node, 0 FROM s2 UNION SELECT seed, src, depth + 1 FROM walk JOIN expanded ON dst = node WHERE depth < 2),
hit AS (SELECT seed, node, min(depth) AS depth FROM (SELECT * FROM s2 WHERE depth > 0 UNION ALL SELECT seed, node, min(depth) FROM walk GROUP BY ALL HAVING min(depth) > 0) GROUP BY ALL)
SELECT seed, node, name, file_path, depth, min(depth) OVER (PARTITION BY seed, file_path) AS file_level FROM hit JOIN n ON n.id = node WHERE node <> seed""")
def blast_radius(spark, d):
    """What changes of the three classes with the most members affect within two calls (G-18, A-07, W-07)."""
    e = cut(edges(spark, d, relations=[*CALLS, *INHERITS, "belongs_to", "overrides"]))
    cls = nodes(spark, d, "type").where("type IN ('class', 'struct')").select(F.col("id").alias("dst"))
    top = code.of(e, "belongs_to").join(cls, "dst", "left_semi").groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(3)
    seeds = cut(top.select(F.col("dst").alias("seed"), F.col("dst").alias("node")))
    return code.blast_radius(e, nodes(spark, d, "name", "file_path"), seeds, 2)


# --- includes ---------------------------------------------------------------------------------------


def _p(c: str) -> str:
    return rf"regexp_replace(regexp_replace(replace({c}, '\', '/'), '/+', '/', 'g'), '^\./', '')"


_INC = f"""inc AS (SELECT {_p('source_file')} AS source_file, {_p('included_file')} AS included_file, bool_or(coalesce(is_system, false)) AS is_system
  FROM include_dep WHERE source_file IS NOT NULL AND included_file IS NOT NULL GROUP BY 1, 2)"""


def _headers(spark: SparkSession, d: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Includes, and the k project headers that most files include."""
    inc = cut(code.clean_includes(table(spark, d, "include_dep")))
    top = inc.where("NOT is_system").groupBy("included_file").count().orderBy(F.desc("count"), "included_file").limit(k)
    return inc, cut(top.select(F.col("included_file").alias("file")))


_TOP = "top AS (SELECT included_file AS file FROM inc WHERE NOT is_system GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)"
_B = "split_part({}, '/', -1)"


@query(f"WITH {_INC} SELECT DISTINCT source_file FROM inc WHERE contains(lower(included_file), 'base_support')")
def includers_direct(spark, d):
    """Files that include a header with a name part (G-19, P-14)."""
    inc = code.clean_includes(table(spark, d, "include_dep"))
    return inc.where(F.col("included_file").ilike("%base_support%")).select("source_file").distinct()


_REACH = f"""arcs AS (SELECT {_B.format('included_file')} AS a, {_B.format('source_file')} AS b, source_file AS f FROM inc),
walk(file, node, depth) AS (SELECT file, {_B.format('file')}, 0 FROM top UNION SELECT file, b, depth + 1 FROM walk JOIN arcs ON a = node WHERE depth < 20),
near AS (SELECT file, node, min(depth) AS depth FROM walk GROUP BY ALL),
hit AS (SELECT file, f AS includer, min(depth) + 1 AS depth FROM near JOIN arcs ON a = node WHERE depth < 20 GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_INC}, {_TOP}, {_REACH} SELECT * FROM hit")
def includers_all(spark, d):
    """All files that include the five most included headers, directly or not (G-20, G-21, O-04)."""
    return code.includers(*_headers(spark, d))


@query(rf"""WITH RECURSIVE {_INC}, {_TOP}, {_REACH}
SELECT file, includer AS affected, depth, regexp_matches(includer, '\.(cpp|cc|cxx|c)$') AS is_source FROM hit""")
def include_impact(spark, d):
    """What to handle again when headers change (G-23, G-28)."""
    return code.include_impact(*_headers(spark, d))


@query(f"""WITH RECURSIVE {_INC}, src AS (SELECT source_file AS file FROM inc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5),
walk(file, node, depth) AS (SELECT file, file, 0 FROM src UNION SELECT file, included_file, depth + 1 FROM walk JOIN inc ON source_file = node WHERE NOT is_system AND depth < 3),
near AS (SELECT file, node, min(depth) AS depth FROM walk GROUP BY ALL)
SELECT c.file, min(p.node) AS parent, c.node AS child, c.depth FROM near c JOIN near p ON p.file = c.file AND p.depth = c.depth - 1
JOIN inc ON source_file = p.node AND included_file = c.node AND NOT is_system GROUP BY ALL""")
def include_tree(spark, d):
    """What the five files with the most includes include, to three levels (G-22)."""
    inc = cut(code.clean_includes(table(spark, d, "include_dep")))
    files = inc.groupBy("source_file").count().orderBy(F.desc("count"), "source_file").limit(5).select(F.col("source_file").alias("file"))
    return code.include_tree(inc, cut(files), 3)


@query(f"WITH {_INC} SELECT source_file, count(*) AS n_includes, count(*) FILTER (is_system) AS n_system FROM inc GROUP BY 1")
def include_counts(spark, d):
    return code.include_counts(code.clean_includes(table(spark, d, "include_dep")))


# --- aliases, using ---------------------------------------------------------------------------------


@query(f"WITH {NE} SELECT DISTINCT dst AS target_id, name AS target_name, src AS alias_id, alias_name FROM e JOIN n ON n.id = dst WHERE relation_type = 'type_alias'")
def aliases(spark, d):
    return code.aliases(edges(spark, d, "alias_name", relations=["type_alias"]), nodes(spark, d, "name"))


@query(f"""WITH RECURSIVE {E}, step AS (SELECT src AS a, min(dst) AS b FROM e WHERE relation_type = 'type_alias' GROUP BY 1),
walk(alias, terminal, depth, p) AS (SELECT a, b, 1, [a, b] FROM step
  UNION ALL SELECT alias, b, depth + 1, list_append(p, b) FROM walk JOIN step ON a = terminal WHERE depth < 5 AND NOT list_contains(p, b))
SELECT alias, arg_max(terminal, depth) AS terminal, max(depth) AS depth FROM walk GROUP BY 1""")
def alias_terminals(spark, d):
    return code.alias_terminals(edges(spark, d, relations=["type_alias"]))


@query(f"WITH {NE} SELECT DISTINCT src AS class_id, dst AS function_id, name AS function_name FROM e JOIN n ON n.id = dst WHERE relation_type = 'using_decl'")
def using_declarations(spark, d):
    return code.using_declarations(edges(spark, d, relations=["using_decl"]), nodes(spark, d, "name"))


# --- resolution -------------------------------------------------------------------------------------

_REFS = "coalesce(to_id, 0) <= 0 AND needs_resolution AND id IS NOT NULL"


def _unresolved(spark: SparkSession, d: str, hint: str | None, *columns) -> DataFrame:
    rows = table(spark, d, "edge").where("coalesce(to_id, 0) <= 0 AND needs_resolution AND id IS NOT NULL")
    return rows.where(F.col("resolve_hint").eqNullSafe(F.lit(hint))).select(F.col("id").alias("edge_id"), *columns).distinct()


@query(f"""WITH {N}, refs AS (
  SELECT DISTINCT id AS edge_id, callee_name AS name, nullif(callee_parent_class, '') AS parent, callee_param_types AS params, nullif(callee_namespace, '') AS ns
  FROM edge WHERE {_REFS} AND resolve_hint IS NULL),
fn AS (SELECT id, name, coalesce(namespace, '') AS space, split_part(coalesce(namespace, ''), '::', -1) AS tail, param_types, file_path, start_line FROM n WHERE type = 'function'),
hit AS (SELECT edge_id, id, file_path, start_line, CASE
    WHEN params IS NOT NULL AND param_types IS NOT NULL AND params = param_types AND (parent IS NULL OR tail = parent OR contains(space, parent)) THEN 1
    WHEN parent IS NOT NULL AND (tail = parent OR ns IS NOT NULL AND starts_with(space, ns || '::')) THEN 2 ELSE 3 END AS tier
  FROM refs JOIN fn USING (name))
SELECT edge_id, id AS target, tier FROM hit QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY tier, coalesce(file_path, ''), coalesce(start_line, 0), id) = 1""")
def resolve_calls(spark, d):
    """Targets of calls known by name, by tiers (J-07, W-01)."""
    refs = _unresolved(
        spark, d, None, F.col("callee_name").alias("name"), F.col("callee_parent_class").alias("parent"), F.col("callee_param_types").alias("params"), F.col("callee_namespace").alias("namespace")
    )
    return code.resolve_calls(refs, nodes(spark, d, "type", "name", "namespace", "file_path", "start_line", "param_types"))


@query(f"""WITH {NE}, refs AS (
  SELECT DISTINCT id AS edge_id, function_name AS name, derived_class, nullif(base_namespace, '') AS ns, from_id FROM edge WHERE {_REFS} AND resolve_hint = 'override'),
cls AS (SELECT id, name, coalesce(namespace, '') AS space FROM n WHERE type IN ('class', 'struct')),
base AS (SELECT refs.*, c.id AS child, p.id AS parent, p.name AS base_name, CASE WHEN starts_with(refs.name, '~') THEN '~' || p.name ELSE refs.name END AS want
  FROM refs JOIN cls c ON c.name = derived_class AND (ns IS NULL OR c.space = ns OR starts_with(c.space, ns || '::') OR ends_with(c.space, '::' || ns))
  JOIN e i ON i.relation_type IN {_INH} AND i.src = c.id JOIN cls p ON p.id = i.dst),
fn AS (SELECT id, name, coalesce(namespace, '') AS space, split_part(coalesce(namespace, ''), '::', -1) AS tail, is_virtual FROM n WHERE type = 'function'),
hit AS (SELECT edge_id, 1 AS tier, child, parent, fn.id FROM base JOIN fn ON fn.name = want AND tail = base_name AND (ns IS NULL OR starts_with(fn.space, ns || '::'))
  UNION ALL SELECT edge_id, 2, child, parent, fn.id FROM base JOIN fn ON fn.name = want AND tail = base_name AND is_virtual AND fn.id IS DISTINCT FROM from_id
  WHERE fn.id IN (SELECT src FROM e WHERE relation_type = 'belongs_to'))
SELECT edge_id, id AS target FROM hit QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY tier, child, parent, id) = 1""")
def resolve_overrides(spark, d):
    """Targets of overrides known by name, in direct bases (J-04, F-20)."""
    refs = _unresolved(spark, d, "override", F.col("function_name").alias("name"), "derived_class", "base_namespace", F.col("from_id").alias("src"))
    return code.resolve_overrides(refs, edges(spark, d, relations=[*INHERITS, "belongs_to"]), nodes(spark, d, "type", "name", "namespace", "is_virtual"))


@query(f"""WITH {N}, refs AS (SELECT DISTINCT id AS edge_id, target_simple_name AS name FROM edge WHERE {_REFS} AND resolve_hint = 'type_alias'),
cls AS (SELECT name, id FROM n WHERE type IN ('class', 'struct') QUALIFY row_number() OVER (PARTITION BY name ORDER BY type, id) = 1)
SELECT edge_id, id AS target FROM refs JOIN cls USING (name)""")
def resolve_aliases(spark, d):
    """Targets of aliases known by name (J-05)."""
    return code.resolve_types(_unresolved(spark, d, "type_alias", F.col("target_simple_name").alias("name")), nodes(spark, d, "type", "name"))


@query(f"""WITH {NE}, sites AS (SELECT DISTINCT file_path, call_line AS line FROM e JOIN n ON n.id = src WHERE relation_type IN {_CALLS} AND call_line > 0 AND file_path IS NOT NULL)
SELECT file_path, line, id AS function_id FROM sites JOIN n USING (file_path) WHERE type = 'function' AND line BETWEEN start_line AND end_line
QUALIFY row_number() OVER (PARTITION BY file_path, line ORDER BY end_line - start_line, id) = 1""")
def enclosing_functions(spark, d):
    """The innermost function around every call site (J-11)."""
    n = nodes(spark, d, "type", "file_path", "start_line", "end_line")
    e = edges(spark, d, relations=CALLS).where("line > 0")
    sites = e.join(n.select(F.col("id").alias("src"), "file_path"), "src").where("file_path IS NOT NULL").select("file_path", "line").distinct()
    return code.enclosing_function(n, sites)


# --- names -------------------------------------------------------------------------------------------


@query(rf"""WITH {N} SELECT name, type, id FROM n WHERE type IN ('class', 'struct', 'function') AND name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY name, type ORDER BY coalesce(regexp_matches(file_path, '\.(cpp|cc|cxx|c)$'), false) DESC, file_path NULLS LAST, start_line NULLS LAST, id) = 1""")
def definition_first(spark, d):
    """One node per name and type, definitions before declarations (W-08)."""
    n = nodes(spark, d, "type", "name", "file_path", "start_line").where("type IN ('class', 'struct', 'function') AND name IS NOT NULL")
    return questions.definition_first(n, ["name", "type"]).select("name", "type", "id")


@query(f"""WITH {N}, ns AS (SELECT DISTINCT split_part(namespace, '::', 1) AS name FROM n WHERE namespace <> ''),
dirs AS (SELECT DISTINCT split_part(file_path, '/', 2) AS f FROM n WHERE contains(file_path, '/')),
a AS (SELECT name, unnest(list_transform(range(1, length(replace(name, '_', '')) - 2), lambda i: lower(substr(replace(name, '_', ''), i, 4)))) AS g FROM ns),
b AS (SELECT DISTINCT unnest(list_transform(range(1, length(replace(f, '_', '')) - 2), lambda i: lower(substr(replace(f, '_', ''), i, 4)))) AS g FROM dirs)
SELECT DISTINCT name FROM a JOIN b USING (g)""")
def project_namespaces(spark, d):
    """Outer namespaces that share four letters in a row with a folder (P-21, J-13)."""
    n = nodes(spark, d, "namespace", "file_path")
    names = n.where("namespace <> ''").select(F.split("namespace", "::")[0].alias("name")).distinct()
    folders = n.where("file_path LIKE '%/%'").select(F.split("file_path", "/")[1].alias("folder")).distinct()
    return questions.shared_grams(names, folders)
