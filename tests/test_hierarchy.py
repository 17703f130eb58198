import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodegraph.operators import hierarchy
from tests.conftest import rows


def brute_forest(links):
    up = {}
    for c, p in links:
        if c is not None and p is not None:
            up[c] = min(p, up.get(c, p))
    out = []
    for x in {*up, *up.values()}:
        seen, y = [], x
        while y in up and y not in seen:
            seen.append(y)
            y = up[y]
        out.append((x, min(seen[seen.index(y) :]), -1) if y in seen else (x, y, len(seen)))
    return sorted(out, key=repr)


def brute_cycles(edges):
    g = {}
    for a, b in edges:
        if a is not None and b is not None:
            g.setdefault(a, set()).add(b)
    reach = {}
    for a in g:
        seen, todo = set(), list(g[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += g.get(x, ())
        reach[a] = seen
    return sorted((a, min(b for b in reach[a] if a in reach.get(b, ()))) for a in g if a in reach[a])


def chain(n, start=0):
    return [(start + i, start + i + 1) for i in range(n)]


CASES = [
    [],
    [(1, None), (None, 2)],
    [(1, 1)],
    [(1, 2), (1, 2), (2, 3)],
    [(1, 2), (2, 3), (3, 1), (4, 3), (5, 4)],
    chain(60) + [(1000 - i, 1000 - i - 1) for i in range(50)] + [(950, 990)],
    [(i, 7) for i in range(8, 300)],
]


@pytest.mark.parametrize("links", CASES, ids=range(len(CASES)))
@pytest.mark.parametrize(("solve", "part"), [(1_000_000, 50_000), (1_000_000, 9), (20, 7), (0, 3)])
def test_resolve_forest(spark, links, solve, part):
    df = spark.createDataFrame(links, "child long, parent long")
    assert rows(hierarchy.resolve_forest(df, solve, part)) == brute_forest(links)


def test_resolve_random_forest_with_cycles(spark):
    r = random.Random(3)
    links = [(i, r.randrange(400)) for i in range(400) if r.random() < 0.93]
    df = spark.createDataFrame(links, "child long, parent long")
    for solve, part in ((10_000, 100), (150, 60), (5, 40)):
        assert rows(hierarchy.resolve_forest(df, solve, part)) == brute_forest(links)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_contract_equals_brute_force(spark, links):
    df = spark.createDataFrame(links, "child long, parent long")
    assert rows(hierarchy.resolve_forest(df)) == brute_forest(links)


def test_full_hierarchy(spark):
    df = spark.createDataFrame([(2, 1), (3, 2), (4, 2), (5, 4), (6, 5), (7, 8), (8, 7), (9, 7)], "child long, parent long")
    assert rows(hierarchy.full_hierarchy(df)) == [
        (1, 1, 0, "1", 5), (2, 1, 1, "1/2", 4), (3, 1, 2, "1/2/3", 0), (4, 1, 2, "1/2/4", 2), (5, 1, 3, "1/2/4/5", 1), (6, 1, 4, "1/2/4/5/6", 0),
        (7, 7, -1, None, 0), (8, 7, -1, None, 0), (9, 7, -1, None, 0),
    ]


def brute_hierarchy(links):
    up = {}
    for c, p in links:
        up[c] = min(p, up.get(c, p))
    above = {}
    for x in {*up, *up.values()}:
        y, seen = x, []
        while y in up and up[y] not in seen and up[y] != x:
            y = up[y]
            seen.append(y)
        above[x] = seen
    depth = {x: (r, d) for x, r, d in brute_forest(links)}
    return sorted(
        ((x, *depth[x], "/".join(str(y) for y in [*reversed(above[x]), x]) if depth[x][1] >= 0 else None, sum(x in a for a in above.values())) for x in above), key=repr
    )


@pytest.mark.parametrize(("solve", "part"), [(1_000_000, 30), (0, 8)])
def test_paths_and_counts_from_fragments(spark, solve, part):
    r = random.Random(11)
    near = [(i, max(0, i - r.randrange(1, 4))) for i in range(1, 120)]
    far = [(i, r.randrange(150)) for i in range(150) if r.random() < 0.9]
    rings = [(i, (i + 1) % 40) for i in range(40)] + [(100 + i, i) for i in range(40)]
    for links in (near, far + [(c + 1000, p + 1000) for c, p in rings], []):
        df = spark.createDataFrame(links, "child long, parent long")
        assert rows(hierarchy.full_hierarchy(df, True, True, solve, part)) == brute_hierarchy(links)


def test_a_chain_of_a_million_needs_no_pairs(spark):
    df = spark.range(1_000_000).selectExpr("id AS child", "id + 1 AS parent")
    out = hierarchy.full_hierarchy(df, paths=False)
    assert out.columns == ["node", "root", "depth", "n_descendants"]
    got = out.selectExpr("count(*)", "min(root)", "sum(depth)", "sum(n_descendants)", "max(abs(node - n_descendants))").first()
    assert tuple(got) == (1_000_001, 1_000_000, 500_000_500_000, 500_000_500_000, 0)


def test_descendants_on_and_below_cycles(spark):
    # 7, 8 and 11 go round; 9 hangs below, and 10 below it
    links = [(2, 1), (3, 2), (7, 8), (8, 11), (11, 7), (9, 7), (10, 9), (12, 12), (13, 12)]
    df = spark.createDataFrame(links, "child long, parent long")
    assert rows(hierarchy.full_hierarchy(df, cycles=True)) == sorted([
        (1, 1, 0, "1", 2), (2, 1, 1, "1/2", 1), (3, 1, 2, "1/2/3", 0), (7, 7, -1, None, 4), (8, 7, -1, None, 4), (11, 7, -1, None, 4),
        (9, 7, -1, None, 1), (10, 7, -1, None, 0), (12, 12, -1, None, 1), (13, 12, -1, None, 0),
    ], key=repr)
    assert rows(hierarchy.every_pair(df).where("node IN (10, 8, 13)")) == sorted(
        [(10, 9, 1), (10, 7, 2), (10, 8, 3), (10, 11, 4), (8, 11, 1), (8, 7, 2), (13, 12, 1)], key=repr
    )


def brute_includes(links):
    up = {}
    for c, p in links:
        up.setdefault(c, set()).add(p)
    nodes = {x for link in links for x in link}
    dist = {}
    for x in nodes:
        front, seen = {x}, {x: 0}
        while front:
            front = {p for y in front for p in up.get(y, ()) if p not in seen}
            seen.update(dict.fromkeys(front, max(seen.values()) + 1))
        dist[x] = seen
    cyclic = {x for x in nodes if any(x in dist[p] for p in up.get(x, ()))}

    def paths(x, n):
        return [[x]] if n == 0 and x not in up else [[*q, x] for p in up.get(x, ()) for q in paths(p, n - 1)] if n > 0 else []

    out = []
    for x in nodes:
        depths = [k for y, k in dist[x].items() if y not in up]
        n = sum(x in dist[y] for y in nodes) - 1
        path = min(paths(x, min(depths))) if depths else None
        out.append((x, path[0] if path else min(cyclic & set(dist[x])), len(path) - 1 if path else -1, path, n))
    return sorted(out, key=repr), sorted(((p, x, k) for x in nodes for p, k in dist[x].items() if p != x), key=repr)


@pytest.mark.parametrize("solve", [1_000_000, 0])
def test_include_hierarchy(spark, solve):
    r = random.Random(5)
    fixed = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x"), ("w", "x"), ("y", "d"), ("p", "q"), ("q", "p"), ("o", "q"), ("s", "s"), ("t", "s")]
    for links in (fixed, sorted({(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(50)})):
        df = spark.createDataFrame(links, "child string, parent string")
        every, pairs = brute_includes(links)
        assert rows(hierarchy.include_paths(df, solve, 3)) == every
        assert rows(hierarchy.include_descendants(df, solve, 3)) == pairs


@pytest.mark.parametrize(("solve", "part"), [(1_000_000, 50_000), (1_000_000, 4), (0, 4)])
def test_cyclic_groups(spark, solve, part):
    cases = [
        [],
        [("a", "b"), ("b", "c"), (None, "a"), ("c", None)],
        [("a", "a"), ("a", "b")],
        [("b", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "c"), ("x", "b"), ("d", "y"), ("b", "a")],
    ]
    r = random.Random(1)
    cases.append([(f"n{r.randrange(25)}", f"n{r.randrange(25)}") for _ in range(34)])
    # rings within folders, tied to each other by one more
    ring = lambda k: [(f"f{k}/{i}", f"f{k}/{(i + 1) % 4}") for i in range(4)]
    cases.append([e for k in range(6) for e in ring(k)] + [(f"f{k}/0", f"f{(k + 1) % 4}/1") for k in range(4)] + [("f5/1", "f0/1")])
    for edges in cases:
        df = spark.createDataFrame(edges, "a string, b string")
        assert rows(hierarchy.cyclic_groups(df, solve, part)) == brute_cycles(edges)


def test_clean_path(spark):
    df = spark.createDataFrame([(p,) for p in ("./src\\\\a//b.h", "src/a.h", "\\x", None, ".//y")], "p string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(hierarchy.clean_path(F.col("p"))).collect()] == ["src/a/b.h", "src/a.h", "/x", None, "y"]
