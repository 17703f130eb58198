import os

import pytest

pytest.importorskip("lodegraph.llm")

from lodegraph.llm import markup, queries  # noqa: E402
from tests.conftest import rows  # noqa: E402
from tests.llm.test_words_leaks_repetition import brute_leaks, brute_share, brute_words  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (os.path.isdir(DATA) and os.path.isdir(queries.TOKENIZERS)), reason="no test tables or tokenizers")


def run(spark, name):
    return queries.QUERIES[name](spark, DATA)


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def leaks(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/heldout_item.parquet").collect()]
    return items, brute_leaks(documents, items)


def longest(text, item):
    """The longest run of words that both have, by brute force over its ends."""
    a, b = brute_words(text), brute_words(item)
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for k, y in enumerate(b):
            if x == y:
                now[k + 1] = last[k] + 1
                best = max(best, now[k + 1])
        last = now
    return best


def test_leaks(spark, documents, leaks):
    items, want = leaks
    assert rows(run(spark, "p8_found"), "doc_id", "item_id") == want
    texts, wanted = dict(documents), dict(items)
    report = {i: (0, 0) for i in wanted}
    for d, i in want:
        n, most = report[i]
        report[i] = (n + 1, max(most, longest(texts[d], wanted[i])))
    assert {r.item_id: (r.n_documents, r.longest_match) for r in run(spark, "p8_report").collect()} == report
    assert rows(run(spark, "p8_clean")) == sorted(((d,) for d in texts if d not in {x for x, _ in want}), key=repr)


def test_repetition(spark, documents):
    want = {d: brute_share(t) for d, t in documents}
    got = {r[0]: (r[1], r[2], r[3]) for r in run(spark, "p9_shares").collect()}
    assert got == {d: x for d, x in want.items() if x[0] >= 30}
    assert rows(run(spark, "p9_found")) == sorted(((d,) for d, (n, w, k) in want.items() if n >= 30 and k >= 0.3 * w), key=repr)
    divergence = run(spark, "p9_divergence").collect()
    assert {r.doc_id for r in divergence} == set(got) and all(0 <= r.class_distance <= 1 and 0 <= r.word_distance <= 1 for r in divergence)


def test_clean_sections(spark):
    duckdb = pytest.importorskip("duckdb")
    current = duckdb.sql(f"""SELECT id, heading, content_preview FROM (FROM '{DATA}/node.parquet' WHERE id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, type DESC, heading DESC, content_preview DESC) = 1) WHERE type = 'doc_section'""").fetchall()
    want = {(i, f): markup.clean(t, f == "heading") for i, *texts in current for f, t in zip(("heading", "content_preview"), texts, strict=True) if t is not None}
    got = {(r.node_id, r.field): r for r in run(spark, "p5_clean").collect()}
    assert {k: (r.clean_text, r.n_constructs, r.n_kept) for k, r in got.items()} == {k: (c.text, len(c.kinds), c.n_kept) for k, c in want.items()}
    assert rows(run(spark, "p5_found"), "node_id", "field") == sorted((k for k, c in want.items() if c.kinds), key=repr)
    # no word of any field is lost, but for what is markup itself
    assert all(r.clean_text or not c.text for (k, r), c in zip(sorted(got.items()), (want[k] for k in sorted(want)), strict=True))


def test_ids(spark, documents):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    got = {r.doc_id: list(r.ids) for r in run(spark, "p7_ids").collect()}
    assert got == {d: public.encode(t, add_special_tokens=False).ids if t else [] for d, t in documents}
