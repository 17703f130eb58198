import random
import re
import unicodedata

import pytest

pytest.importorskip("lodegraph.llm")

from lodegraph.llm import leakage, repetition  # noqa: E402
from lodegraph.llm.words import words  # noqa: E402
from tests.conftest import rows  # noqa: E402

DOC = "doc_id long, text string, lang string, share double, item_id long"


def brute_words(t):
    t = unicodedata.normalize("NFKC", t or "")
    for c in (0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD):
        t = t.replace(chr(c), "")
    out, run = [], ""
    for c in t.lower() + " ":
        if c.isalnum() and not "\u4e00" <= c <= "\u9fff":
            run += c
            continue
        if run:
            out.append(run)
        run = ""
        if "\u4e00" <= c <= "\u9fff":
            out.append(c)
    return out


@pytest.mark.parametrize(
    "text",
    [None, "", "  \n", "Snake_case x2 3.5", "锁从A移到了B，x", "ｆｕｌｌ　ｗｉｄｔｈ", "zero\u200bwidth soft\u00adhyphen", "Ärger ßtraße İ", "½ ²x ①", "e\u0301 cafe\u0301", "\U0001f4a1a\ufeffb", "\x00\x1c"],
)
def test_words(text):
    assert words(text) == brute_words(text)


def brute_leaks(docs, items):
    out = set()
    for i, t in items:
        w = brute_words(t)
        m = min(13, len(w))
        need = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set()
        for d, x in docs:
            v = brute_words(x)
            if i is not None and any(tuple(v[k : k + m]) in need for k in range(len(v) - m + 1)):
                out.add((d, i))
    return sorted(out, key=repr)


def leak_case():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + list("锁从到移")
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice((0, 1, 5, 12, 13, 14, 30))))) for i in range(30)]
    docs = []
    for d in range(120):
        text = [r.choice([*vocab, "other"]) for _ in range(r.choice((0, 3, 20, 80)))]
        if r.random() < 0.5:
            src = r.choice(items)[1].split()
            a = r.randrange(len(src) + 1)
            text[len(text) // 2 : len(text) // 2] = src[a : a + r.choice((5, 12, 13, 20))]
        docs.append((d, " ".join(text).upper()))
    items += [(100, None), (101, ""), (102, "___"), (None, "w1 w2"), (3, items[4][1])]
    docs += [(200, None), (201, ""), (202, " "), (5, docs[6][1]), (None, items[10][1])]
    return docs, items


@pytest.mark.parametrize("size", [1_000_000, 250])
def test_leaks_equal_brute_force(spark, size):
    docs, items = leak_case()
    d = spark.createDataFrame([(i, t, "en", None, None) for i, t in docs], DOC)
    h = spark.createDataFrame([(i, "qa", t) for i, t in items], "item_id long, task string, text string")
    got = leakage.leaked_items(d, h, shard_words=size, block_words=size)
    assert rows(got, "doc_id", "item_id") == brute_leaks(docs, items)
    assert leakage.leaked_items(d.limit(0), h).count() == 0 == leakage.leaked_items(d, h.limit(0)).count()
    report = leakage.leak_report(got, h)
    assert report.count() == len({i for i, _ in items if i is not None})
    assert leakage.clean_documents(d, got).count() == sum(1 for i, _ in docs if i is None or i not in {x for x, _ in brute_leaks(docs, items)})


def test_longest_match_and_its_place(spark):
    item = " ".join(f"i{k}" for k in range(40))
    text = "a b " + " ".join(f"i{k}" for k in range(3, 18)) + " x " + " ".join(f"I{k}" for k in range(10, 40)) + " y"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    h = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert rows(leakage.leaked_items(d, h)) == [(1, 9, 30, 18)]


def test_suffix_array_is_in_order_of_whole_suffixes():
    r = random.Random(4)
    for _ in range(60):
        runs = [[r.choice("ab") for _ in range(r.randrange(1, 40))] for _ in range(r.randrange(1, 6))]
        shard = leakage.Shard(runs)
        codes = shard.codes.tolist()
        want = sorted((k for k, c in enumerate(codes) if c >= len(runs)), key=lambda k: codes[k:])
        assert shard.suffixes.tolist() == want
    assert leakage.Shard([["a"] * 5_000]).suffixes.tolist() == list(range(4_999, -1, -1))


def test_many_items_stay_out_of_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    r = random.Random(8)
    items = [(i, "qa", " ".join(f"w{r.randrange(5_000)}" for _ in range(20))) for i in range(10_000)]
    docs = [(k, "x " + items[7 * k][2] + " y", None, None, None) for k in range(300)]
    d, h = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, task string, text string")
    gathered = []
    plain = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: gathered.append(self.columns) or plain(self))
    got = leakage.leaked_items(d, h, block_words=50_000)
    # a row for each of four lengths, the bitmap, a sum
    assert [len(c) for c in gathered] == [3, 2, 1] and gathered[1] == ["slice", "held"]
    assert rows(got) == sorted(((k, 7 * k, 20, 1) for k in range(300)), key=repr)


def test_one_passage_in_a_third_of_all_documents(spark):
    passage = " ".join(f"p{k}" for k in range(15))
    docs = [(k, f"d{k} {passage} e{k}" if k % 3 == 0 else f"other text {k}", None, None, None) for k in range(3_000)]
    items = [(k, "qa", f"{passage} i{k}") for k in range(20)]
    d, h = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, task string, text string")
    assert leakage.leaked_items(d, h, shard_words=2_000).where("n_words = 15 AND at_word = 1").count() == 20_000


def brute_share(text, window=6):
    w = brute_words(text)
    win = [tuple(w[k : k + window]) for k in range(len(w) - window + 1)]
    return len(w), len(win), len(win) - len(set(win))


def test_shares_equal_brute_force(spark):
    r = random.Random(2)
    texts = [None, "", "   ", "a " * 29, "a " * 30, "锁" * 500, " ".join(f"w{i}" for i in range(100))]
    for _ in range(120):
        base = [r.choice("abcdefgh") + str(r.randrange(30)) for _ in range(r.randrange(8, 60))]
        texts.append(" ".join((base * r.choice((1, 1, 2, 3)))[: r.randrange(20, 150)]))
    texts.append("repeat this phrase over and over again now " * 20_000)
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOC)
    want = {i: brute_share(t) for i, t in enumerate(texts)}
    got = {r[0]: (r[1], r[2], r[3]) for r in repetition.repeated_share(d).collect()}
    assert got == {i: x for i, x in want.items() if x[0] >= 30}
    found = [r[0] for r in rows(repetition.repeating_documents(d), "doc_id")]
    assert sorted(found) == [i for i, (n, w, k) in want.items() if n >= 30 and k >= 0.3 * w]
    assert repetition.repeated_share(d.limit(0)).count() == 0


def test_divergence(spark):
    text = " ".join(f"word{i % 50} the of and" for i in range(40))
    data = [(i, text, "en", None, None) for i in range(20)] + [(50, text + " " + text, "en", None, None), (51, "9 8 7 " * 40, "en", None, None), (52, None, None, None, None), (53, "short", None, None, None), (54, text, None, None, None)]
    got = {r.doc_id: r for r in repetition.divergence(spark.createDataFrame(data, DOC)).collect()}
    assert set(got) == {*range(20), 50, 51, 54}
    # twice the text: the same histograms, so the same distance
    assert abs(got[50].word_distance - got[0].word_distance) < 1e-9
    assert got[51].word_distance > 0.5 > got[0].word_distance
    assert got[54].lang == "" and got[54].class_distance < 0.01
    assert repetition.divergence(spark.createDataFrame([], DOC)).count() == 0
    blocks = repetition.divergence(spark.createDataFrame(data, DOC), languages=1)
    assert sorted(map(tuple, blocks.collect()), key=repr) == sorted(map(tuple, got.values()), key=repr)


def test_words_pattern_is_stated_once():
    assert re.fullmatch(r"\w+", "".join(words("A b")))
