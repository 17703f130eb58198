import base64
import json
import os
import random

import pytest

pytest.importorskip("lodegraph.llm")

from lodegraph.llm import bpe  # noqa: E402
from tests.conftest import rows  # noqa: E402

PATH = "/opt/tokenizers/byte_bpe_50k.json"
needs_file = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")


def naive(merges, word):
    parts = list(word)
    for a, b, c in merges:
        k = 0
        while k + 1 < len(parts):
            if parts[k] == a and parts[k + 1] == b:
                parts[k : k + 2] = [c]
            k += 1
    return parts


def test_automaton_equals_merging_in_order():
    r = random.Random(4)
    for _ in range(60):
        labels, merges = list(range(256)), []
        usable = [ord(c) for c in "abc"]
        for c in range(256, 256 + r.randrange(1, 25)):
            merges.append((r.choice(usable), r.choice(usable), c))
            if len({(a, b) for a, b, _ in merges}) < len(merges):
                merges.pop()
                break
            usable.append(c)
        if not merges:
            continue
        auto = bpe.MergeAutomaton(labels, merges)
        for _ in range(150):
            word = bytes(r.choice(b"abc") for _ in range(r.randrange(1, 14)))
            ids = auto.encode(word)
            assert ids == naive(merges, word)
            assert auto.decode(ids) == word and auto.accepts(ids)
            other = [r.choice(usable) for _ in range(r.randrange(1, 5))]
            if all(auto.text[x] is not None for x in other):
                assert auto.accepts(other) == (naive(merges, auto.decode(other)) == other)


@needs_file
def test_equals_a_public_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    with open(PATH.replace(".json", ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(bpe.load_automaton(PATH))
    r = random.Random(8)
    letters = "aabbcc  \n\t'sré中　\x1c\x85\u2028 123½²<|endoftext|>´\u200d\u0301\U0001f4a1\xad\u180e\ufeff—-=_"
    texts = ["", " ", "  ", "a  b", "<|endoftext|>", "'s 's's", "x" * 3000, " " * 500 + "a", "锁" * 400, "\r\n\r\n x"]
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(4000)]
    for t in texts:
        got = encoder.encode(t)
        assert [int.from_bytes(got[k : k + 4], "little") for k in range(0, len(got), 4)] == plain.encode_ordinary(t), repr(t)


@needs_file
def test_corpus_round_trip(spark):
    texts = [(1, None), (2, ""), (3, "  two  spaces \n"), (4, "Größe 中文 \U0001f4a1"), (4, "again"), (None, "no id"), (5, "word " * 50_000)]
    d = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, ids int")
    out = bpe.encode_corpus(d, PATH)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert out.where("ids IS NULL").count() == 0 and out.where("size(ids) = 0").count() == 2
    assert rows(bpe.decode_corpus(out, PATH)) == sorted(((i, t or "") for i, t in texts), key=repr)
    assert bpe.encode_corpus(d.limit(0), PATH).count() == 0


@needs_file
def test_every_reachable_label_encodes_to_itself():
    auto = bpe.load_automaton(PATH)
    with open(PATH, encoding="utf-8") as f:
        assert len(auto.label) == len(json.load(f)["model"]["vocab"])
    assert all(auto.encode(t) == [x] for t, x in list(auto.label.items())[::97])
