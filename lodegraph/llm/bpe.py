"""Encoding texts with a public byte-level BPE tokenizer by a tokenization automaton.

The automaton reads tokens; it accepts exactly the token sequences that byte pair encoding yields.
It starts with one state in which every byte may follow every byte, and each merge is worked in by a
gadget: for a merge of ``a`` and ``b`` into ``c``, the state that ``a`` leads to is cloned, the clone
loses its arc ``b``, ``a`` leads to the clone from then on, and ``c`` gets an arc from each state that
has one labelled ``a``, to where ``b`` led. All arcs of one label lead to one state, so a state is
named by a label and the number of merges worked in, and a clone is stored as the one arc it lost.

A word is encoded by table-driven transitions, along the one path over it that the automaton
accepts. Decoding emits the labels of the arcs that ids take.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how the tokenizer splits text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words and pieces that a task remembers at once; when full, it begins anew.
MEMORY = 400_000

# Two spaces in a run of white space: such text is not cut at every space.
_BLANK = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_INNER = re.compile(f"{_BLANK} {_BLANK}")
_CUT = re.compile(f"(?<!{_BLANK}) | (?!{_BLANK}|$)")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for
    themselves, the others, in order, by the letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class MergeAutomaton:
    """The automaton of a list of merges ``(a, b, c)`` of labels over 256 byte labels."""

    def __init__(self, byte_label: list[int], merges: list[tuple[int, int, int]]):
        size = max([*byte_label, *(c for _, _, c in merges)]) + 1
        self.text: list[bytes | None] = [None] * size
        self.left, self.right, self.born = [-1] * size, [-1] * size, [0] * size
        #: (a, b): when the state that a leads to lost its arc b
        self.lost: dict[tuple[int, int], int] = {}
        self.label: dict[bytes, int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        for value, x in enumerate(byte_label):
            self.text[x] = bytes([value])
            self.label[self.text[x]] = x
        for time, (a, b, c) in enumerate(merges, 1):
            self._gadget(a, b, c, time)
        #: labels by their bytes: (node, byte) to node, and the label that ends at a node
        self.step: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for text, x in self.label.items():
            node = 0
            for byte in text:
                new = self.step.setdefault(node << 8 | byte, len(self.ends))
                if new == len(self.ends):
                    self.ends.append(-1)
                node = new
            self.ends[node] = x

    def _gadget(self, a: int, b: int, c: int, time: int) -> None:
        if self.text[a] is None or self.text[b] is None or not self._arc(a, b):
            return  # no path has b after a by now: the merge never applies
        self.lost[a, b] = time
        self.left[c], self.right[c], self.born[c] = a, b, time
        self.text[c] = self.text[a] + self.text[b]
        self.label[self.text[c]] = c

    def _arc(self, a: int, b: int) -> bool:
        """Whether the state that ``a`` leads to has an arc ``b``.

        Walks back through the gadgets: the younger of the two labels was made by one, which left
        its arcs as those of its left part into it, and of its right part out of it, were then.
        """
        until = 1 << 60
        while True:
            gone = self.lost.get((a, b))
            if gone is not None and gone < until:
                return False
            born_a, born_b = self.born[a], self.born[b]
            if not born_a and not born_b:
                return True
            if born_a > born_b:
                until, a = born_a, self.right[a]
            else:
                until, b = born_b + 1, self.left[b]  # with what this very gadget took

    def arc(self, a: int, b: int) -> bool:
        """The transition table, filled as it is used."""
        key = (a, b)
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 4 * MEMORY:
                self.known.clear()
            got = self.known[key] = self._arc(a, b)
        return got

    def encode(self, word: bytes) -> list[int]:
        """The one accepted path over ``word``.

        Takes the longest label from each place that its predecessor has an arc for. A prefix has one
        path at most, so a place without a way on is never entered twice.
        """
        whole = self.label.get(word)
        if whole is not None:
            return [whole]
        n, step, ends, known = len(word), self.step, self.ends, self.known
        dead: set[int] = set()
        ids: list[int] = []
        places: list[int] = []
        choices: list[list[tuple[int, int]]] = []
        at, last = 0, -1
        while at < n:
            if len(choices) == len(ids):  # a place that is entered: all labels from here
                node, k, found = 0, at, []
                while k < n:
                    node = step.get(node << 8 | word[k])
                    if node is None:
                        break
                    k += 1
                    x = ends[node]
                    if x >= 0:
                        found.append((x, k))
                choices.append(found)
                places.append(at)
            found = choices[-1]
            while found:
                x, k = found.pop()
                if k in dead:
                    continue
                if last >= 0:
                    ok = known.get((last, x))
                    if ok is None:
                        ok = self.arc(last, x)
                    if not ok:
                        continue
                ids.append(x)
                at, last = k, x
                break
            else:
                dead.add(at)
                choices.pop()
                places.pop()
                ids.pop()
                at, last = places[-1], ids[-1] if ids else -1
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """The labels of the arcs that ``ids`` take, whatever words they came from."""
        return b"".join(self.text[i] for i in ids)

    def accepts(self, ids: list[int]) -> bool:
        """Whether ``ids`` are the encoding of a word."""
        return all(self.text[i] is not None for i in ids) and all(self.arc(a, b) for a, b in zip(ids, ids[1:], strict=False))


@lru_cache(maxsize=2)
def load_automaton(path: str) -> MergeAutomaton:
    """The automaton of a tokenizer file with a vocabulary and merges (``tokenizers`` JSON, byte-level BPE)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    letters = _byte_letters()
    byte_label = [0] * 256
    for letter, value in letters.items():
        byte_label[value] = vocab[letter]
    merges = []
    for m in model["merges"]:
        a, b = m if isinstance(m, list) else m.split(" ")
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    return MergeAutomaton(byte_label, merges)


class Encoder:
    """Texts to ids; remembers words and the pieces between spaces."""

    def __init__(self, automaton: MergeAutomaton):
        import regex

        self.split = regex.compile(PATTERN).findall
        encode, split = automaton.encode, self.split

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) > MEMORY:
                    self.clear()
                got = self[word] = array("i", encode(word.encode("utf-8", "replace"))).tobytes()
                return got

        known = Words()

        class Pieces(dict):
            def __init__(self, before: str):
                self.before = before

            def __missing__(self, piece: str) -> bytes:
                if len(self) > MEMORY:
                    self.clear()
                got = b"".join([known[w] for w in split(self.before + piece)])
                if len(piece) < 100:
                    self[piece] = got
                return got

        self.first, self.rest = Pieces(""), Pieces(" ")

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as 32-bit integers; none of a null or empty text.

        A space that is not within a run of white space begins a word of the tokenizer, or is one, so
        text may be cut there without changing the result.
        """
        if not text:
            return b""
        pieces = _CUT.split(text) if _INNER.search(text) else text.split(" ")
        return self.first[pieces[0]] + b"".join(map(self.rest.__getitem__, pieces[1:]))


def encode_corpus(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)``: the token ids of each document, without special tokens, an empty list for null and empty texts.

    ``path`` is the tokenizer's file, to be found on every executor. Documents are encoded where they
    are read, whole and each on its own row; nothing is shuffled. Strings of special tokens in a text
    are ordinary text. Rows that repeat a doc_id, or have none, are encoded like others.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load_automaton(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                got = [encoder.encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, got)]) // 4
                ids = pa.array(np.frombuffer(b"".join(got), np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], names=["doc_id", "ids"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids array<int>")


def decode_corpus(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` from ``encoded(doc_id, ids)``; null ids give a null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load_automaton(path)
        for batch in batches:
            texts = [None if x is None else automaton.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")
