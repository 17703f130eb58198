"""Words of texts.

A word is taken from text in Unicode form NFKC, without U+200B, U+200C, U+200D, U+FEFF and U+00AD, in
lower case: one character of U+4E00 to U+9FFF, or a longest run of other letters and digits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_DROPPED = re.compile(r"[\u200B\u200C\u200D\uFEFF\u00AD]")
_WORD = re.compile(r"[\u4E00-\u9FFF]|[^\W_\u4E00-\u9FFF]+")
_ASCII = "".join(chr(i) if chr(i).isalnum() else " " for i in range(128))
#: Bytes of text whose words are held at once; a longer document is held whole.
BLOCK_BYTES = 4 << 20


def words(text: str | None) -> list[str]:
    """The words of one text; none of a null."""
    if not text:
        return []
    if text.isascii():
        return text.lower().translate(_ASCII).split()
    return _WORD.findall(_DROPPED.sub("", unicodedata.normalize("NFKC", text)).lower())


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], np.ndarray]]:
    """Runs of documents of batches ``(id, text)``: ids, the words of all of them, and where each begins.

    The third has one entry more than the first. Every document is whole and in one run, however
    long; null ids and texts stay, the latter without words.
    """
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        size = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // BLOCK_BYTES)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                found: list[str] = []
                begin = [0]
                for t in texts.slice(a, b - a).to_pylist():
                    found += words(t)
                    begin.append(len(found))
                yield ids.slice(a, b - a), found, np.asarray(begin)
