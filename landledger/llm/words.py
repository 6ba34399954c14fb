"""Words of a slice of texts, cut by Arrow kernels: all words in a row, and where each text's words end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .runs import list_ends

#: A-Z to a-z; digits, a-z and all bytes above 7F stay; every other byte is a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def translated(texts: pa.Array, table: bytes = PLAIN) -> pa.Array:
    """``texts`` (large strings without nulls) with each byte replaced; the table maps ASCII to ASCII and leaves other bytes."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = b"" if data is None or at[0] == at[-1] else data.slice(at[0], at[-1] - at[0]).to_pybytes().translate(table)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(raw))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between space, tab, line feed, vertical tab, form feed and carriage return."""
    lists = pc.ascii_split_whitespace(texts)
    words, ends = lists.flatten(), list_ends(lists)
    real = pc.not_equal(pc.binary_length(words), 0)  # blanks at a text's ends make empty words
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), before[ends]


def text_bytes(texts: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 of each text, without copies."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
    raw = memoryview(data) if data is not None else memoryview(b"")
    for k in range(len(texts)):
        yield raw[at[k] : at[k + 1]]
