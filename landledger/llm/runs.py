"""Arrays of variable-length runs, and texts cut into distinct words with Arrow kernels.

A run is a stretch of a flat array.  Work is done once for each distinct word of a slice of texts, and the
results are put together for all its occurrences by one gather.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on together up to so many bytes (a longer text is a slice of its own).
SLICE_BYTES = 4 << 20


class Runs(NamedTuple):
    """``flat[ends[k - 1] : ends[k]]`` is run k."""

    flat: np.ndarray
    ends: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def take(self, at: np.ndarray) -> Runs:
        """The runs at ``at``, one behind the other."""
        n = self.lengths[at]
        ends = np.cumsum(n)
        index = np.repeat(self.ends[at] - ends, n)
        index += np.arange(len(index))
        return Runs(self.flat[index], ends)

    def joined(self, ends: np.ndarray) -> Runs:
        """Runs of runs: group k joins the runs from ``ends[k - 1]`` up to ``ends[k]``."""
        return Runs(self.flat, np.concatenate([[0], self.ends])[ends])

    def bytes(self) -> Iterator[bytes]:
        """Each run's numbers as bytes."""
        raw, size = self.flat.tobytes(), self.flat.itemsize
        start = 0
        for stop in (self.ends * size).tolist():
            yield raw[start:stop]
            start = stop


def chosen(mask: np.ndarray, yes: Runs, no: Runs) -> tuple[Runs, np.ndarray]:
    """Both behind each other, and for each place of ``mask`` the number of its run: the next of ``yes`` where it is true, else of ``no``."""
    at = np.where(mask, np.cumsum(mask) - 1, len(yes.ends) + np.cumsum(~mask) - 1)
    return Runs(np.concatenate([yes.flat, no.flat]), np.concatenate([yes.ends, no.ends + len(yes.flat)])), at


def runs_of(parts: list[bytes], kind: str) -> Runs:
    size = np.dtype(kind).itemsize
    return Runs(np.frombuffer(b"".join(parts), kind), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // size)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """``texts`` without nulls (they become empty), in slices of about ``most`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def list_ends(lists: pa.Array) -> np.ndarray:
    """Where each list ends in ``lists.flatten()``."""
    return np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def distinct(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each word its number, and the word of each number."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def cut(words: pa.Array, pattern: str) -> pa.Array:
    """Lists of the matches of ``pattern`` (one group around it) that follow each other in words without spaces; the last of a list is empty."""
    return pc.split_pattern(pc.replace_substring_regex(words, pattern=pattern, replacement=r"\1 "), " ")


def strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
