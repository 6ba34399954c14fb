r"""Periodic runs of words: maximal stretches that repeat with a period, and texts collapsed to one period of each.

1. A suffix array of the words and its common prefixes (``suffix_arrays``) give for each word the longest previous
   factor: the longest stretch from there that also starts earlier in the text.
2. Following these factors cuts the text into Lempel-Ziv blocks.
3. A run that touches a block boundary is found by extending both ways from it, for each period that a run which ends in the
   boundary's block can have: up to the block's length for a period to the right, up to this and the block before for one to
   the left (Main; further left the earlier block would have been longer).  These are at most three trials a word.
4. A run strictly inside a block is a copy of one in the block's earlier occurrence: runs lie in buckets by their start, and
   each block's buckets are shifted over, from left to right.

A text without a stretch of at least ``least`` / 2 words that occurs twice can't hold a run and leaves after the array's third level.

Words are `[^\x20\x09-\x0D]+`.  A run has a smallest period q and at least max(``least``, 2 q) words.  Odd inputs: a null text has no words, no
runs and the collapsed text ''; so has a text of blanks.  Empty tables give empty tables, repeated rows and ids are all returned, null ids
too, other columns are ignored.  Ties of the longest run: smallest start, then period.  Memory: a slice of texts of 4 MB, or one longer
text, with 4 bytes a word for each doubling of its longest repeat.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import distinct, slices
from .suffix_arrays import closed, previous_factors, suffix_array
from .words import split_words

LEAST = 12
RUNS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _blocks(factor: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, and the end."""
    step, at, out = np.maximum(factor, 1).tolist(), 0, []
    while at < len(step):
        out.append(at)
        at += step[at]
    return np.array([*out, len(step)])


def _trials(most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k the periods 1 to most[k]: the k of each, and the period."""
    k = np.repeat(np.arange(len(most)), most)
    return k, np.arange(1, len(k) + 1) - np.repeat(np.cumsum(most) - most, most)


def runs_of_words(codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end exclusive, smallest period) of all runs of a row of texts with closing numbers, in no order."""
    sa = suffix_array(codes)
    factor, source = previous_factors(sa)
    cuts = _blocks(factor)
    size = np.append(np.diff(cuts), 0)  # of the block that starts at the cut
    before = np.insert(size[:-1], 0, 0)
    found = []
    # A whole period to the right of the cut, then to its left.
    k, q = _trials(size)
    s = cuts[k]
    s, q = s[s + q < len(codes)], q[s + q < len(codes)]
    ahead, back = sa.common_prefix(s, s + q), sa.common_suffix(s, s + q)
    ok = ahead + back >= np.maximum(q, least - q)
    found.append(np.stack([(s - back)[ok], (s + q + ahead)[ok], q[ok]], 1))
    k, q = _trials(np.minimum(before + size, cuts))
    s = cuts[k]
    ahead, back, inside = np.zeros(len(s), np.int64), sa.common_suffix(s, s - q), s < len(codes)
    ahead[inside] = sa.common_prefix(s[inside], (s - q)[inside])
    ok = ahead + back >= np.maximum(q, least - q)
    found.append(np.stack([(s - q - back)[ok], (s + ahead)[ok], q[ok]], 1))
    all_found = np.concatenate(found)
    # One stretch has one smallest period; multiples of it are found as well.
    all_found = all_found[np.lexsort(all_found.T[::-1])]
    new = np.append(True, (all_found[1:, :2] != all_found[:-1, :2]).any(1))[: len(all_found)]
    buckets: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
    for start, end, period in all_found[new].tolist():
        buckets[start].append((end, period))
    if buckets:
        for k in np.flatnonzero(size >= least + 2):
            s, n = int(cuts[k]), int(size[k])
            origin = int(source[s])
            for at in range(origin + 1, origin + n - least):
                for end, period in buckets.get(at, ()):
                    if end < origin + n:
                        buckets[at + s - origin].append((end + s - origin, period))
    return [(start, end, period) for start, some in buckets.items() for end, period in some]


def runs_of_texts(number: np.ndarray, ends: np.ndarray, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For each text, whose word numbers end at ``ends``, its runs as (start, length, period), sorted by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(ends))]
    if not len(number):
        return out
    lengths = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(len(ends)), lengths)
    # A number of its own for each text's word, so that only repeats inside a text are looked at.
    own = owner * (int(number.max()) + 1) + number
    codes, starts = closed(own, ends, int(own.max()) + 1)
    some = np.searchsorted(starts, suffix_array(codes, max(least // 4, 1)).open, "right") - 1
    texts = np.unique(some)
    if not len(texts):
        return out
    inside = np.isin(owner, texts)
    codes, starts = closed(own[inside], np.cumsum(lengths[texts]), int(own.max()) + 1)
    for start, end, period in runs_of_words(codes, least):
        k = int(np.searchsorted(starts, start, "right")) - 1
        out[texts[k]].append((start - int(starts[k]), end - start, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(ends: np.ndarray, runs: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """For each word whether no run contains it behind its first period."""
    total = int(ends[-1]) if len(ends) else 0
    change = np.zeros(total + 1, np.int64)
    for k, some in enumerate(runs):
        base = int(ends[k - 1]) if k else 0
        for start, length, period in some:
            change[base + start + period] += 1
            change[base + start + length] -= 1
    return np.cumsum(change[:total]) == 0


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, text: Column | None = None) -> DataFrame:
    """Columns: the id, n_words, runs (start, length, period; by start, then period), collapsed (the words that stay, joined by a space).

    ``text`` is a column expression over ``docs`` that stands in for the text column.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (F.col(f"`{text_col}`") if text is None else text).alias("text"))

    def per_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for some in slices(b.column(1)):
                words, ends = split_words(some)
                runs = runs_of_texts(distinct(words)[0], ends, least)
                keep = kept_words(ends, runs)
                left = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
                lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(keep)))
                arrays = [b.column(0).slice(at, len(some)), pa.array(np.diff(ends, prepend=0), pa.int64())]
                arrays.append(pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], RUNS_TYPE))
                arrays.append(pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_words", "runs", "collapsed"])
                at += len(some)

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(per_batch, f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def run_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of ``find_runs``: the id, n_runs, the longest run's start, length, period and exponent_milli, and digests of runs and collapsed text."""
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select(id_col, "runs", F.array_min(ranked).alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    best = F.col("best")
    return rows.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), (-best["n"]).alias("length"), best["period"].alias("period"),
        F.floor(-1000 * best["n"] / best["period"]).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def with_planted_period(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text; of every tenth id's checksum the words from a place on repeat with a period that the checksum chooses."""
    h, text = F.crc32(F.col(f"`{id_col}`").cast("string")), F.col(f"`{text_col}`")
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    g = F.floor(h / 10)

    def planted(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))

    # A one-entry array binds the words, so that they are split once.
    again = F.get(F.transform(F.array(words), lambda w: F.array_join(planted(w), " ")), F.lit(0))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), again).otherwise(text)
