"""Near-duplicate documents by MinHash with tensored banding; every link confirmed on full shingle sets.

A document is its set of distinct shingles of ``WORDS`` words (64-bit hashes).  Two collections of ``HALVES`` half keys, each of
``ROWS`` minima, give HALVES x HALVES tables: the key of table (i, j) joins half i of the first collection with half j of
the second, so 144 tables of four minima take 48 minima instead of 576.  A pair with similarity s shares a key with
probability (1 - (1 - s^ROWS)^HALVES)^2, for s = 0.8 at least 0.99999.

1. Equal sets become one class (a grouped minimum; thousands of copies are one row from here on).
2. Classes that share a key are held against the smallest class of that key only, and links are confirmed on the full sets.
3. Components of the confirmed links.  What shares a key and is in one component by now needs no further look; that is how large
   groups stay linear.
4. Of the other keys, the pairs across components that pass two exact bounds (set sizes; a 1024-bit parity sketch, whose
   differing bits are at most the sets' difference) are confirmed on the full sets too, and the components are merged.

So every two classes that share a key are compared, or proven below the threshold, or already connected.

Odd inputs: a null or word-less text has an empty set and is linked with nothing; fewer words than a shingle make one shingle of
all of them.  Rows with a null id have no component and are kept.  Repeated ids are judged row by row.  Other columns are
ignored (in the filter kept).  An empty table gives an empty table.  Very long texts are shingled whole; a task holds one text's set at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .components import connected_components
from .shared import materialise

HALVES, ROWS = 12, 2
SKETCH = 1024
#: Bits of the bitmap that tells tasks which documents' sets are needed (4 MB).
MARK_BITS = 1 << 25
#: Texts are hashed together up to so many bytes.
CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64)
_ADD, _MUL = np.random.default_rng(2).integers(1, 1 << 63, (2, 2 * HALVES * ROWS), np.uint64)
_MUL = _MUL | np.uint64(1)
_LOW = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BREAK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Vectorised shingle hashing of many texts at once."""

    def __init__(self, words: int):
        self.words = words
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            size = 1 << int(n - 1).bit_length()
            back = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]))
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, back)]))

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, sorted and distinct within each text, and the number of each text's."""
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        starts_of = np.cumsum([0] + [len(t) + 1 for t in texts])
        self._powers(len(raw))
        # Word by word: a polynomial hash from running sums, then mixed with the length.
        inside = np.concatenate([[False], ~_BREAK[raw], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edge[::2], edge[1::2]
        run = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[_LOW[raw]] * self.power[: len(raw)])])
        word = _mix((run[stop] - run[start]) * self.inverse[start] + (stop - start).astype(np.uint64) * _ODD)
        doc = np.searchsorted(starts_of, start, "right") - 1
        count = np.bincount(doc, minlength=len(texts))
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        k = self.words
        hashes, owner = [], []
        if len(word) >= k:
            h = word[: len(word) - k + 1].copy()
            for i in range(1, k):
                h = _mix(h) + word[i : len(word) - k + 1 + i]
            ok = doc[: len(h)] == doc[k - 1 :]
            hashes.append(_mix(h[ok]))
            owner.append(doc[: len(h)][ok])
        for n in range(1, k):  # texts of fewer words than a shingle
            at = np.flatnonzero(count == n)
            if len(at):
                h = word[first[at]].copy()
                for i in range(1, n):
                    h = _mix(h) + word[first[at] + i]
                hashes.append(_mix(h ^ np.uint64(n) * _ODD))
                owner.append(at)
        h, d = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (owner, np.int64)))
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        return h[new], np.bincount(d[new], minlength=len(texts))


def _chunks(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for t in column.cast(pa.large_binary()):
        yield t.as_py() or b""


def signatures(h: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: fingerprint of the set (two numbers), half keys of both collections, parity sketch.  Empty sets get zeros."""
    m = len(n)
    some = np.flatnonzero(n)
    at = (np.cumsum(n) - n)[some]
    out = {"f": np.zeros((m, 2), np.uint64), "halves": np.zeros((m, 2 * HALVES), np.uint64), "sketch": np.zeros((m, SKETCH // 64), np.uint64)}
    if not len(some):
        return out
    out["f"][some, 0] = np.add.reduceat(_mix(h + np.uint64(1)), at)
    out["f"][some, 1] = np.bitwise_xor.reduceat(_mix(h * _ODD), at)
    least = np.empty((len(some), len(_MUL)), np.uint64)
    for k in range(len(_MUL)):
        x = (h + _ADD[k]) * _MUL[k]
        least[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(29)), at)
    joined = least.reshape(len(some), 2 * HALVES, ROWS)
    key = joined[:, :, 0]
    for r in range(1, ROWS):
        key = _mix(key) + joined[:, :, r]
    out["halves"][some] = _mix(key)
    owner = np.repeat(np.arange(m), n)
    odd = (np.bincount(owner * SKETCH + (h >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=m * SKETCH) & 1).astype(np.uint8)
    out["sketch"] = np.packbits(odd.reshape(m, SKETCH), axis=1).view(np.uint64)
    return out


def _longs(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64()))


def _signed(docs: DataFrame, words: int) -> DataFrame:
    def per_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(words)
        for b in batches:
            done = 0
            for texts in _chunks(_bytes(b.column(1))):
                h, n = s.sets(texts)
                g = signatures(h, n)
                f = g["f"].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(done, len(texts)), pa.array(n, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]), _longs(g["halves"]), _longs(g["sketch"])], names=["id", "n", "f1", "f2", "halves", "sketch"]
                )
                done += len(texts)

    return docs.select("id", "text").mapInArrow(per_batch, "id bigint, n bigint, f1 bigint, f2 bigint, halves array<bigint>, sketch array<bigint>")


def _marks(wanted: DataFrame) -> np.ndarray | None:
    """A bitmap of the hashes of the wanted ids, of MARK_BITS bits at most; null if there are too many ids for it to tell much."""
    at = F.pmod(F.xxhash64("id"), F.lit(MARK_BITS))
    parts = wanted.select(at.alias("at")).groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits"), F.count(F.lit(1)).alias("n"))
    rows = parts.collect()  # no more than MARK_BITS in all
    if sum(r["n"] for r in rows) > MARK_BITS // 4:
        return None
    out = np.zeros(MARK_BITS // 8, np.uint8)
    for r in rows:
        bits = np.frombuffer(r["bits"], np.uint8)
        start = (r["bucket"] - 1) * len(bits)
        out[start : start + len(bits)] = bits[: len(out) - start]
    return out


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id, n, s (the sorted hashes as bytes) of the documents in ``wanted``.

    The texts stay where they are: a bitmap of the wanted ids goes to the tasks, and only the sets of what it lets through are
    joined with the ids.  With too many ids for the bitmap the texts are joined with them first.
    """
    marks = _marks(wanted)

    def per_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(words)
        for b in batches:
            if marks is not None:
                at = b.column(2).to_numpy()
                b = b.filter(pa.array((marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            done = 0
            for texts in _chunks(_bytes(b.column(1))):
                h, n = s.sets(texts)
                ends = np.cumsum(n)
                parts = [h[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(texts)), pa.array(n, pa.int64()), pa.array(parts, pa.binary())], names=["id", "n", "s"])
                done += len(texts)

    rows = docs.filter("id is not null").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(MARK_BITS)).alias("at"))
    if marks is None:
        rows = rows.join(wanted, "id", "left_semi")
    out = rows.mapInArrow(per_batch, "id bigint, n bigint, s binary")
    return out if marks is None else out.join(wanted, "id", "left_semi")


def _close_sizes(a: Column, b: Column, share: int) -> Column:
    return (100 * F.least(a, b)) >= (share * F.greatest(a, b))


def _possible(a: str, b: str, share: int) -> Column:
    """Exact bounds on two classes' sizes and sketches: false only where the similarity is below the threshold.

    intersection >= t union and |a| + |b| = union + intersection give |a xor b| <= (1 - t) / (1 + t) (|a| + |b|).
    """
    apart = F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0")))
    for k in range(1, SKETCH // 64):
        apart = apart + F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}")))
    total = F.col(f"{a}.n") + F.col(f"{b}.n")
    return _close_sizes(F.col(f"{a}.n"), F.col(f"{b}.n"), share) & (apart * (100 + share) <= total * (100 - share))


def _confirmed(docs: DataFrame, pairs: DataFrame, words: int, share: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= share * union of their full sets."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = materialise(_sets_of(docs, wanted, words), "shingle-sets")
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").filter(_close_sizes(F.col("na"), F.col("nb"), share))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                z = np.sort(np.concatenate([p, q]), kind="stable")
                both = int((z[1:] == z[:-1]).sum())
                ok.append(100 * both >= share * (len(p) + len(q) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return both.select("a", "b", "sa", "sb").mapInArrow(judge, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, words: int = 2, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id, n_shingles, component_id, kept.  Links have 100 * intersection >= share * union."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    signed = materialise(_signed(docs, words), "signatures")
    live = signed.filter("n > 0 and id is not null")
    # Equal sets have equal signatures, so any of them will do.
    classes = materialise(live.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.any_value("halves").alias("halves"), F.any_value("sketch").alias("sketch")), "classes")

    h = F.col("halves")
    tables = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(HALVES - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(HALVES - 1)), lambda j: F.xxhash64(i, j, F.get(h, i), F.get(h, j + HALVES)))))
    keyed = classes.select("rep", F.explode(tables).alias("key"))
    # Sorted by key, 16 bytes a row, spilling: a grouped minimum instead would hash every key on the map side, and nearly all occur once.
    by_key = Window.partitionBy("key")
    members = keyed.select("key", "rep", F.min("rep").over(by_key).alias("first"), F.max("rep").over(by_key).alias("last"))
    members = materialise(members.filter("first < last").drop("last"), "members")

    slim = classes.select("rep", "n", *[F.get("sketch", k).alias(f"s{k}") for k in range(SKETCH // 64)])
    pairs = members.filter("rep > first").select("rep", "first").distinct()
    pairs = pairs.alias("p").join(slim.alias("a"), F.col("p.rep") == F.col("a.rep")).join(slim.alias("b"), F.col("p.first") == F.col("b.rep")).filter(_possible("a", "b", share))
    pairs = materialise(pairs.select(F.col("p.rep").alias("a"), F.col("p.first").alias("b")), "pairs")
    links = materialise(_confirmed(docs, pairs, words, share), "links")
    label = materialise(connected_components(links), "components")

    # What is left: keys with members (but the first) in several components.
    placed = members.filter("rep > first").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    rest = materialise(placed.join(mixed, "key", "left_semi").join(slim, "rep"), "mixed-keys")
    a, b = rest.alias("a"), rest.alias("b")
    near = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") > F.col("b.rep")) & (F.col("a.c") != F.col("b.c")) & _possible("a", "b", share))
    more = materialise(near.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct(), "more-pairs")
    if not more.isEmpty():
        new = materialise(_confirmed(docs, more, words, share), "more-links")
        if not new.isEmpty():
            label = materialise(connected_components(links.union(new)), "components")

    out = signed.select("id", "n", "f1", "f2").join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"], "left")
    out = out.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("id"))
    out = out.select("id", "n", F.when(F.col("id").isNotNull(), component).alias("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, words: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are near-duplicates of one with a smaller id, all columns as they are.

    Ids are taken to be keys: of rows that share an id all go if one of them is a near-duplicate of a smaller id's, and rows that repeat
    the smallest id of a group stay, as do rows without an id.
    """
    found = near_duplicates(docs, words, share, id_col, text_col)
    gone = found.filter("not kept").select(F.col(id_col)).distinct()
    return docs.join(gone, docs[id_col] == gone[id_col], "left_anti")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.s) + len(y.s) - c)),
k AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS m FROM s UNION SELECT k.a, r.m FROM k JOIN r ON r.d = k.b)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(m) AS component_id, s.doc_id = min(m) AS kept FROM s JOIN r ON r.d = s.doc_id GROUP BY s.doc_id, len(s)
"""
