"""Nearest neighbours by cosine with a permutation index.

1. Pivots: of a bounded sample (the ``SAMPLE`` vectors with the smallest hashes of their ids) the first ``PIVOTS`` that aren't near
   one chosen before, so that a large group of near-copies gives one pivot.  Every row is indexed.
2. A vector is represented by its ``PREFIX`` nearest pivots in order.  Each segment of up to ``SEGMENT`` vectors posts, in the inverted
   file of each of these pivots, the vector and the place the pivot takes for it.
3. A query walks the files of its own nearest pivots only.  Pivots that just one of two prefixes holds count as if they came right after
   the other's end, so Spearman's footrule is a constant less a sum over common pivots: each posting adds to its vector
   how far before the end the later of the two places is.
4. The ``SHARE`` of a segment with the least footrule, and all below ``CLOSE`` of the greatest (groups of near-copies, however large,
   come whole), are reranked by exact cosine in double precision.  The sum of products has one order, whatever the
   row's place, so equal vectors have equal scores.

Of equal vectors in a segment the k + 1 with the smallest ids are kept, as no others can be among a query's nearest k.

Data stay where they are: a task indexes what it reads and keeps the best few per query, so what is shuffled is queries x
tasks x k rows.  Queries go to the tasks in blocks of ``BLOCK`` rows (16 MB for 64 components), one pass over the data for each block.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do null
ids.  A repeated query id is searched once (its least vector); a candidate id is returned once for a query, with its best score.
Rows with the query's own id are not its neighbours.  Fewer candidates than k give fewer rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

PIVOTS, PREFIX, SAMPLE, APART, SEGMENT = 1024, 64, 4096, 0.7, 65_536
#: Reranked: this share of a segment, this many at least, and all whose footrule is below this part of the greatest.
SHARE, LEAST, CLOSE = 0.05, 200, 0.5
BLOCK = 32_768


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two, which changes no cosine, so that no square overflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True, initial=0))[1])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width))


def prefixes(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each vector its nearest pivots, nearest first; equally near ones by their numbers."""
    m = min(PREFIX, len(pivots))
    out = np.empty((len(vectors), m), np.int16)
    for at in range(0, len(vectors), 4096):
        near = -(vectors[at : at + 4096] @ pivots.T)
        some = np.sort(np.argpartition(near, m - 1, axis=1)[:, :m], axis=1)
        order = np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable")
        out[at : at + 4096] = np.take_along_axis(some, order, 1)
    return out


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Each row's products are added in the same order, wherever it stands (a matrix product's aren't)."""
    dot = (vectors * query).sum(1)
    return dot / (np.sqrt((vectors * vectors).sum(1)) * np.sqrt((query[None] * query).sum(1)))


class Segment:
    """Vectors and the inverted files of the pivots."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, keep: int):
        order = np.lexsort((ids, *vectors.T))
        ids, vectors = ids[order], vectors[order]
        change = np.append(True, (vectors[1:] != vectors[:-1]).any(1))
        new = change | np.append(True, ids[1:] != ids[:-1])  # neither a repeated row
        ids, vectors, change = ids[new], vectors[new], change[new]
        first = np.flatnonzero(change)
        place = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
        self.ids, self.vectors = ids[place < keep], vectors[place < keep]
        self.ids_repeat = len(np.unique(self.ids)) < len(self.ids)
        prefix = prefixes(self.vectors, pivots)
        self.m = prefix.shape[1]
        flat = prefix.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows, self.places = (by_pivot // self.m).astype(np.int32), (by_pivot % self.m).astype(np.int32)
        self.ends = np.cumsum(np.bincount(flat, minlength=len(pivots)))

    def possible(self, prefix: np.ndarray) -> np.ndarray:
        """Rows to be reranked for a query with this prefix."""
        rows, gains = [], []
        for place, p in enumerate(prefix.tolist()):
            file = slice(self.ends[p - 1] if p else 0, self.ends[p])
            rows.append(self.rows[file])
            gains.append(self.m - np.maximum(self.places[file], place))
        common = np.bincount(np.concatenate(rows), np.concatenate(gains), len(self.ids))
        take = min(len(common), max(LEAST, int(np.ceil(SHARE * len(common)))))
        most = self.m * (self.m + 1) / 2
        edge = min(np.partition(common, -take)[-take], (1 - CLOSE) * most)
        return np.flatnonzero(common >= edge)

    def scores(self, query_id: int, query: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, each once, and their cosines."""
        near = self.possible(prefix)
        near = near[self.ids[near] != query_id]
        ids, score = self.ids[near], cosines(self.vectors[near], query)
        if self.ids_repeat:
            order = np.lexsort((-score, ids))
            first = order[np.diff(ids[order], prepend=ids[order][:1] - 1) != 0]
            ids, score = ids[first], score[first]
        return ids, score


def spread_pivots(sample: np.ndarray) -> np.ndarray:
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen, passed = [], []
    for n in range(len(unit)):
        if len(chosen) == PIVOTS:
            break
        near = chosen and (unit[chosen] @ unit[n]).max() > APART
        (passed if near else chosen).append(n)
    return unit[sorted(chosen + passed[: PIVOTS - len(chosen)])]


class Best:
    """The k best candidates of each query so far: most similar first, then the smaller id."""

    def __init__(self, queries: int, k: int):
        self.score, self.ids, self.k = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max), k

    def offer(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        if len(score) > self.k and (keep := score >= np.partition(score, -self.k)[-self.k]).sum() < len(score):
            ids, score = ids[keep], score[keep]
        ids, score = np.concatenate([self.ids[q], ids]), np.concatenate([self.score[q], score])
        order = np.lexsort((ids, -score))
        new = np.ones(len(order), bool)
        same = {}
        for n, i in enumerate(ids[order].tolist()):  # an id once, with its best score
            new[n] = same.setdefault(i, n) == n or score[order[n]] == -np.inf
        order = order[new][: self.k]
        self.ids[q], self.score[q] = ids[order], score[order]


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Columns: query_id, rank (from 1), vec_id, score.  ``is_query`` is a condition on the column ``id``."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if widths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width = widths["w"]
    rows = rows.filter(F.size("v") == width)
    some = rows.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    pivots = spread_pivots(scaled(np.stack(some["v"].to_list()).astype(float)))

    queries = rows.filter(is_query).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // BLOCK))
    if blocks > 1:
        queries = materialise(queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "ann-queries")
    found = []
    for n in range(blocks):
        block = (queries.filter(F.col("block") == n) if blocks > 1 else queries).select("id", "v").toPandas().sort_values("id")
        if not len(block):
            continue
        query_ids = block["id"].to_numpy(np.int64)
        query_vectors = scaled(np.stack(block["v"].to_list()).astype(float))
        found.append(_search(rows, pivots, query_ids, query_vectors, width, k))
        if blocks > 1:
            found[-1] = materialise(found[-1], "ann-block")
    if not found:
        return vectors.sparkSession.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _search(rows: DataFrame, pivots: np.ndarray, query_ids: np.ndarray, query_vectors: np.ndarray, width: int, k: int) -> DataFrame:
    query_prefixes = prefixes(query_vectors, pivots)

    def per_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(query_ids), k)
        ids, held, n = [], [], 0

        def search() -> None:
            i, v = np.concatenate(ids), np.concatenate(held)
            for at in range(0, len(i), SEGMENT):
                part = Segment(i[at : at + SEGMENT], v[at : at + SEGMENT], pivots, k + 1)
                for q in range(len(query_ids)):
                    best.offer(q, *part.scores(query_ids[q], query_vectors[q], query_prefixes[q]))
            ids.clear()
            held.clear()

        for b in batches:
            ids.append(b.column(0).to_numpy(zero_copy_only=False))
            held.append(_matrix(b.column(1), width))
            n += len(ids[-1])
            if n >= SEGMENT:
                search()
                n = 0
        if n:
            search()
        q, c = np.nonzero(best.score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(best.ids[q, c]), pa.array(best.score[q, c])], names=["query_id", "vec_id", "score"])

    best = rows.select("id", "v").mapInArrow(per_partition, "query_id bigint, vec_id bigint, score double")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(order).cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
