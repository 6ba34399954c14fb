r"""Importance resampling towards a target: hashed n-gram counts weigh each document, noise and a top-k draw without replacement.

1. Features of a text are its runs of 1 to ``longest`` consecutive words, joined by one space.  Each task makes a suffix array of
   word numbers for each slice of its partition (``suffix_arrays``, sorted as deep as the longest feature).  In its order equal features
   are neighbours: every run of suffixes that share n words is one n-gram, which is hashed once, and its bucket is
   scattered back to all of the run's places.
2. Buckets are counted over all documents and over all target texts: one row per bucket and task is shuffled.
3. A bucket's gain is floor(1000 ln) of its smoothed share in the target over that in the documents; a document's weight the floored
   mean of its features' gains, its score the weight plus Gumbel noise from a hash of its id, so the draw repeats exactly.
4. The documents with at least ``least_words`` words are sorted by score over all tasks and numbered by the tasks' row counts; the
   first ``percent`` of a hundred are drawn.  No group, histogram or ranking is ever in one task.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.  Odd inputs: null and empty texts have no features, weight 0, and
are never drawn; without target texts all gains come from the smoothing.  A null id counts as '' under the noise and comes last among ties; repeated
rows are scored alike and each takes a rank of its own.  An empty table gives an empty table.  Other columns are ignored.  Memory: a slice of
texts of 4 MB (or one longer text) and one number for each bucket.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import distinct, slices, strings
from .shared import materialise
from .suffix_arrays import closed, suffix_array
from .words import split_words, translated

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20


def slice_buckets(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every feature of a slice of texts its text's number and its bucket, and the number of words of each text."""
    words, ends = split_words(translated(texts))
    number, different = distinct(words)
    vocabulary = [w.encode() for w in strings(different)]
    lengths = np.diff(ends, prepend=0)
    codes, starts = closed(number.astype(np.int64), ends, len(vocabulary))
    sa = suffix_array(codes, longest)
    common = np.minimum(sa.neighbours(), longest)
    text_at = np.searchsorted(starts, sa.order, "right") - 1
    room = starts[text_at] + lengths[text_at] - sa.order  # words up to the text's end
    owners, found = [], []
    for n in range(1, longest + 1):
        fits = room >= n
        run = np.cumsum(common < n) - 1  # suffixes that share n words are one run; those without room are runs of one
        first = np.flatnonzero((common < n) & fits)
        hashed = np.zeros(int(run[-1]) + 1 if len(run) else 0, np.int64)
        grams = (codes[sa.order[first] + k].tolist() for k in range(n))
        hashed[run[first]] = [zlib.crc32(b" ".join(vocabulary[w] for w in gram)) % buckets for gram in zip(*grams, strict=True)]
        owners.append(text_at[fits])
        found.append(hashed[run[fits]])
    return np.concatenate(owners), np.concatenate(found), lengths


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Columns: bucket, n (its features in all texts)."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for some in slices(b.column(0)):
                total += np.bincount(slice_buckets(some, longest, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    rows = texts.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(partial, "bucket int, n bigint")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(of_documents: DataFrame, of_target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """One number a bucket; that many rows reach the driver, whatever the tables are."""

    def counts(df: DataFrame) -> tuple[list[int], int]:
        out = [0] * buckets
        for bucket, n in df.collect():
            out[bucket] = n
        return out, sum(out)

    (s, all_s), (t, all_t) = counts(of_documents), counts(of_target)
    share = lambda a, b: (float(b + 1) * float(all_s + buckets)) / (float(a + 1) * float(all_t + buckets))
    return np.array([math.floor(1000 * math.log(share(a, b))) for a, b in zip(s, t, strict=True)], np.int64)


def noise(id_col: str, seed: int = SEED) -> Column:
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256), 1, 8)
    return F.floor(-1000 * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296))).cast("long")


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """Columns: id, n_words, n_features, weight."""

    def per_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for some in slices(b.column(1)):
                owner, bucket, n_words = slice_buckets(some, longest, len(gain))
                n = np.bincount(owner, minlength=len(some))
                total = np.zeros(len(some), np.int64)
                np.add.at(total, owner, gain[bucket])  # whole numbers, so no order of rounding
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), pa.array(n_words), pa.array(n), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])
                at += len(some)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(per_batch, f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` from 1 in this order: sorted into ranges, each task's rows numbered behind those of the tasks before."""
    in_order = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    in_order = materialise(in_order, "in-order")
    task, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = in_order.groupBy(task.alias("_task")).count()  # one row a task
    before = sizes.select("_task", F.coalesce(F.sum("count").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    both = in_order.withColumn("_task", task).join(F.broadcast(before), "_task")
    return both.withColumn("rank", F.col("_before") + within + 1).drop("_task", "_before", "_at")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Columns: the id, n_features, weight, score, rank (null where the row isn't drawn); one row for each of ``docs``."""
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets), buckets)
    scored = weighed(docs, gain, id_col, text_col, longest)
    # Numbers only; the ranking below doesn't read texts again.
    scored = materialise(scored.withColumn("score", F.col("weight") + noise("id", seed)), "resampling-scores")
    able = F.col("n_words") >= least_words
    ranked = numbered(scored.filter(able), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"))
    most = scored.filter(able).count() * percent // 100
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    names = ["id", "n_features", "weight", "score", "rank"]
    return drawn.select(*names).union(rest.select(*names)).withColumnRenamed("id", id_col)


ORACLE_SQL = r"""
WITH crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(n AS BIGINT))) AS t),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS g FROM benchmark),
e AS (SELECT doc_id, unnest(w) AS g FROM w),
words AS (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM e UNION SELECT g FROM b)),
hashed AS (SELECT g, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
  lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS h FROM words, crc_table),
s AS (SELECT h, count(*) AS n FROM e JOIN hashed USING (g) GROUP BY h),
t AS (SELECT h, count(*) AS n FROM b JOIN hashed USING (g) GROUP BY h),
gain AS (SELECT s.h, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE) / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (h)),
weight AS (SELECT doc_id, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM e JOIN hashed USING (g) JOIN gain USING (h) GROUP BY doc_id),
scored AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || w.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w LEFT JOIN weight USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= 20)
SELECT scored.*, CASE WHEN r <= (SELECT count(*) FROM ranked) // 10 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
