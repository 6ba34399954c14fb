"""Weights and draws against a plain computation, for features of several lengths; the registered query is held against SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from landledger.llm import importance_resampling


def features(text, longest):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, longest, buckets, percent=10, least=20):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    made = [(i, *features(t, longest)) for i, t in docs]
    s, t = Counter(bucket(g) for *_, fs in made for g in fs), Counter(bucket(g) for x in target for g in features(x, longest)[1])
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, fs in made:
        weight = sum(gain[bucket(g)] for g in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((n, i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    drawn = able[: len(able) * percent // 100]
    out = [(*r[1:], k) for k, r in enumerate(drawn, 1)]
    return out + [(*r[1:], None) for r in able[len(drawn) :]] + [(*r[1:], None) for r in rows if r[0] < least]


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (2, 50), (3, 1000), (5, 7)])
def test_equals_the_plain_computation(spark, longest, buckets):
    rng = random.Random(longest)
    word = lambda: rng.choice(["a", "B", "ÄÖ", "çe", "x1", "the", "of", "Run", "ß", *map(str, range(9))])
    docs = [(k, rng.choice([" ", ", ", "\n-"]).join(word() for _ in range(rng.choice([0, 1, 2, 19, 20, 21, 40, 400])))) for k in range(300)]
    docs += [(None, None), (None, "a b " * 30), (7, docs[7][1]), (-5, "the of " * 300), (9_000_000_000, ""), (301, "z " * 5000)]
    target = [None, "", "the of run run", "ä b c ÄÖ x1 " * 9]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("clash")).withColumn("a.b", F.lit(1)).repartition(5)
    got = importance_resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=buckets)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(docs, target, longest, buckets), key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(k, "w " * 20) for k in range(30)], "doc_id long, text string")
    assert importance_resampling.resample(none, none).count() == 0
    assert importance_resampling.resample(some, none).filter("rank is not null").count() == 3


def test_numbering_goes_over_tasks(spark):
    rows = spark.range(10_000).select((F.col("id") % 7).alias("k"), "id")
    got = importance_resampling.numbered(rows, F.col("k").desc(), F.col("id")).collect()
    want = sorted(((r["k"], r["id"]) for r in got), key=lambda r: (-r[0], r[1]))
    assert [(r["k"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 10_001))
