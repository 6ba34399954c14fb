import numpy as np
from pyspark.sql import functions as F

from landledger.llm import permutation_index as p


def brute(ids, x, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, q in zip(ids, u, strict=True):
        if i % 50 == 0:
            s = u @ q
            out[i] = sorted([(-s[j], ids[j]) for j in range(len(ids)) if ids[j] != i])[:k]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v], 1, 2.0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, rank int, score double")


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[1000:1800] = x[1000] + rng.normal(size=(800, 32)) * 0.02  # a large group of near-copies
    ids = np.arange(3000)
    got = {}
    for r in p.nearest(frame(spark, ids, x).repartition(2), F.col("id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    want = brute(ids, x.astype(float))
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5] and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
        scores = {i: s for s, i in [(-a, b) for _, a, b in rows]}
        for i, s in scores.items():
            a, b = x[q].astype(float), x[i].astype(float)
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
        hits += len(set(scores) & {i for _, i in want[q]})
    assert hits / (5 * len(want)) >= 0.95


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (7, [2.0, 0.0]), (3, [3.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 1.0]), (11, [-1.0, 1.0]), (50, []), (100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = [(r["query_id"], r["rank"], r["vec_id"]) for r in p.nearest(df, F.col("id") % 50 == 0).orderBy("rank").collect()]
    assert out == [(0, 1, 3), (0, 2, 7), (0, 3, 11)]
    assert p.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0
    assert p.nearest(df.filter("vec_id = 7"), F.col("id") % 50 == 0).count() == 0


def test_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    df = frame(spark, np.arange(400), x)
    one = sorted(map(tuple, p.nearest(df, F.col("id") % 50 == 0).collect()))
    monkeypatch.setattr(p, "BLOCK", 3)
    assert sorted(map(tuple, p.nearest(df, F.col("id") % 50 == 0).collect())) == one


def test_equal_vectors_tie_exactly_wherever_they_stand(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24))
    rows, seen = [], set()
    for i in rng.permutation(2400).tolist():
        rows.append((i, (base[i % 40] * 2.0 ** (i % 5 - 2)).tolist()))
        seen.add(i)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = {}
    for r in p.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert len(got) == 48
    for q, found in got.items():
        same = [i for i in range(q % 40, 2400, 40) if i != q][:5]
        assert [i for i, _ in found] == same and len({s for _, s in found}) == 1


def test_scores_have_one_order_of_sums():
    rng = np.random.default_rng(4)
    for width in (3, 64, 129, 1000):
        x, q = rng.normal(size=(97, width)), rng.normal(size=width)
        whole = p.cosines(x, q)
        for a, b in ((0, 1), (5, 6), (3, 20), (50, 97)):
            assert (p.cosines(x[a:b].copy(), q) == whole[a:b]).all()


def test_great_small_and_repeated_vectors(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e-200, 1e-200]), (2, [1e300, 1e299]), (3, [0.0, 1e-300]), (3, [1e-300, 0.0]), (4, [5.0, 0.0]), (4, [5.0, 0.0]), (5, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = p.nearest(df, F.col("id") % 50 == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in out] == [3, 4, 2, 1, 5]
    assert [round(r["score"], 6) for r in out] == [1.0, 1.0, 0.995037, 0.707107, -1.0]


def test_recall_of_a_full_segment_with_a_cluster():
    """One segment of 30,000 rows, a third of them one cluster: recall against brute force, and the share that is reranked."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30_000, 48))
    x[::3] = x[0] + 0.3 * rng.normal(size=(10_000, 48))
    ids = np.arange(len(x))
    pivots = p.spread_pivots(x[rng.permutation(len(x))[: p.SAMPLE]])
    part = p.Segment(ids, x, pivots, 6)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = {True: [], False: []}
    touched = {True: [], False: []}
    for q in rng.permutation(len(x))[:120].tolist():
        got, score = part.scores(q, x[q], p.prefixes(x[q : q + 1], pivots)[0])
        s = unit @ unit[q]
        s[q] = -2
        hits[q % 3 == 0].append(np.isin(np.argsort(-s)[:5], got).mean())
        touched[q % 3 == 0].append(len(got) / len(x))
    assert np.mean(hits[True]) >= 0.9 and np.mean(hits[False]) >= 0.9
    assert np.mean(touched[False]) <= 0.06 and np.mean(touched[True]) <= 0.4
