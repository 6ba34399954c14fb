import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa

from landledger.llm import quality_model as q


def corpus(n=900):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    vocabulary = [word() for _ in range(800)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        good = i % 4 != 0
        if not good:
            words = [words[0]] * len(words) if i % 8 else [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "clash"))
        labels.append((i, int(good)))
    return docs, labels


def test_accuracy_on_held_out_rows(spark):
    docs, labels = corpus()
    extra = [(None, docs[1][1], "x"), (5000, None, "x"), (5001, "", "x"), (1, docs[1][1], "x")]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(None, 1), (2, None)], "doc_id long, quality int")
    out = q.score_documents(df, lab).collect()
    assert len(out) == len(docs) + len(extra)
    truth = dict(labels)
    for r in out:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert len({round(r["score"], 12) for r in out if r["doc_id"] in (5000, 5001)}) == 1
    assert q.score_documents(df.limit(0), lab).count() == 0
    none = q.score_documents(df, lab.limit(0))
    assert {r["score"] for r in none.select("score").distinct().collect()} == {0.5}
    kept = q.keep_good(df, lab)
    assert kept.columns == df.columns and kept.filter("doc_id % 4 <> 0").count() >= 660


def test_context_vectors_equal_brute_force(spark):
    texts = ["a b c a", "b c", "", "d d d", " \n", "A! a_b WORD word word!", "x" * 5000 + " y"]
    got = q.context_vectors(spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3))
    index = q.index_vectors().astype(float)
    want = np.zeros((q.SLOTS, q.WIDTH))
    for t in texts:
        s = q.slots_of(pa.array([t], pa.large_string())).flat
        for i in range(len(s)):
            for j in range(max(0, i - q.REACH), min(len(s), i + q.REACH + 1)):
                if i != j:
                    want[s[i]] += index[s[j]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.abs(got - want).max() < 1e-5


def hashed(text):
    return int(pd.util.hash_array(np.array([text], object), categorize=False)[0])


def slots_by_definition(text):
    out, before = [], None
    for chunk in text.split():
        for token in re.findall(r"[^\W_]+|[^\w\s]+|_+", chunk):
            if token[0].isalnum():
                out.append(hashed(token.lower()) % (q.SLOTS - 64))
                if len(token) > 1 and token.isupper():
                    out.append(q.UPPER)
            else:
                out.append(q.SLOTS - 64 + hashed(token[0] * min(len(token), 2)) % 60)
        if chunk == before:
            out.append(q.REPEATED)
        before = chunk
    return out or [q.EMPTY]


def test_slots_and_pools_equal_brute_force():
    rng = random.Random(2)
    texts = ["", " ", "a a", "a", "a a a b b a", "x!! x!! Y_Y __ 9", "Ünï ÜNÏ", "\u00a0a\u2003b"] + [" ".join(rng.choice(["a", "b", "B!", "--", "AA"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    vectors = np.random.default_rng(1).normal(size=(q.SLOTS, q.WIDTH)).astype(np.float32)
    runs = q.slots_of(pa.array(texts, pa.large_string()))
    x = q.pooled(runs, vectors)
    start = 0
    for k, t in enumerate(texts):
        want = slots_by_definition(t)
        assert runs.flat[start : runs.ends[k]].tolist() == want, t
        start = runs.ends[k]
        v = vectors[want].astype(float)
        assert np.abs(x[k] - np.concatenate([v.mean(0), v.std(0), [np.log1p(len(want)) / 10]])).max() < 1e-3


def test_few_labels(spark):
    docs, labels = corpus(120)
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    learned = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    few = [next(r for r in learned if r[1] == 1), next(r for r in learned if r[1] == 0)]
    out = q.score_documents(df, spark.createDataFrame(few, "doc_id long, quality int")).collect()
    scores = {r["doc_id"]: r["score"] for r in out}
    assert scores[few[0][0]] > 0.5 > scores[few[1][0]]
    one = q.score_documents(df, spark.createDataFrame(few[:1], "doc_id long, quality int"))
    assert {r["score"] for r in one.select("score").distinct().collect()} == {0.5}


def test_one_very_long_word(spark):
    docs, labels = corpus(60)
    df = spark.createDataFrame([*docs, (999, "x" * 3_000_000, "x"), (998, "y " * 400_000, "x")], "doc_id long, text string, score string")
    out = {r["doc_id"]: r["score"] for r in q.score_documents(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(out) == 62 and 0 <= out[999] <= 1 and 0 <= out[998] <= 1
