"""Runs against a definition-by-definition search, texts collapsed, odd inputs, and the registered query on the smallest table."""

import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from landledger.llm import periodic_runs
from landledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_runs(w, least=12):
    """Every period, every stretch whose words equal those a period on; the smallest period of a stretch counts."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((b, n, q) for (b, n), q in out.items())


def collapsed(w, runs):
    gone = {i for b, n, q in runs for i in range(b + q, b + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def report(text, planted_by=None):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if planted_by is not None and w:
        h = zlib.crc32(str(planted_by).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = brute_runs(w)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(((-n, b, q) for b, n, q in runs), default=None)
    longest = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
    return (len(runs), *longest, sha("".join(f"{b},{n},{q}\n" for b, n, q in runs)), sha(collapsed(w, runs)))


NAMES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def random_words(rng):
    w = [rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.choice([0, 1, 5, 20, 60, 120]))]
    for _ in range(rng.randint(0, 4) if w else 0):
        i, k = rng.randrange(len(w)), rng.randrange(len(w) + 1)
        w[k:k] = w[i : i + rng.randint(1, 25)] * rng.randint(1, 4)
    return w


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_those_of_the_definition(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts, least = [random_words(rng) for _ in range(rng.randint(0, 4))], rng.choice([12, 12, 2, 5])
        ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
        got = periodic_runs.runs_of_texts(np.array([w for t in texts for w in t], np.int64), ends, least)
        assert got == [brute_runs(t, least) for t in texts]


def test_fibonacci_words_have_many_nested_runs():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    got = periodic_runs.runs_of_texts(np.array(b), np.array([len(b)]))[0]
    assert got == brute_runs(b) and len(got) > 50


def test_odd_inputs(spark):
    blank, one, odd = " \t\n\x0b\x0c\r", "a " * 30, "x\x1cy   ß ß " * 9
    rows = [(1, None, 5), (2, "", 5), (3, blank, 5), (4, one, 5), (4, one, 5), (None, "b c " * 7, 5), (6, odd, 5), (7, blank + "a b c d " * 3 + "\n", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int").withColumn("runs", F.lit("clash"))
    found = periodic_runs.run_report(periodic_runs.find_runs(docs))
    got = sorted((tuple(r) for r in found.select("doc_id", *NAMES).collect()), key=repr)
    assert got == sorted(((i, *report(t)) for i, t, _ in rows), key=repr)
    assert periodic_runs.find_runs(docs.filter("false")).count() == 0


def test_a_very_long_text_takes_time_in_proportion():
    took = []
    for n in (200_000, 800_000):
        words = np.concatenate([np.arange(n // 2), np.arange(1000).repeat(1)[np.arange(n // 2) % 1000]])
        began = time.time()
        got = periodic_runs.runs_of_texts(words, np.array([n]))[0]
        took.append(time.time() - began)
        assert (n // 2, n // 2, 1000) in got
    assert took[1] < 8 * took[0] + 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_registered_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert got == {r["doc_id"]: report(r["text"], r["doc_id"]) for r in docs}
    assert sum(g[0] > 0 for g in got.values()) > 10
