import random
import re

import pytest

from landledger.llm import near_dups
from landledger.llm.components import connected_components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                i, j = find(i), find(j)
                root[max(i, j)] = min(i, j)
    return sorted((i, len(x), find(i), find(i) == i) for i, x in sets)


def corpus():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    passage = text(40)
    for _ in range(60):  # a common passage in unlike texts
        rows.append(" ".join(text(rng.randint(5, 60)) + passage + text(rng.randint(5, 60))))
    for n in (30, 80, 200):  # chains and groups of near copies
        base = text(n)
        for _ in range(25):
            rows.append(" ".join(base))
            base = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                base[rng.randrange(n)] = rng.choice(words)
    rows += [rows[100].upper(), "\t\n".join(rows[70].split()), "", " \n", None, "one", "ONE", "one two", "two one", "x " * 5000, "x " * 3000 + "y"]
    order = list(range(0, 3 * len(rows), 3))
    rng.shuffle(order)
    return list(zip(order, rows, strict=True))


@pytest.mark.parametrize("k", [2, 5])
def test_equals_brute_force(spark, k):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, kept string").repartition(3)
    assert sorted(map(tuple, near_dups.near_duplicates(df, k).collect())) == brute(rows, k)


def test_odd_rows_and_filter(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (9, None), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(map(tuple, near_dups.near_duplicates(df).collect()), key=repr)
    assert out == sorted([(5, 6, 3, False)] * 2 + [(3, 6, 3, True), (None, 6, None, True), (9, 0, 9, True), (8, 0, 8, True)], key=repr)
    kept = near_dups.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[2], rows[3], rows[4], rows[5]], key=repr)
    assert near_dups.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    e = [(i, i + 1) for i in range(0, 40)] + [(100, 90 + i) for i in range(9)] + [(7, 7), (500, 300), (300, 400)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(e, "u long, v long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[100] == 90 and got[500] == got[300] == got[400] == 300
