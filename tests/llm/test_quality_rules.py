import random
import re

import numpy as np

from landledger.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [None, "", " \n\t", "one", "a b a b a b a b a b a b", "x\ny\nx\n \n \nx", "ab*c #d $%&|<> é漢𝄞 z\x0bq\x0cr\rs", "a b c d e f a b c d e g h a b c d e", " lead and trail ", "w" * 3000, "\u00a0nbsp \u2003em \x1c fs"]


def test_counts_equal_brute_force(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(["a", "b", "c ", " ", "\n", "dd ", "#"]) for _ in range(rng.randint(0, 300))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "en", "s", "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words string, kept int")
    got = {r["doc_id"]: r for r in q.judge_documents(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["kept"] <= (not r["base_failed"])


def test_outliers_go_and_the_bulk_stays(spark):
    rng = random.Random(5)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(40, 400)))
    rows = [(i, prose(), "en" if i % 2 else None, "s1") for i in range(600)]
    rows += [(1000 + i, " ".join(f"{''.join(rng.choice('abcdefgh') for _ in range(5))}***&&&" for _ in range(200)), "en", "s1") for i in range(20)]
    rows += [(2000, rows[0][1], None, None), (2000, rows[0][1], None, None), (None, rows[1][1], "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = [(r["doc_id"], r["kept"]) for r in q.judge_documents(df).collect()]
    assert len(out) == len(rows)
    assert all(k for i, k in out if i is None or i < 1000 or i == 2000)
    assert not any(k for i, k in out if i is not None and 1000 <= i < 2000)
    kept = q.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 603


def test_small_groups_are_held_against_a_shrunk_estimate(spark):
    rng = random.Random(8)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(40, 400)))
    junk = lambda: " ".join(f"{''.join(rng.choice('abcdefgh') for _ in range(5))}***&&&" for _ in range(200))
    rows = [(i, prose(), "en", "big") for i in range(200)]
    rows += [(1000 + i, prose(), "en", f"small{i % 25}") for i in range(250)]
    rows += [(2000 + i, prose(), "de", "rare") for i in range(8)] + [(2100, prose(), None, None)]  # a small language, a group of one
    # In a source of ten, in one of their own, in the small language, without a source, and as the only row of a language.
    rows += [(3000, junk(), "en", "small3"), (3001, junk(), "en", "lone"), (3002, junk(), "de", "rare"), (3003, junk(), "en", None), (3004, junk(), "fr", "rare")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = q.judge_documents(df).collect()
    assert len(out) == len(rows) and not any(r["base_failed"] for r in out)
    assert all(r["distance"] is not None for r in out)
    assert {r["doc_id"] for r in out if not r["kept"]} == set(range(3000, 3005))
    assert sorted(r["doc_id"] for r in q.keep_good(df).collect()) == [i for i, *_ in rows if i < 3000]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert q.judge_documents(df).count() == 0
    assert q.keep_good(df).count() == 0


def numpy_distances(rows):
    """The method by its definition, without bins: (language, source, vector) to squared distances."""
    x = np.array([v for *_, v in rows])
    floors = np.diag(np.array(q.FLOORS) ** 2)

    def distance(m, s, y):
        e = y - m
        return np.einsum("ni,ij,nj->n", e, np.linalg.inv(s), e)

    def mcd(y):
        m = np.median(y, axis=0)
        s = np.diag((1.4826 * np.median(np.abs(y - m), axis=0)) ** 2) + floors
        for _ in range(30):
            near = y[np.argsort(distance(m, s, y), kind="stable")[: int(np.ceil(q.SUBSET * len(y)))]]
            m, s = near.mean(0), np.cov(near.T, bias=True).reshape(3, 3) * q.CONSISTENCY + floors
        return m, s

    whole, out = mcd(x), np.zeros(len(x))
    for lang, source in {r[:2] for r in rows}:
        at = np.array([r[:2] == (lang, source) for r in rows])
        of_lang = np.array([r[0] == lang for r in rows])
        weights = [min(1.0, a.sum() / q.FULL_GROUP) for a in (at, of_lang)]
        own, language = mcd(x[at]), mcd(x[of_lang])
        m, s = (weights[0] * a + (1 - weights[0]) * (weights[1] * b + (1 - weights[1]) * c) for a, b, c in zip(own, language, whole, strict=True))
        out[at] = distance(m, s, x[at])
    return out


def test_verdicts_equal_an_estimate_without_bins(spark):
    rng = random.Random(11)
    word = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    rows = []
    for lang, source, n, most in (("en", "a", 400, 9), ("en", "b", 150, 12), ("de", "a", 90, 14), ("de", "b", 25, 14), ("fr", "c", 6, 8)):
        for k in range(n):
            odd = k % 23 == 0
            rows.append((len(rows), " ".join(word("abcdefgh" if not odd else "ab#$%", most * (4 if odd and k % 2 else 1)) for _ in range(int(rng.lognormvariate(5, 0.8)) + 12)), lang, source))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r["doc_id"]: r for r in q.judge_documents(df).collect()}
    assert not any(r["base_failed"] for r in got.values())

    def vector(r):
        n, chars, symbols = r["n_words"], max(r["word_chars"], 1), r["n_symbols"]
        return [(np.log(chars / n) - np.log(5.5)) * np.sqrt(n / (n + 100)), np.sqrt(symbols / chars) * np.sqrt(n / (n + 20)), np.log(n)]

    want = numpy_distances([(lang, source, vector(got[i])) for i, _, lang, source in rows])
    have = np.array([got[i]["distance"] for i, *_ in rows])
    assert np.quantile(np.abs(np.log((have + 1) / (want + 1))), 0.99) < 0.25
    clear = np.abs(np.log(want / q.CUTOFF)) > 0.25
    assert clear.mean() > 0.9 and 10 < (want > q.CUTOFF).sum() < len(rows) / 5
    assert all(got[rows[k][0]]["kept"] == (want[k] <= q.CUTOFF) for k in np.flatnonzero(clear))


def test_constants():
    assert abs(q._chi_square(7.815, 3) - 0.95) < 1e-4 and abs(q._chi_square(11.070, 5) - 0.95) < 1e-4
    assert abs(q._quantile(0.95) - 7.815) < 1e-3 and 35 < q.CUTOFF < 36 and 1.6 < q.CONSISTENCY < 1.62
