"""Notices against edit distances over all spans, exact phrases against a plain search, odd inputs, the registered query."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from landledger.llm import license_scan
from landledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def brute(words, notice, tail, errors):
    """All (start, end, errors) of whole words within the errors."""
    out = {}
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            s = " ".join(words[i:j])
            if tail and not s.endswith(" " + tail):
                continue
            s = s[: len(s) - (len(tail) + 1 if tail else 0)]
            if abs(len(s) - len(notice)) <= errors and (d := distance(s, notice)) <= errors:
                out[i, j] = d
    return out


def spoiled(rng, n):
    s = list(n.words + (f" {rng.choice([n.tail, n.tail, '9'])}" if n.tail else ""))
    for _ in range(rng.randint(0, n.errors + 2)):
        i = rng.randrange(len(s))
        s[i : i + rng.randint(0, 1)] = rng.choice([[], [rng.choice("abcdeilnst e ")]])
    return "".join(s)


@pytest.mark.parametrize("seed", range(3))
def test_a_notice_is_found_exactly_if_a_span_is_within_its_errors(seed):
    rng, all_notices = random.Random(seed), license_scan.scanner().notices
    for _ in range(40):
        n = rng.choice(all_notices)
        noise = lambda: " ".join("".join(rng.choice("undermitlcsa") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 5)))
        words = f"{noise()} {spoiled(rng, n)} {noise()} {spoiled(rng, n)}".split()
        _, _, places = license_scan.Scanner((), ((n.label, n.words, n.tail),)).scan(" ".join(words).encode())
        want = brute(words, n.words, n.tail, n.errors)
        assert bool(places) == bool(want)
        assert all(want[p.start, p.end] <= p.errors <= n.errors for p in places)
        together = license_scan.scanner().scan(" ".join(words).encode())[2]
        assert {(p.start, p.end) for p in places} <= {(p.start, p.end) for p in together}


@pytest.mark.parametrize("n", range(len(license_scan.NOTICES)))
def test_any_piece_may_be_spoiled(n):
    """With errors in every piece but one the notice is still found; with one error more in the last it isn't."""
    notice = license_scan.scanner().notices[n]
    cuts = license_scan.pieces(notice.words, notice.errors)
    for spared in range(len(cuts)):
        text = "".join(p if k == spared else p[: len(p) // 2] + "~" + p[len(p) // 2 + 1 :] for k, (_, p) in enumerate(cuts))
        raw = f"in {text.replace('~', 'é')} {notice.tail} end".encode()
        found = [p for p in license_scan.scanner().scan(raw)[2] if p.label == notice.label]
        assert found and min(p.errors for p in found) <= notice.errors


def plain_report(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = sorted((i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({k for _, k in at}))


def check(rows, docs):
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows), key=repr)
    assert got == sorted(((i, *plain_report(t)) for i, t in docs), key=repr)
    for r in rows:
        labels = set(filter(None, r["labels"].split(",")))
        assert set(filter(None, r["base_labels"].split(","))) <= labels and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == bool(labels) and r["labels"] == ",".join(sorted(labels))


def test_odd_inputs(spark):
    texts = [None, "", " .,;", "Under the MIT License", "UNDER-THE\nMIT LICENSE", "under the mit license", "under the mit license", "cc by cc by nc by nc", "é under the mit license2", "CC BY-NC 4.0; Apache License, Version 2.0 " * 40]
    docs = [(k if k else None, t) for k, t in enumerate(texts)] + [(3, texts[3])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("a.b", F.lit(1)).withColumn("labels", F.lit("clash"))
    check(license_scan.license_report(license_scan.find_notices(df)).collect(), docs)
    assert license_scan.license_report(license_scan.find_notices(df.filter("false"))).count() == 0


@pytest.mark.parametrize("text", ["under the " * 100_000, "under the mit license " * 50_000, "e" * 1_000_000, "general public license version " * 30_000])
def test_very_long_texts(text):
    began = time.time()
    n, exact, _ = license_scan.scanner().scan(text.encode())
    assert n == len(text.split()) and len(exact) == text.count("mit") and time.time() - began < 30


def test_wordings_of_other_hands():
    """Notices as they stand in the wild, and sentences near them that grant nothing."""
    found = {
        "Released under the MIT Licence.": "mit",
        "Licensed under the Apache Licence, Version 2.0": "apache-2",
        "GNU General Public Licence version 3 or later": "gpl-3",
        "the GNU General Public License, version 2": "gpl-2",
        "Redistribution and use in source and binary forms, with or without modification": "bsd",
        "Creative Commons Attribution-NonCommercial 4.0": "cc-by-nc",
        "Permission is hereby granted, free of charge, to any person obtaining": "mit",
    }
    for text, label in found.items():
        raw = text.lower().translate({ord(c): " " for c in ".,-'\""}).encode()
        assert {p.label for p in license_scan.scanner().scan(raw)[2]} == {label}, text
    for text in ("a driving license for the public", "under the same roof", "the version 2 of the general plan", "under the site license", "all rights of way"):
        assert not license_scan.scanner().scan(text.encode())[2], text


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_registered_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op12_license_scan"](spark, SF).collect()
    check(rows, docs)
    assert any(r["labels"] for r in rows)
