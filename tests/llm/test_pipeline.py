"""The pipeline against its stages' brute-force rules, on a small fixture."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from landledger.llm import pii
from landledger.llm.shared import materialise

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(rng.randint(40, 200))) for i in range(200)]
    rows += [(300 + i, rows[i][1]) for i in range(10)]  # exact copies
    rows += [(400 + i, rows[i + 20][1] + " extra") for i in range(10)]  # near copies
    rows += [(500 + i, " ".join(["spam"] * 60)) for i in range(20)] + [(600, None), (601, ""), (602, "too short")]
    rows += [(700, prose(60) + " mail a.b@c.example.org end")]
    docs = [(i, t, "en", f"s{i % 2}", None if t is None else len(t)) for i, t in rows]
    labels = [(i, int(i < 500), 0) for i, *_ in docs if i % 2 == 0 and i < 600]
    return docs, labels


def test_stages_take_effect(spark, tmp_path):
    docs, labels = fixture()
    sf = f"file://{tmp_path}"
    spark.createDataFrame(docs, COLUMNS).withColumn("a.b", F.lit(1)).withColumn("component", F.lit("x")).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    names = now.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, materialise(stage(spark, now, sf), "pipeline-test")
        seen[name] = {r["doc_id"]: r for r in now.collect()}
        if name != "packing":
            assert now.columns == names and now.count() <= before.count()
    clean = {i for i, *_ in docs if i < 500 or i == 700}
    assert set(seen["quality_rules"]) == clean
    assert len(clean - set(seen["quality_classifier"])) <= 2
    kept = seen["near_duplicates"]
    assert not set(kept) & {300 + i for i in range(10)} and not set(kept) & {400 + i for i in range(10)}
    assert "<EMAIL>" in seen["personal_data"][700]["text"] and seen["personal_data"][700]["n_chars"] == len(seen["personal_data"][700]["text"])
    assert all(not pii.base_spans(r["text"]) for r in seen["personal_data"].values())
    assert set(seen["packing"]) == set(kept)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "personal_data", "packing"]
