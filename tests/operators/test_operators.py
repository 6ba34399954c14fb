"""Scenarios of lifecycle, resolution, score and reports."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from landledger.operators import digest, lifecycle, report, resolve, score
from landledger.operators.links import components
from landledger.search_profile import BUILT_IN, SHIPPED, Renovation

DAY = datetime(2026, 9, 1)
LOG = "property_id long, source_id long, verifies boolean, visible boolean, ts timestamp, seq long, price double, text_hash string"


def log(spark, *rows):
    return spark.createDataFrame([(1, s, v, vis, DAY + timedelta(days=n), n, p, "h") for n, (s, v, vis, p) in enumerate(rows)], LOG)


def test_price_cut_is_two_journal_rows(spark):
    j = lifecycle.price_journal(log(spark, (1, True, True, 790_000.0), (1, True, True, 790_000.5), (1, True, True, 749_000.0))).orderBy("seq").collect()
    assert [(r["old_price"], r["new_price"]) for r in j] == [(None, 790_000.0), (790_000.5, 749_000.0)]
    assert j[1]["delta_abs"] == -41_000.5 and j[1]["delta_pct"] == pytest.approx(-5.19, abs=0.01) and j[1]["reductions"] == 1


def test_authority(spark):
    folded = lifecycle.fold_facts(log(spark, (9, False, True, 1.0), (1, True, True, 2.0), (9, False, True, 3.0), (1, True, True, None)), ["price"]).first()
    assert folded["price"] == 2.0


def test_removed_and_back(spark):
    k = lifecycle.change_kinds(log(spark, (1, True, True, 10.0), (1, True, False, 10.0), (1, True, True, 5.0)))
    assert sorted((r["seq"], r["change_kind"]) for r in k.collect()) == [(0, "first_seen"), (1, "removed"), (2, "price_change"), (2, "reactivated")]


def test_another_source_keeps_it_alive(spark):
    s = lifecycle.status_after(log(spark, (1, True, True, None), (2, True, True, None), (1, True, False, None), (9, False, True, None), (2, True, False, None), (9, False, True, None)))
    assert [r["status"] for r in s.orderBy("seq").collect()] == ["active", "active", "active", "active", "removed", "discovered"]


def test_as_of_keeps_events_without_a_price(spark):
    e = spark.createDataFrame([(1, DAY, 1), (1, DAY + timedelta(days=2), 2), (2, DAY, 3)], "property_id long, at timestamp, event_id long")
    p = spark.createDataFrame([(1, DAY + timedelta(days=1), 7, 5.0), (1, DAY + timedelta(days=1), 8, 6.0)], "property_id long, ts timestamp, price_id long, price double")
    assert sorted((r["event_id"], r["price"]) for r in lifecycle.prices_as_of(e, p).collect()) == [(1, None), (2, 6.0), (3, None)]


def test_absence_guards(spark):
    rows = spark.createDataFrame([(p, s, True, DAY - timedelta(days=100 if p == 3 else 1), "active") for s in (1, 2, 3) for p in range(1, 11)], "property_id long, source_id long, visible boolean, first_seen timestamp, status string")
    seen = spark.createDataFrame([(p, 1) for p in range(1, 9)] + [(p, 2) for p in range(1, 4)], "property_id long, source_id long")
    runs = spark.createDataFrame([(1, True, True, None), (2, True, True, None), (3, True, True, None)], "source_id long, can_verify boolean, complete boolean, ttl_days int")
    moves, refused = lifecycle.mark_missing(rows, seen, runs, F.lit(DAY))
    assert {tuple(r) for r in refused.collect()} == {(2, "too_many_missing"), (3, "nothing_seen")}
    assert {(r["property_id"], r["new_status"]) for r in moves.collect()} == {(9, None), (10, None)}  # sources 2 and 3 still show them


def test_merge_chains_and_cycles(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (7, 8), (8, 7)], "property_id long, merged_into_id long")
    assert {tuple(r) for r in lifecycle.resolve_merges(links).collect()} == {(2, 1), (3, 1), (4, 1), (7, 7), (8, 7)}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40)], "u long, v long")
    got = dict(map(tuple, components(e).collect()))
    assert {got[i] for i in range(21)} == {0} and got[50] == 40


def test_token_set_ratio():
    assert resolve.token_set_ratio("hof in ort", "ort hof in") == 100.0
    assert resolve.token_set_ratio("a b", "a b c") == 100.0
    assert resolve.token_set_ratio("", "a") == 0.0
    assert resolve.token_set_ratio("abc", "abd") == pytest.approx(66.67, abs=0.01)


def test_near_images_finds_all_within_six_bits(spark):
    rows = spark.createDataFrame([(1, "ffffffffffffffff"), (2, "fffffffffffffffe"), (3, "fefefefefefeffff"), (4, "fefefefefefefeff"), (5, "zz")], "id long, phash string")
    assert {(r["a"], r["b"], r["bits"]) for r in resolve.near_images(rows).collect()} == {(1, 2, 1), (1, 3, 6), (3, 4, 1)}


@pytest.mark.parametrize("bits", [6, 14, 17])
def test_near_images_equals_brute_force(spark, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(12)]
    spread = sum(1 << 8 * k for k in range(8))  # one bit of every byte
    all_bits = [*base, base[0] ^ spread, base[1] ^ spread ^ 0x020202020202]
    all_bits += [v ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 20))) for v in base for _ in range(6)]
    rows = spark.createDataFrame([(i, f"{v:016x}" if i % 2 else f"{v:016X}") for i, v in enumerate(all_bits)], "id long, phash string")
    want = {(i, j, (v ^ w).bit_count()) for i, v in enumerate(all_bits) for j, w in enumerate(all_bits) if i < j and (v ^ w).bit_count() <= bits}
    assert bits < 14 or {(0, 12, 8), (1, 13, 14)} <= want
    got = resolve.near_images(rows, bits).collect()
    assert len(got) == len(want) and {(r["a"], r["b"], r["bits"]) for r in got} == want


def test_proofs_come_before_scores(spark):
    cols = "id long, title string, description string, property_type string, postcode string, town string, land_sqm double, living_sqm double, price double, year_built int, lat double, lon double, geo_precision string, street string, source_ids array<string>, canonical_urls array<string>, phashes array<string>"
    thin = lambda i, street=None, ids=(), urls=(), hashes=(), lat=None: (i, None, None, "", "", None, None, None, None, None, lat, lat, "exact", street, list(ids), list(urls), list(hashes))
    rows = [
        thin(1, ids=["x:1", None], lat=47.0), thin(2, ids=["x:1"], lat=48.0), thin(3, urls=["https://a/b"]), thin(4, urls=["https://a/b", "https://c"], hashes=["ffffffffffffffff"]),
        thin(5, hashes=["zz", "ffffffffffffffc0"]), thin(6, hashes=["ffffffffffffff80", None]), thin(7, "Am Hang 3"), thin(8, "am-hang 3"), (9, *(None,) * 16), (10, *(None,) * 16), thin(11, ids=[None]), thin(12, ids=[None]),
    ]
    f = spark.createDataFrame(rows, cols)
    few = lambda name, one: f.select("id", F.explode(name).alias(one))
    found = resolve.blocking(f, few("canonical_urls", "url"), source_ids=few("source_ids", "source_id"), images=few("phashes", "phash"))
    assert {(r["a"], r["b"]) for r in found.filter("pass = 1").collect()} == {(1, 2), (3, 4), (4, 5), (5, 6)}
    side = f.select(F.struct("*").alias("s"))
    pairs = side.select(F.col("s").alias("a")).crossJoin(side.select(F.col("s").alias("b"))).filter("a.id < b.id")
    got = {(r["i"], r["j"]): (r["is_duplicate"], r["confidence"], r["needs_review"]) for r in resolve.evidence(pairs).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), "is_duplicate", "confidence", "needs_review").collect()}
    assert {k: v for k, v in got.items() if v != (False, 0.0, False)} == {(1, 2): (True, 1.0, False), (3, 4): (True, 1.0, False), (4, 5): (True, 0.97, False), (5, 6): (True, 0.97, False), (7, 8): (False, 0.1, False)}
    assert len(got) == 66


def test_profiles():
    assert BUILT_IN.radius.effective_soft == 100.0 and BUILT_IN.radius.effective_hard == 116.0
    b = BUILT_IN.budget
    assert (b.purchase_target, b.purchase_negotiation, b.purchase_hard_max, b.total_exceptional, b.total_hard_max) == (750_000, 850_000, 900_000, 1_350_000, 1_500_000)
    assert BUILT_IN.profile_hash != SHIPPED.profile_hash and BUILT_IN.with_sliders(air_km=80).profile_hash == BUILT_IN.profile_hash
    with pytest.raises(ValueError):
        Renovation(modern_year=1900)


def test_unknown_filter_is_refused(spark):
    with pytest.raises(ValueError):
        score.apply_filters(spark.range(1), colour="red")


def test_timeline_folds_runs(spark):
    e = spark.createDataFrame([(1, i, i, k) for i, k in enumerate(["observation", "observation", "price", "observation", "price", "price"])], "property_id long, ts long, seq long, kind string")
    assert [(r["kind"], r["n"]) for r in report.timeline(e).orderBy("island").collect()] == [("observation", 2), ("price", 1), ("observation", 1), ("price", 1), ("price", 1)]


def test_sinks(spark, tmp_path):
    base = f"file://{tmp_path}"
    for h, n in (("a", 1), ("b", 2), ("a", 3)):
        report.write_scores(spark.createDataFrame([(n, h)], "property_id int, profile_hash string"), f"{base}/scores")
    assert {tuple(r) for r in spark.read.parquet(f"{base}/scores").collect()} == {(3, "a"), (2, "b")}
    for day in ("2026-09-01", "2026-09-02"):
        report.write_log(spark.createDataFrame([(1, day)], "x int, run_date string"), f"{base}/log")
    assert spark.read.parquet(f"{base}/log").count() == 2
    digest.write_export(spark.createDataFrame([(1, "a;b", None, "x")], "property_id int, title string, town string, shortlisted_at string").coalesce(1), f"{base}/export")
    lines = next((tmp_path / "export").glob("part-*")).read_text(encoding="utf-8").splitlines()
    assert lines[0].startswith("\ufeffrank;property_id;title") and '"a;b"' in lines[1] and lines[1].endswith(";1")


def test_evidence_and_tags(spark):
    rows = [(1, 0, {"price": (0.8, "a")}, ["x"], False), (1, 1, {"price": (0.8, "b"), "town": (0.6, "c")}, ["y", "x"], True), (1, 2, {"town": (0.9, "d")}, None, None)]
    df = spark.createDataFrame(rows, "property_id long, seq long, evidence map<string,struct<confidence:double,quote:string>>, tags array<string>, flag boolean")
    e = lifecycle.merge_evidence(df).first()["evidence"]
    assert (e["price"]["quote"], e["town"]["quote"]) == ("a", "d")
    t = lifecycle.fold_tags(df, ["tags"], ["flag"]).first()
    assert t["tags"] == ["x", "y"] and t["flag"] is True


def test_delete(spark):
    p = spark.createDataFrame([(1, None), (2, 1), (3, None)], "property_id long, merged_into_id long")
    tables = {"property": p, "log": spark.createDataFrame([(3,), (3,), (1,)], "property_id long")}
    assert {tuple(r) for r in lifecycle.dependent_rows(tables, 3).collect()} == {("property", 1), ("log", 2)}
    assert lifecycle.delete_property(tables, 3)["log"].count() == 1
    with pytest.raises(ValueError):
        lifecycle.delete_property(tables, 1)
