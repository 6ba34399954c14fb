"""Work that must not grow with rows, or with sizes that a file hides: seen in plans."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from landledger.functions import towns
from landledger.operators import blocking, cost, images, resolve, run, score, score_store
from landledger.operators.normalize import normalize_listings
from landledger.plans import roles
from landledger.search_profile import SHIPPED
from landledger.sources import files

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_different_text_is_read_for_tags_once(spark):
    # By text before, by tags after.
    assert optimized(entry.queries()["listing_tags"](spark, SF)).count("Aggregate [") == 2


def test_near_hashes_of_wide_reach_are_posted_under_few_keys(spark):
    rows = spark.createDataFrame([("00000000000000ff",), ("0000000000000000",), ("8000000000003fff",)], "phash string")
    got = images.near_hashes(rows, 14)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {("0000000000000000", "00000000000000ff", 8), ("00000000000000ff", "8000000000003fff", 7)}
    assert spark.range(1).select(F.size(images.chunk_keys(F.col("id"), 1, 5))).first()[0] == 69


def test_patterns_of_town_names_are_constants(spark):
    rows = spark.createDataFrame([("Hof in Prien am Chiemsee gelegen", "Prien am Chiemsee"), ("bei 84503 links", "Altoetting"), ("ROSENHEIM", "Rosenheim"), ("Ort", None), (None, None)], "raw string, name string")
    found = towns.lookup_towns(rows, "raw")
    assert found.filter(~F.col("town.name").eqNullSafe(F.col("name"))).count() == 0
    assert not re.search(r"regexp_replace\(\(?(namedlambdavariable|lambda) ", optimized(found))


def test_refined_pairs_are_neither_grouped_nor_shuffled(spark):
    assert optimized(entry.queries()["hot_blocking"](spark, SF)).startswith("Union")


def test_changes_of_a_log_take_one_shuffle_and_two_sorts(spark):
    plan = entry.queries()["change_kinds"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2


def test_texts_are_normalised_once_for_all_terms(spark):
    assert optimized(entry.queries()["keyword_tags"](spark, SF)).count(r"[^\w\s]") == 1


def test_sources_are_grouped_after_one_shuffle_without_a_sort_of_sightings(spark):
    plan = entry.queries()["best_source"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_partkey") == 1 and plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan
    rows = roles.property_sources(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in rows and rows.count("Exchange") == 1


def test_what_is_sorted_is_not_worked_out_twice(spark):
    assert "Window" not in optimized(entry.queries()["change_feed"](spark, SF))
    assert "LeftSemi" in optimized(entry.queries()["marked_list"](spark, SF))


def test_a_listing_is_normalised_once_for_all_terms_and_facts(spark):
    raw = spark.createDataFrame([], ", ".join(f"{c} string" for c in files.RAW_FIELDS))
    assert optimized(normalize_listings(raw, F.lit("2026-09-01").cast("date"))).count(r"[^\w\s]") <= 8


def test_pairs_that_no_verdict_joins_are_not_made(spark):
    kind = "id long, title string, description string, postcode string, town string, lat double, lon double, geo_precision string, land_sqm double, living_sqm double, price double, year_built int, property_type string, source_ids array<string>, canonical_urls array<string>, phashes array<string>"
    one = lambda i, price, land, ids=(): (i, "Hof", "", "83024", None, None, None, None, land, None, price, None, "hof", list(ids), [], [])
    made = [one(1, 100.0, 900.0), one(2, 101.0, 905.0), one(3, 100.0, 5000.0), one(4, 700.0, 7000.0, ["s:1"]), one(5, 300.0, 100.0, ["s:1"])]
    f = spark.createDataFrame(made, kind)
    assert {(r["a"], r["b"]) for r in blocking.candidate_pairs(f, agreeing=True).collect()} == {(1, 2), (4, 5)}
    # Searches neither shuffle nor group pairs: what is grouped by two ids isn't there.
    found = resolve.find_duplicates(f.filter("id > 3"), f.filter("id <= 3"))
    assert not re.search(r"Aggregate \[id#\d+L, id#\d+L\]", optimized(found))
    judged = resolve.evidence(resolve.candidate_sides(f, f).filter("listing <> candidate"))
    names = ("listing", "candidate", "is_duplicate", "needs_review", "confidence")
    assert {tuple(r) for r in resolve.least_verdict(judged).select(*names).collect()} == {tuple(r) for r in resolve.best_verdict(judged).select(*names).collect()}


def test_scoring_folds_a_text_once_and_looks_for_terms_without_patterns(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        p = roles.properties(spark, SF)
        costs = optimized(cost.estimate_costs(p, SHIPPED))
        facts = score.source_facts(roles.property_sources(spark, SF), roles.sources(spark, SF))
        scored = optimized(score.score_properties(p, facts, SHIPPED, F.lit("1998-12-01").cast("timestamp")))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert len(re.findall(r"lower\(condition#", costs)) == 1 and len(re.findall(r"lower\(price_type#\d+\), ß", scored)) == 1 and "RLIKE" not in costs + scored


def test_facts_of_sources_are_worked_out_once_for_all_scorings(spark, monkeypatch):
    seen, rescore = [], score_store.rescore_dirty

    def watched(props, facts, *rest):
        done = rescore(props, facts, *rest)
        seen.append(("Aggregate" in optimized(facts), len(done.inputFiles())))
        return done

    monkeypatch.setattr(score_store, "rescore_dirty", watched)
    assert entry.queries()["rescored_store"](spark, SF).count() == spark.read.parquet(f"{SF}/part.parquet").count()
    # As many tasks score as there are partitions, though the properties are one small file.
    assert seen == [(False, 4)] * 2 and spark.conf.get("spark.sql.codegen.hugeMethodLimit", None) is None


def test_dirty_rows_are_told_without_sorting_kept_ones(spark, tmp_path):
    store = score_store.ScoreStore(spark, f"file://{tmp_path}/s", 2)
    rows = spark.range(6).selectExpr("id AS property_id", "'h' AS profile_hash", "1.0D AS final_score", "array('x') AS flags", "timestamp'2026-09-01' AS updated_at")
    store.append(rows, 1)
    store.append(rows.filter("property_id < 2").withColumn("updated_at", F.expr("timestamp'2026-09-02'")).withColumn("final_score", F.lit(2.0)), 2)
    updates, read = store.updates("h"), store.read("h", columns=["final_score"])
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (updates, read)]
    assert "SortAggregate" not in plans[0] and "flags" not in plans[1]
    assert {(r["property_id"], r["updated_at"].day) for r in updates.collect()} == {(i, 2 if i < 2 else 1) for i in range(6)}
    assert {tuple(r) for r in read.collect()} == {(i, "h", 2.0 if i < 2 else 1.0) for i in range(6)}


def test_a_run_sends_no_growing_table_through_the_driver(spark, tmp_path, monkeypatch):
    # Ids in sequence: a file of some hundred KB to 4 MB whose rows took 67 MB and more in the driver.
    spark.range(1_000_000).repartition(4).write.parquet(f"file://{tmp_path}/ids")
    ids, seen = spark.read.parquet(f"file://{tmp_path}/ids"), []

    def read(self, *_):
        seen.append(ids.join(ids.withColumnRenamed("id", "other"), F.col("id") == F.col("other"))._jdf.queryExecution().executedPlan().toString())
        raise InterruptedError

    monkeypatch.setattr(run.Run, "read", read)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(InterruptedError):
        run.Run(spark, f"file://{tmp_path}/base", spark.range(1), SHIPPED, 1, datetime(2026, 9, 1), 2).whole({})
    assert "SortMergeJoin" in seen[0] and "BroadcastHashJoin" not in seen[0]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_hashes_within_a_wide_reach_are_compared_in_blocks(spark):
    # A crowd of near hashes, which share nearly all keys, copies, ids of several hashes, and one far from all.
    crowd = [(k, 1 << k % 13 | 1 << 20 + k % 7) for k in range(300)] + [(7, 0), (900, 2**64 - 1), (901, 2**63)]
    rows = spark.createDataFrame([(i, f"{v:016x}") for i, v in crowd], "id long, phash string")
    want = {}
    for i, v in crowd:
        for j, w in crowd:
            if i < j and (v ^ w).bit_count() <= 9:
                want[i, j] = min(want.get((i, j), 64), (v ^ w).bit_count())
    got = images.near_images(rows, 9)
    assert {(r["a"], r["b"]): r["bits"] for r in got.collect()} == want and got.count() == len(want)
    # What is made are the pairs that are given, not those of keys.
    assert "MapInArrow" in optimized(got) and "Generate explode" not in optimized(images.near_hashes(rows, 9)).split("MapInArrow")[0]


def test_a_search_judges_only_what_numbers_can_make_a_duplicate(spark):
    kind = "id long, title string, description string, street string, postcode string, town string, lat double, lon double, geo_precision string, land_sqm double, living_sqm double, price double, year_built int, property_type string, source_ids array<string>, canonical_urls array<string>, phashes array<string>"
    known = (None, 0.0, -100.0, 95.0, 100.0, 105.0, 130.0)
    one = lambda i, lat, land, living, price, year, street=None, ids=(): (i, "Hof am See", "Text", street, "83024", "Au", lat, 12.0, "exact", land, living, price, year, "hof", list(ids), [], [])
    rows = [one(49 * i + 7 * j + k, (None, 47.0, 47.001, 47.0054, 47.02)[(i + j + k) % 5], land, living, price, (None, 1900, 1905)[(i + k) % 3], (None, "Weg 1")[j % 2]) for i, land in enumerate(known) for j, living in enumerate(known) for k, price in enumerate(known)]
    rows += [one(400, 47.0, 1e17, 2e12, 3e16, 1900), one(401, 47.0, 1e17, 2e12, 3e16, 1900), one(402, 47.9, 1.0, 2.0, 3.0, None, ids=["s:1"]), one(403, 47.0, 9.0, 9.0, 9.0, None, ids=["s:1"])]
    f = spark.createDataFrame(rows, kind)
    duplicates = lambda likely: {tuple(r) for r in resolve.evidence(resolve.candidate_sides(f, f, likely)).filter("is_duplicate AND listing < candidate").select("listing", "candidate").collect()}
    assert duplicates(True) == duplicates(False) != set() and (402, 403) in duplicates(True)
    made = [resolve.candidate_sides(f, f, likely).select("listing", "candidate").distinct().count() for likely in (True, False)]
    assert made[0] < made[1] / 4
    # The one verdict of each listing is still the best of all.
    judged = resolve.evidence(resolve.candidate_sides(f, f.filter("id > 200")))
    names = ("listing", "candidate", "is_duplicate", "needs_review", "confidence")
    assert {tuple(r) for r in resolve.find_duplicates(f, f.filter("id > 200")).select(*names).collect()} == {tuple(r) for r in resolve.best_verdict(judged).select(*names).collect()}
