"""Ingest, duplicates, merges, the digest and the results page on small made-up tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from landledger import streaming
from landledger.operators import digest, fold_state, ingest, resolve, score
from landledger.search_profile import SHIPPED

DAY = datetime(2026, 9, 1)
LOG = "property_id long, source_id long, verifies boolean, visible boolean, seq long, ts timestamp, url string, title string, price double, text_hash string, lat double, lon double, geo_precision string, air_km double, driving_km double, driving_minutes double, routed boolean, source_date timestamp, outbuildings array<string>, is_monument boolean, contact_kind string"


def sighting(k, **more):
    row = dict(property_id=1, source_id=1, verifies=True, visible=True, seq=k, ts=DAY + timedelta(days=k), url=f"https://x/{k}", title=None, price=None, text_hash="h", lat=None, lon=None, geo_precision=None, air_km=None, driving_km=None, driving_minutes=None, routed=None, source_date=None, outbuildings=None, is_monument=None, contact_kind=None)
    row.update(more)
    return tuple(row.values())


def test_ingest_composes_the_folds(spark):
    old = [
        sighting(0, verifies=False, source_id=9, title="Fund", price=500_000.0, lat=47.0, lon=11.0, geo_precision="exact", outbuildings=["stadel"]),
        sighting(1, title="Hof", price=490_000.0, lat=47.5, lon=11.5, geo_precision="town", routed=True, driving_km=30.0, source_date=DAY, outbuildings=["stall", "stadel"]),
    ]
    new = [
        sighting(2, verifies=False, source_id=9, title="Anders", price=480_000.0, lat=47.9, lon=11.9, geo_precision="street", air_km=20.0, is_monument=True),
        sighting(3, verifies=False, source_id=8, lat=48.0, lon=12.0, geo_precision="street", routed=False, driving_km=99.0),
        sighting(4, visible=False, price=470_000.0),
        sighting(5, title="Übersicht"),
    ]
    listings = spark.createDataFrame([(*r, "index" if k == 3 else None) for k, r in enumerate(new)], LOG + ", page_kind string")
    done = ingest.ingest(spark.createDataFrame(old, LOG), listings)
    assert done.refused.count() == 1 and done.log.count() == 5
    s = done.snapshot.first()
    assert (s["title"], s["price"], s["listing_status"], s["verification_status"], s["is_monument"], s["outbuildings"]) == ("Hof", 470_000.0, "removed", "verified", True, ["stadel", "stall"])
    assert (s["lat"], s["geo_precision"], s["air_km"], s["driving_km"]) == (47.9, "street", 20.0, 30.0)
    assert (s["first_seen"], s["last_seen"], s["last_verified"], s["source_date"]) == (DAY, DAY + timedelta(days=4), DAY + timedelta(days=1), DAY)
    assert (s["price_first"], s["price_reduction_count"]) == (500_000.0, 2)
    assert [r["change_kind"] for r in done.journal.orderBy("seq").collect()] == ["first_seen", "price_change", "source_change", "removed"]
    assert {(r["outcome"]) for r in done.verifications.collect()} == {"verified", "gone"}


def test_known_rows_and_reader_state(spark):
    rows = spark.createDataFrame([(5, "s", "u1", "e1"), (3, "s", "u1", None), (7, "t", "u1", "e2")], "property_id long, source_key string, url string, external_id string")
    asked = spark.createDataFrame([(1, "s", "u1", None), (2, "s", "u9", "e1"), (3, "t", None, "e2"), (4, "t", None, None), (5, None, "u1", "e1")], "k int, source_key string, url string, external_id string")
    assert {r["k"]: r["known_id"] for r in ingest.known_ids(asked, rows).collect()} == {1: 3, 2: 5, 3: 7, 4: None, 5: None}
    state = spark.createDataFrame([(1, "user_state", "watch", 1), (1, "user_state", None, 2), (1, "user_title", "Mein Hof", 1), (1, "shortlisted_at", "2026-09-01 10:00:00", 1)], "property_id long, field string, value string, ts long")
    out = {r["property_id"]: r for r in ingest.with_reader_state(spark.createDataFrame([(1, "Hof"), (2, "B")], "property_id long, title string"), state).collect()}
    assert out[1]["user_state"] is None and out[1]["display_title"] == "Mein Hof" and out[1]["shortlisted_at"].hour == 10 and out[2]["display_title"] == "B"


def facts(spark, rows, names, listing):
    key = "listing_id" if listing else "property_id"
    schema = f"{key} long, title string, description string, postcode string, town string, lat double, lon double, geo_precision string, land_sqm double, living_sqm double, price double, year_built int, property_type string, street string, source_key string, external_id string, url string"
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema.replace(key, "id", 1)).withColumnRenamed("id", key)
    if listing:
        return resolve.listing_facts(df)
    return resolve.property_facts(df.drop("source_key", "external_id", "url"), df.select("property_id", "source_key", "external_id", "url"))


def test_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    names = ("id", "title", "description", "postcode", "town", "lat", "lon", "geo_precision", "land_sqm", "living_sqm", "price", "year_built", "property_type", "street", "source_key", "external_id", "url")

    def one(i):
        pick = lambda *x: rng.choice([*x, None])
        return dict(zip(names, (i, pick("Hof am See", "Alter Hof in Au", "Sacherl"), pick("schön gelegen", "mit Stadel"), pick("83024", "83569", ""), pick("Au", "Rosenheim"), 47.0 + rng.randint(0, 40) / 1000, 11.0 + rng.randint(0, 40) / 1000, pick("exact", "street", "town"), pick(5000.0, 5100.0, 9000.0), pick(180.0, 260.0), pick(750_000.0, 740_000.0, 400_000.0), pick(1890, 1894, 1950), pick("hofstelle", "sacherl"), pick("Dorfstr. 1", "Weg 2"), pick("s", "t"), pick("e1", "e2", "e3"), pick("https://a/1?utm_x=1", "http://www.a/1/", "https://b/2")), strict=True))

    props, lists = [one(i) for i in range(60)], [one(1000 + i) for i in range(40)]
    p, q = facts(spark, props, names, False), facts(spark, lists, names, True)
    got = {r["listing"]: r for r in resolve.find_duplicates(q, p).collect()}
    assert set(got) == {r["id"] for r in lists}
    # All pairs, without blocking: the verdicts of those that blocking must find, and the best of them.
    every = q.select(F.struct("*").alias("a")).crossJoin(p.select(F.struct("*").alias("b")))
    judged = resolve.evidence(every).select(F.col("a.id").alias("listing"), F.col("b.id").alias("candidate"), "is_duplicate", "confidence", "needs_review")
    best = {r["listing"]: r for r in resolve.best_verdict(judged).collect()}
    duplicates = [i for i, r in best.items() if r["is_duplicate"]]
    assert len(duplicates) > 5
    for i in duplicates:
        assert (got[i]["candidate"], got[i]["confidence"], got[i]["how"]) == (best[i]["candidate"], best[i]["confidence"], "evidence")
    known = spark.createDataFrame([(1000, 7)], "listing long, candidate long")
    assert {(r["candidate"], r["how"], r["confidence"]) for r in resolve.find_duplicates(q, p, known).filter("listing = 1000").collect()} == {(7, "known", 1.0)}
    assert resolve.find_duplicates(q, p.limit(0)).filter("how = 'no_candidates' and not is_duplicate").count() == 40


def test_merge_folds_everything(spark):
    schema = "property_id long, title string, town string, lat double, lon double, geo_precision string, evidence map<string,struct<confidence:double,quote:string>>, listing_status string, removed_at timestamp, verification_status string, price_type string, outbuildings array<string>, is_monument boolean, shortlisted_at timestamp, first_seen timestamp, last_seen timestamp, user_note string"
    d = lambda k: DAY + timedelta(days=k)
    rows = [
        (1, " ", "Au", 47.0, 11.0, "town", {"price": (0.8, "a")}, "removed", d(3), "unverified", "unknown", ["stall"], False, d(9), d(2), d(3), None),
        (2, "Hof", "Inn", 48.0, 12.0, "exact", {"price": (0.8, "b"), "town": (0.6, "c")}, "active", None, "verified", "asking", ["tenne", "stall"], True, d(7), d(1), d(5), "Notiz"),
        (3, "Dritter", None, None, None, "none", None, "stale", None, "unverified", None, None, None, None, d(0), d(1), "n"),
    ]
    group = resolve.survivors(spark.createDataFrame([(2, 1)], "u long, v long"))
    out = {r["survivor_id"]: r for r in resolve.merge_properties(spark.createDataFrame(rows, schema), group).collect()}
    a = out[1]
    assert (a["merged"], a["title"], a["town"], a["lat"], a["geo_precision"], a["listing_status"], a["removed_at"], a["verification_status"], a["price_type"]) == (2, "Hof", "Au", 48.0, "exact", "active", None, "verified", "asking")
    assert (a["outbuildings"], a["is_monument"], a["shortlisted_at"], a["first_seen"], a["last_seen"], a["user_note"]) == (["stall", "tenne"], True, d(7), d(1), d(5), "Notiz")
    assert (a["evidence"]["price"]["quote"], a["evidence"]["town"]["quote"]) == ("a", "c") and out[3]["title"] == "Dritter"
    src = spark.createDataFrame([(1, 5, "u", d(1), d(2), False, None), (2, 5, "u", d(0), d(4), True, "private"), (2, 6, "u", d(0), d(4), True, None)], "property_id long, source_id long, url string, first_seen timestamp, last_seen timestamp, visible boolean, contact_kind string")
    folded = {(r["property_id"], r["source_id"]): r for r in resolve.fold_source_rows(resolve.repoint(src, group)).collect()}
    assert set(folded) == {(1, 5), (1, 6)} and (folded[1, 5]["first_seen"], folded[1, 5]["last_seen"], folded[1, 5]["visible"], folded[1, 5]["contact_kind"]) == (d(0), d(4), True, "private")


def scored(spark):
    schema = "property_id long, title string, town string, price double, price_first double, land_sqm double, air_km double, driving_km double, outbuildings array<string>, special_features array<string>, exclusion_flags array<string>, flags array<string>, reject_reasons array<string>, capital_risk string, confidence_score double, verification_status string, geo_precision string, is_monument boolean, is_foreclosure boolean, is_private_seller boolean, is_off_market_signal boolean, total_high double, total_mid double, renovation_tier string, renovation_evidence string, rejected boolean, shortlist_blocked boolean, final_score double, listing_status string, user_state string, shortlisted_at timestamp, first_seen timestamp, price_delta_pct double"
    row = lambda i, **m: tuple({**dict(zip(schema.replace(" array<string>", "").replace(" long", "").replace(" string", "").replace(" double", "").replace(" boolean", "").replace(" timestamp", "").split(", "), (i, f"Hof {i}", "Au", 500_000.0, 600_000.0, 6000.0, 20.0, None, ["stadel"], [], [], ["SANIERUNGSRISIKO"], [], "high", 70.0, "verified", "town", True, False, True, False, 2e6, 900_000.0, "heavy", "manual", False, False, 80.0 - i, "active", None, None, DAY, None), strict=True)), **m}.values())
    return spark.createDataFrame([row(1), row(2, verification_status="unverified"), row(3, rejected=True, reject_reasons=["X"]), row(4, user_state="archived"), row(5, air_km=200.0, shortlisted_at=DAY), row(6, final_score=None, price=None, confidence_score=10.0)], schema)


def test_digest(spark, tmp_path):
    s = scored(spark)
    categories = s.select("property_id", F.when(F.col("property_id") < 3, "new").otherwise("known").alias("category"))
    earliest = spark.createDataFrame([(1, DAY), (2, DAY - timedelta(days=90))], "property_id long, earliest timestamp")
    urls = spark.createDataFrame([(1, "https://x/<1>")], "property_id long, url string")
    yields = spark.createDataFrame([("a", 3, 1)], "source_key string, observed long, in_radius long")
    towns = spark.createDataFrame([(0, "Au", 1), (1, "Inn", 0)], "ord int, town string, observed long")
    d = digest.build(s, categories, earliest, urls, yields, towns, SHIPPED, F.lit(DAY - timedelta(days=7)), F.lit(DAY))
    by = {r["property_id"]: r for r in d.entries}
    assert [r["rank"] for r in d.entries] == list(range(1, len(d.entries) + 1)) and 3 not in by and 4 not in by
    assert (by[1]["category"], by[2]["category"], by[2]["demoted"]) == ("new", "known", True) and len(d.notes) == 1
    assert (by[1]["action"], by[2]["action"]) == ("📞 SOFORT", "📄 PRÜFEN")
    assert by[1]["why"][:3] == ["Sehr großes Grundstück (6.000 m²)", "Nebengebäude: stadel", "Preis seit Ersterfassung -16,7 %"] and len(by[1]["why"]) <= 5
    assert by[1]["risks"][0] == "Sanierungskosten übersteigen den Kaufpreis deutlich" and len(by[1]["risks"]) == 6
    text, page = digest.as_markdown(d), digest.as_html(d)
    assert text.startswith("# KW 36 / 2026") and "- Inn" in text and "<https" not in page and "&lt;1&gt;" in page
    for _ in range(2):
        digest.save_report(spark, d, f"file://{tmp_path}/reports")
    kept = spark.read.parquet(f"file://{tmp_path}/reports").collect()
    assert len(kept) == 1 and kept[0]["markdown"] == text and kept[0]["profile_hash"] == SHIPPED.profile_hash


def test_results_and_kept_scores(spark):
    rows, counts = digest.results(scored(spark), SHIPPED)
    assert [(r["rank"], r["property_id"]) for r in rows.orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 6)]
    assert tuple(counts.first()) == (3, 1, 6, 1)
    mine, counts = digest.results(scored(spark), SHIPPED, shortlisted_only=True)
    assert [r["property_id"] for r in mine.collect()] == [5] and counts.first()["total"] == 1
    with pytest.raises(ValueError, match="unknown filters"):
        digest.results(scored(spark), SHIPPED, colour="red")
    kept = spark.createDataFrame([(1, "h", 50.0), (2, "g", 60.0)], "property_id long, profile_hash string, final_score double")
    assert [tuple(r) for r in score.stored_scores(scored(spark).select("property_id", "final_score"), kept, "h").select("property_id", "final_score").collect()] == [(1, 50.0)]
    assert [r["property_id"] for r in digest.degraded_order(scored(spark)).collect()][-1] == 6
    runs = spark.createDataFrame([(1, "ok", DAY), (2, "failed", DAY + timedelta(days=1))], "run_id long, status string, finished_at timestamp")
    assert tuple(digest.health(runs.limit(1), F.lit(DAY + timedelta(days=2))).first()) == (1, "ok", 2.0, True)
    assert digest.health(runs, F.lit(DAY + timedelta(days=2))).first()["healthy"] is False


def test_sentences_documents_and_copies(spark, tmp_path):
    schema = "earliest timestamp, changed_days double, old_price double, new_price double, price double"
    df = spark.createDataFrame([(DAY, 3.0, 690_000.0, 595_000.0, 595_000.0), (DAY, None, None, None, 1000.0), (None, None, None, None, None)], schema)
    assert [r[0] for r in df.select(digest.history_sentence()).collect()] == ["Seit September 2026 bekannt, vor 3 Tagen von 690.000 € auf 595.000 € gefallen.", "Seit September 2026 bekannt, unveränderter Preis 1.000 €.", "Noch keine Historie erfasst."]
    p = spark.createDataFrame([(1, "Hof")], "property_id long, title string")
    src = spark.createDataFrame([(1, 2, "u", True, DAY, DAY)], "property_id long, source_id long, url string, visible boolean, first_seen timestamp, last_seen timestamp")
    moves = spark.createDataFrame([(1, DAY, None, 5.0)], "property_id long, ts timestamp, old_price double, new_price double")
    text = digest.json_documents(p, src, moves).first()["document"]
    assert '"title":"Hof"' in text and '"sources":[{' in text and '"new_price":5.0' in text
    base = f"file://{tmp_path}"
    p.write.parquet(f"{base}/p")
    assert digest.backup(spark, {"p": f"{base}/p"}, f"{base}/copy") == {"p": 1}
    digest.write_stage(spark, f"{base}/stages", 1, "score", {"n": 3})
    digest.write_stage(spark, f"{base}/stages", 1, "report", {})
    assert {r["stage"] for r in spark.read.parquet(f"{base}/stages").collect()} == {"score", "report"}


def test_stream_upserts_and_silence(spark, tmp_path):
    base = f"file://{tmp_path}"
    rows = [sighting(k, title=f"t{k}", price=100_000.0 + k, visible=k != 2) for k in range(4)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], LOG).write.mode("append").parquet(f"{base}/in/{k}")
    stream = spark.readStream.schema(LOG).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    streaming.upsert_batches(stream, f"{base}/fold", f"{base}/check", 4).trigger(availableNow=True).start().awaitTermination(180)
    last = fold_state.Store(spark, f"{base}/fold", 4).snapshot().collect()
    whole = ingest.snapshot(spark.createDataFrame(rows, LOG)).first()
    assert len(last) == 1 and last[0]["n_sightings"] == 4 and {c: last[0][c] for c in ("title", "price", "listing_status", "last_seen")} == {c: whole[c] for c in ("title", "price", "listing_status", "last_seen")}
    e = spark.createDataFrame([(1, DAY), (1, DAY + timedelta(hours=1)), (1, DAY + timedelta(days=2))], "k long, ts timestamp")
    assert sorted(r["n"] for r in streaming.sessions(e, "ts", "k", "2 hours").collect()) == [1, 2]
