"""Kept state: incremental folds, kept scores, refined blocking, near images; nulls in distances."""

import random
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from landledger.functions import geo, sql
from landledger.operators import blocking, fold_state, images, ingest, lifecycle, resolve, score_store

DAY = datetime(2026, 9, 1)
LOG = (
    "property_id long, source_id long, verifies boolean, visible boolean, seq long, ts timestamp, title string, price double, text_hash string, lat double, lon double, geo_precision string, "
    "air_km double, driving_km double, driving_minutes double, routed boolean, source_date timestamp, outbuildings array<string>, is_monument boolean"
)


def random_log(rng, n):
    maybe = lambda *x: rng.choice([None, *x])
    out = []
    for seq in range(n):
        located = rng.random() < 0.5
        out.append((
            rng.randrange(6), rng.randrange(4), rng.random() < 0.6, rng.random() < 0.6, seq, DAY + timedelta(days=seq), maybe("", " ", "Hof", "Haus"), maybe(100.0, 100.5, 200.0, 300.0), maybe("h", "i"),
            47.0 + rng.randrange(9) if located else None, 11.0 if located else None, maybe("exact", "town", "street"), maybe(5.0, 7.0), maybe(9.0), maybe(8.0), maybe(True, False), maybe(DAY), maybe([], ["stall"], ["stadel", "stall"]), maybe(True, False),
        ))
    return out


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [0])
def test_batches_give_the_fold_of_the_whole_log(spark, tmp_path, seed):
    rng = random.Random(seed)
    made = random_log(rng, 150)
    batches = [[], [], []]
    for k, r in enumerate(made):  # in order by thirds, but some rows come a batch late
        batches[min(2, k // 50 + (rng.random() < 0.1))].append(r)
    store = fold_state.Store(spark, f"file://{tmp_path}", 3)
    store.apply(spark.createDataFrame([], LOG), 90)
    journal, prices = [], []
    for k, b in enumerate([*batches, batches[2]]):  # the last comes again, as after a failure
        done = store.apply(spark.createDataFrame(b, LOG), min(k, 2))
        if k == 2:
            journal, prices = done.journal, done.prices
    whole = spark.createDataFrame(made, LOG)
    want = ingest.with_prices(ingest.snapshot(whole), lifecycle.price_journal(whole))
    assert set(store.snapshot().columns) == set(want.columns)
    assert rows(store.snapshot(), *want.columns) == rows(want, *want.columns)
    own = {r[4] for r in batches[2]}
    kinds = lifecycle.change_kinds(whole)
    assert rows(journal, *kinds.columns) == rows(kinds.filter(F.col("seq").isin(own)), *kinds.columns)
    assert rows(prices, *prices.columns) == rows(lifecycle.price_journal(whole).filter(F.col("seq").isin(own)), *prices.columns)
    assert store.log().count() == len(made)


def test_a_batch_touches_its_buckets_alone(spark, tmp_path):
    store = fold_state.Store(spark, f"file://{tmp_path}", 8)
    made = random_log(random.Random(3), 60)
    store.apply(spark.createDataFrame(made, LOG), 0)
    before = set(store.state().inputFiles())
    store.apply(spark.createDataFrame([(made[0][0], *made[0][1:4], 999, *made[0][5:])], LOG), 1)
    assert len(before - set(store.state().inputFiles())) == 1
    assert "PartitionFilters: [bucket" in store.state([2])._jdf.queryExecution().executedPlan().toString().replace("isnotnull(bucket#", "bucket#")


def scored(spark, ids, value, at):
    return spark.createDataFrame([(i, "h", float(value), DAY + timedelta(days=at)) for i in ids], "property_id long, profile_hash string, final_score double, updated_at timestamp")


def test_dirty_scores_leave_clean_ones(spark, tmp_path):
    store = score_store.ScoreStore(spark, f"file://{tmp_path}/s", 4)
    store.append(scored(spark, range(10), 1, 0), 1)
    store.append(scored(spark, range(10), 9, 0).withColumn("profile_hash", F.lit("other")), 1)
    for run in range(2, 6):
        store.append(scored(spark, [3, 7], run, run), run)
    want = {i: 5.0 if i in (3, 7) else 1.0 for i in range(10)}
    got = lambda: {r["property_id"]: r["final_score"] for r in store.read("h").collect()}
    assert got() == want
    full = store.compact(1.2, "h")
    assert full and {f[0] for f in full} == {"h"} and got() == want and store.compact(1.2, "h") == []
    assert store.read("other").count() == 10 and spark.read.parquet(f"file://{tmp_path}/s").filter("profile_hash = 'h'").count() < 18


FACTS = "id long, title string, description string, postcode string, town string, lat double, lon double, geo_precision string, land_sqm double, living_sqm double, price double, year_built int, property_type string"


def facts(spark, made):
    empty = F.array().cast("array<string>")
    return spark.createDataFrame(made, FACTS).withColumns({c: empty for c in ("source_ids", "canonical_urls", "phashes")})


def town(rng, n, spread):
    near = lambda x: None if x is None or rng.random() < 0.05 else x * (1 + rng.uniform(-0.06, 0.06))
    out = []
    for i in range(n):
        at = rng.random() < 0.7
        base = (48 + rng.uniform(-0.2, 0.2), 12 + rng.uniform(-0.2, 0.2)) if at else (None, None)
        land, living, price, year = rng.uniform(300, 300 * spread), rng.uniform(60, 60 * spread), rng.uniform(1e5, 1e5 * spread), rng.randrange(1800, 2020)
        if out and rng.random() < 0.2:
            o = rng.choice(out)
            base, (land, living, price, year) = (o[5], o[6]), (near(o[8]), near(o[9]), near(o[10]), o[11])
        out.append((i, "Hof", None, "", "Stadt", *base, rng.choice(["exact", "street", "town"]), near(land), near(living), near(price), year, "hof"))
    return out


def test_refined_keys_lose_no_duplicate(spark):
    """One town of 400: the exact way's pairs, and of the refined ones exactly those with two agreeing numbers."""
    f = facts(spark, town(random.Random(5), 400, 6)).cache()
    every = {(r["a"], r["b"]) for r in blocking.candidate_pairs(f, None).collect()}
    assert every == {(r["a"], r["b"]) for r in resolve.blocking(f).collect()} and len(every) == 400 * 399 // 2
    pairs = blocking.candidate_pairs(f, 50)
    got = {(r["a"], r["b"]): r["pass"] for r in pairs.collect()}
    one = f.select(*[F.struct("*").alias("x"), F.col("id")])
    both = one.select(F.col("x").alias("a")).crossJoin(one.select(F.col("x").alias("b"))).filter("a.id < b.id")
    judged = resolve.evidence(both, similarity=False)
    agree = {(r[0], r[1]) for r in judged.filter("proofs >= 2").select("a.id", "b.id").collect()}
    duplicates = {(r[0], r[1]) for r in judged.filter("is_duplicate").select("a.id", "b.id").collect()}
    # Other pairs are those of grid cells that are small enough to be whole.
    assert agree <= set(got) and all(got[p] == 5 for p in set(got) - agree) and duplicates <= set(got) and duplicates and len(got) < len(every) / 8


def test_shared_keys_are_counted_from_the_facts_of_a_pair(spark):
    """Against a join on all keys: source ids, images, places and towns, some of them shared many times."""
    ids, hashes = F.array(F.concat(F.lit("s"), F.col("id") % 40), F.lit("t"), F.concat(F.lit("u"), F.col("id") % 7)), F.array(F.lpad(F.hex(F.col("id") % 16), 16, "0"))
    f = facts(spark, town(random.Random(7), 60, 6)).withColumns({"source_ids": F.when(F.col("id") < 30, ids).otherwise(F.array().cast("array<string>")), "phashes": F.when(F.col("id") % 3 == 0, hashes).otherwise(F.array().cast("array<string>"))}).cache()
    a, b, step = resolve._block_keys(f, False).alias("a"), resolve._block_keys(f, True).alias("b"), 2 / 111
    apart = F.expr(f"abs(a.lat - b.lat) <= {step} AND abs(a.lon - b.lon) * cos(radians(a.lat)) <= {step}")
    met = a.join(b, F.expr("a.pass = b.pass AND a.key = b.key AND a.id < b.id") & ((F.col("a.pass") != 5) | apart))
    want = {tuple(r) for r in met.groupBy("a.id", "b.id").agg(F.min("a.pass"), F.count(F.lit(1))).collect()}
    got = [tuple(r) for r in blocking.candidate_pairs(f, None).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {r[2] for r in want} >= {1, 4}


def test_copies_are_one_row_in_blocking(spark):
    base = town(random.Random(6), 30, 6)
    made = base + [(100 + k, *base[3][1:]) for k in range(50)]
    distinct, of = blocking.distinct_facts(facts(spark, made))
    assert distinct.count() == 30 and {r["id"] for r in of.filter("of = 3").collect()} == {3, *range(100, 150)}


@pytest.mark.parametrize("bits", [0, 3, 6, 9, 14])
def test_near_hashes_equal_brute_force(spark, bits):
    rng = random.Random(bits)
    own = [rng.getrandbits(64) for _ in range(60)]
    for h in own[:40]:
        for k in (1, bits, bits + 1):
            own.append(h ^ sum(1 << b for b in rng.sample(range(64), k)))
    text = [f"{h:016x}" for h in own]
    want = {(*sorted((x, y)), (int(x, 16) ^ int(y, 16)).bit_count()) for x, y in combinations(set(text), 2) if (int(x, 16) ^ int(y, 16)).bit_count() <= bits}
    df = spark.createDataFrame([(t,) for t in [*text, text[0].upper(), None, "", "xyz"]], "phash string")
    got = [tuple(r) for r in images.near_hashes(df, bits).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_an_unknown_place_is_not_far(spark):
    made = [(48.0, 12.0, 48.0, 13.0)] + [tuple(None if j == k else 48.0 for j in range(4)) for k in range(4)] + [(48.0, 12.0, 48.0, 12.0), (0.0, 0.0, 0.0, 180.0)]
    df = spark.createDataFrame(made, "a double, b double, c double, d double")
    sql.register(spark)
    got = df.select(geo.haversine(*map(F.col, "abcd")).alias("x"), F.expr("ll_haversine_km(a, b, c, d)").alias("y")).collect()
    for r, row in zip(got, made, strict=True):
        assert (r["x"] is None) == (r["y"] is None) == (None in row)
    assert got[0]["x"] == pytest.approx(74.4, abs=0.1) and got[5]["x"] == 0 and got[6]["y"] == pytest.approx(20015.1, abs=0.1)


def test_a_batch_carries_neither_the_state_nor_what_the_fold_does_not_read(spark, monkeypatch):
    written = []
    monkeypatch.setattr(fold_state, "materialise", lambda df, label: written.append(df.columns) or df)
    rows = spark.createDataFrame([(1, 1, True, True, datetime(2024, 1, 1), 1, 5.0, "h", "u")], "property_id long, source_id long, verifies boolean, visible boolean, ts timestamp, seq long, price double, text_hash string, url string")
    fold_state.advance(fold_state.advance(None, rows).state, rows.withColumn("seq", F.lit(2)))
    assert len(written) == 2 and all("url" not in names and "old" not in names for names in written)
