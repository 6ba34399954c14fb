"""From a batch of typed listings to the log and the snapshot that folds it.

Nothing is updated in place: a batch appends sightings, and facts, places, stamps, prices and states of each property are what
aggregates over its log give.  ``ingest`` composes the steps; each is usable alone.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lifecycle
from .report import latest_wins

# Facts, tags and flags of a property, and how exact a place is.
FACTS = ("title", "description", "street", "postcode", "town", "district", "price", "price_type", "land_sqm", "living_sqm", "usable_sqm", "rooms", "year_built", "property_type")
TAGS = ("building_features", "outbuildings", "special_features", "exclusion_flags")
FLAGS = ("is_foreclosure", "is_monument", "is_private_seller", "is_off_market_signal")
PRECISION_RANK = {"none": 0, "postcode": 1, "town": 2, "street": 3, "exact": 4}


def precision_rank(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRECISION_RANK.items() for x in kv]), F.coalesce(c, F.lit("none"))), F.lit(0))


def _located() -> Column:
    return F.col("lat").isNotNull() & F.col("lon").isNotNull()


def _geo_columns(order: str, anchor: str) -> list[Column]:
    """Aggregates of the place; ``anchor`` is the last located row of a verifying source (null: none)."""
    counts = _located() & (F.col(anchor).isNull() | (F.col(order) >= F.col(anchor)))
    place = F.min_by(F.struct("lat", "lon", F.coalesce("geo_precision", F.lit("none")).alias("geo_precision")), F.when(counts, F.struct(-precision_rank(F.col("geo_precision")), F.col(order))))
    routed = _located() & F.coalesce(F.col("routed"), F.lit(False))
    return [
        place.alias("_place"), F.max_by("air_km", F.when(_located() & F.col("air_km").isNotNull(), F.col(order))).alias("air_km"),
        F.max_by("driving_km", F.when(routed, F.col(order))).alias("driving_km"), F.max_by("driving_minutes", F.when(routed, F.col(order))).alias("driving_minutes"),
    ]


def _anchored(log: DataFrame, order: str) -> DataFrame:
    whole = Window.partitionBy("property_id")
    return log.withColumn("_anchor", F.max(F.when(F.col("verifies") & _located(), F.col(order))).over(whole))


def fold_place(log: DataFrame, order: str = "seq") -> DataFrame:
    """Where each property is: a verifying source replaces the place, others only where none is known or theirs is more exact.

    So from the last verifying place on, the most exact one counts, of equals the earliest.  Air distance is the last known, the
    route the last that was really computed.
    """
    out = _anchored(log, order).groupBy("property_id").agg(*_geo_columns(order, "_anchor"))
    return out.select("property_id", "_place.*", "air_km", "driving_km", "driving_minutes")


def _stamp_columns(order: str) -> list[Column]:
    proof = F.col("verifies") & F.col("visible")
    return [
        F.min_by("ts", order).alias("first_seen"), F.max_by("ts", order).alias("last_seen"), F.max_by("ts", F.when(proof, F.col(order))).alias("last_verified"),
        F.max_by("source_date", F.when(proof & F.col("source_date").isNotNull(), F.col(order))).alias("source_date"), F.when(F.bool_or(proof), "verified").otherwise("unverified").alias("verification_status"),
    ]


def fold_stamps(log: DataFrame, order: str = "seq") -> DataFrame:
    """First and last sighting by anyone; what only a verifying source that shows the listing may say: checked when, and dated when."""
    return log.groupBy("property_id").agg(*_stamp_columns(order))


def verification_events(log: DataFrame) -> DataFrame:
    """An audit row for each sighting of a source that may prove things."""
    return log.filter("verifies").select("property_id", "source_id", F.col("ts").alias("checked_at"), "url", F.when(F.col("visible"), "verified").otherwise("gone").alias("outcome"))


def upsert_documents(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per property and URL: kind from the latest mention, title, pages and local copy from the latest that has one.

    Both: property_id, url, kind, title, page_count, local_path, seq.  Rows without a URL are dropped.
    """
    rows = stored.unionByName(incoming).filter(F.trim("url") != "")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return rows.groupBy("property_id", "url").agg(F.max_by("kind", "seq").alias("kind"), F.substring(last("title"), 1, 500).alias("title"), last("page_count"), last("local_path"), F.max("seq").alias("seq"))


def snapshot(log: DataFrame, facts: tuple[str, ...] = FACTS, tags: tuple[str, ...] = TAGS, flags: tuple[str, ...] = FLAGS, order: str = "seq") -> DataFrame:
    """One row per property from its whole log: two windows over a property's own rows, then one aggregation on the same key."""
    there = set(log.columns)
    facts, tags, flags = (tuple(n for n in names if n in there) for names in (facts, tags, flags))
    for name, kind in (("lat", "double"), ("lon", "double"), ("geo_precision", "string"), ("air_km", "double"), ("driving_km", "double"), ("driving_minutes", "double"), ("routed", "boolean"), ("source_date", "timestamp")):
        if name not in there:
            log = log.withColumn(name, F.lit(None).cast(kind))
    rows = _anchored(lifecycle.status_after(log, order), order)
    seen = lambda t: F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(t), F.array().cast("array<string>")).alias("t"))))
    out = rows.groupBy("property_id").agg(
        *lifecycle.fact_columns(log, list(facts), order), *_geo_columns(order, "_anchor"), *_stamp_columns(order), F.max_by("status", order).alias("listing_status"), F.count(F.lit(1)).alias("n_sightings"),
        *[F.array_distinct(F.flatten(F.transform(seen(t), lambda x: x["t"]))).alias(t) for t in tags], *[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags],
    )
    return out.select(*[c for c in out.columns if c != "_place"], "_place.*")


def with_prices(snap: DataFrame, journal: DataFrame, order: str = "seq") -> DataFrame:
    """Add price_first, price_date and price_reduction_count from the price journal."""
    j = journal.groupBy("property_id").agg(F.min_by("new_price", order).alias("price_first"), F.max_by("ts", order).alias("price_date"), F.max("reductions").cast("int").alias("price_reduction_count"))
    return snap.join(j, "property_id", "left").withColumn("price_reduction_count", F.coalesce("price_reduction_count", F.lit(0)))


def known_ids(listings: DataFrame, source_rows: DataFrame) -> DataFrame:
    """``listings`` with the property that a source's row already stands for: by source and URL, else by source and external id.

    ``source_rows``: property_id, source_key, url, external_id.  Two equi-joins; of several properties the smallest.
    """
    by_url = source_rows.filter("url is not null").groupBy("source_key", "url").agg(F.min("property_id").alias("_u"))
    by_id = source_rows.filter("external_id is not null").groupBy("source_key", "external_id").agg(F.min("property_id").alias("_i"))
    out = listings.join(by_url, ["source_key", "url"], "left").join(by_id, ["source_key", "external_id"], "left")
    return out.withColumn("known_id", F.coalesce("_u", "_i")).drop("_u", "_i")


def credited(seen: DataFrame, enumerated: DataFrame, source_rows: DataFrame) -> DataFrame:
    """Who counts as seen in a run: what was read, and what was only enumerated (examined, then left out) but is known by source and URL."""
    known = enumerated.select("source_id", "url").distinct().join(source_rows.select("source_id", "url", "property_id"), ["source_id", "url"]).select("source_id", "property_id")
    return seen.select("source_id", "property_id").union(known).distinct()


class Ingested(NamedTuple):
    refused: DataFrame
    log: DataFrame
    snapshot: DataFrame
    journal: DataFrame
    prices: DataFrame
    source_rows: DataFrame
    verifications: DataFrame


def ingest(log: DataFrame, listings: DataFrame) -> Ingested:
    """Append typed listings and fold.

    ``listings``: the log's columns and ``page_kind``; ``property_id`` is resolved already (``known_ids``, then ``resolve.find_duplicates``,
    else a new one).  Pages that are no listings write nothing.  The log may be a filter on the properties concerned.
    """
    kind = F.coalesce(F.col("page_kind"), F.lit("listing"))
    refused = listings.filter(kind != "listing")
    both = log.unionByName(listings.filter(kind == "listing").drop("page_kind"), allowMissingColumns=True)
    prices = lifecycle.price_journal(both)
    return Ingested(refused, both, with_prices(snapshot(both), prices), lifecycle.change_kinds(both), prices, lifecycle.source_rows(both), verification_events(both))


def with_reader_state(props: DataFrame, state: DataFrame) -> DataFrame:
    """What the reader noted (one log row per act: property_id, field, value, ts), never written by a fold: triage state, own title and tier, note, mark.

    The latest act on each field counts; a null value takes it back.
    """
    fields = ("user_state", "user_title", "user_note", "user_renovation_tier", "shortlisted_at")
    now = latest_wins(state, ["property_id", "field"], "ts")
    wide = now.groupBy("property_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    out = props.drop(*fields).join(wide, "property_id", "left")
    return out.withColumn("shortlisted_at", F.col("shortlisted_at").try_cast("timestamp")).withColumn("display_title", F.coalesce(F.when(F.trim("user_title") != "", F.trim("user_title")), F.col("title")))


def run_counts(journal: DataFrame) -> DataFrame:
    """Per run: listings, new, updated, price changes, removed.  ``journal``: run_id, property_id, change_kind."""
    k = F.col("change_kind")
    return journal.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("changes"), F.count_if(k == "first_seen").alias("new"), F.count_if(k.isin("source_change", "description_change", "status_change", "reactivated")).alias("updated"),
        F.count_if(k == "price_change").alias("price_changes"), F.count_if(k == "removed").alias("removed"),
    )
