"""Counts, categories, coverage, timelines, sparklines and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, matches_search


def source_yield(obs: DataFrame, props: DataFrame, sources: DataFrame, since: Column, radius_km: float) -> DataFrame:
    """Distinct properties seen per source since a time, and those of them known to be in the radius (unknown isn't)."""
    near = F.coalesce(F.col("air_km") <= radius_km, F.lit(False))
    rows = obs.filter(F.col("ts") >= since).join(props.select("property_id", "air_km"), "property_id").join(sources.select("source_id", "source_key"), "source_id")
    return rows.groupBy("source_key").agg(F.countDistinct("property_id").alias("observed"), F.countDistinct(F.when(near, F.col("property_id"))).alias("in_radius"))


def coverage(props: DataFrame, expected: DataFrame) -> DataFrame:
    """``expected``: town, ord.  Properties per expected town, zeros included, in the order of the list."""
    counts = props.groupBy(fold(F.col("town")).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    out = expected.withColumn("_k", fold(F.col("town"))).join(counts, "_k", "left")
    return out.select("ord", "town", F.coalesce("n", F.lit(0)).alias("observed"))


def digest_counts(rows: DataFrame, shortlist: float) -> DataFrame:
    """One row of counters in one pass."""
    alive = ~F.col("listing_status").isin("removed", "sold")
    c = F.count_if
    return rows.agg(
        c(alive).alias("tracked"), c(F.col("listing_status") == "active").alias("active"), c(F.col("listing_status") == "removed").alias("removed"), c(F.col("listing_status") == "stale").alias("stale"),
        c(F.col("verification_status") == "verified").alias("verified"), c(F.col("price").isNull()).alias("without_price"), c(F.col("air_km").isNull()).alias("without_distance"),
        c(F.col("rejected")).alias("rejected"), c(~F.col("rejected") & (F.col("confidence_score") >= shortlist)).alias("shortlistable"), c(F.col("capital_risk").isin("high", "extreme")).alias("risky"),
    )


REJECTS = ("rental", "excluded", "triage", "outside_radius", "not_a_listing")


def reject_reason(radius_km: float) -> Column:
    """Why the pipeline drops a listing before it is remembered, or null.  Unknown distance passes; what is known already stays."""
    known = F.coalesce(F.col("known"), F.lit(False))
    return (
        F.when(F.coalesce(F.col("page_kind"), F.lit("listing")) != "listing", "not_a_listing").when((F.col("price_type") == "rent") & ~known, "rental")
        .when((F.col("price_type") != "rent") & (F.size("exclusion_flags") > 0) & (F.size("building_features") == 0), "excluded").when(F.col("triage_rejects") & ~known, "triage").when(F.col("air_km") > radius_km, "outside_radius")
    )


def earliest_evidence(tables: dict[str, DataFrame]) -> DataFrame:
    """``tables``: name to (property_id, ts).  The earliest time anything speaks of each property."""
    out = None
    for t in tables.values():
        t = t.select("property_id", "ts")
        out = t if out is None else out.union(t)
    return out.groupBy("property_id").agg(F.min("ts").alias("earliest"))


def categorise(props: DataFrame, journal: DataFrame, since: Column) -> DataFrame:
    """reactivated (but not from expired) before new before price_change before known; new needs a known history that starts then."""
    j = journal.filter(F.col("ts") >= since).groupBy("property_id").agg(
        F.coalesce(F.bool_or((F.col("change_kind") == "reactivated") & ~F.coalesce(F.col("old_status") == "expired", F.lit(False))), F.lit(False)).alias("_r"),
        F.coalesce(F.bool_or(F.col("change_kind") == "price_change"), F.lit(False)).alias("_p"),
    )
    out = props.join(j, "property_id", "left")
    new = F.coalesce(F.col("earliest") >= since, F.lit(False))
    return out.withColumn("category", F.when(F.col("_r"), "reactivated").when(new, "new").when(F.col("_p"), "price_change").otherwise("known")).drop("_r", "_p")


def timeline(events: DataFrame, fold_kind: str = "observation") -> DataFrame:
    """``events``: property_id, ts, seq, kind.  Runs of consecutive observations become one row with their number."""
    w = Window.partitionBy("property_id").orderBy("ts", "seq")
    same = (F.col("kind") == fold_kind) & F.coalesce(F.lag("kind").over(w) == fold_kind, F.lit(False))
    out = events.withColumn("_new", F.when(same, 0).otherwise(1))
    out = out.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy("property_id", "island", "kind").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


def sparkline(series: DataFrame, width: float = 120.0, height: float = 28.0) -> DataFrame:
    """``series``: property_id, seq, value.  Evenly spaced x, min-max scaled y (down is more), and the trend from first to last."""
    part = Window.partitionBy("property_id")
    w = part.orderBy("seq")
    n, lo, hi = F.count(F.lit(1)).over(part), F.min("value").over(part), F.max("value").over(part)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("value").over(whole), F.last("value").over(whole)
    x = F.when(n > 1, (F.row_number().over(w) - 1) * width / (n - 1)).otherwise(width / 2)
    y = F.when(hi > lo, height - (F.col("value") - lo) / (hi - lo) * height).otherwise(height / 2)
    return series.select("property_id", "seq", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.when(last > first, "up").when(last < first, "down").otherwise("flat").alias("trend"))


def total_price_delta_pct(price: Column, first: Column) -> Column:
    return F.when(first != 0, F.round(100 * (price - first) / first, 4))


def change_chips() -> Column:
    return F.array_compact(F.array(
        F.when(F.col("category") == "new", "neu"), F.when(F.col("category") == "reactivated", "wieder da"), F.when(F.col("price_delta_pct") < 0, "Preis gesenkt"), F.when(F.col("price_delta_pct") > 0, "Preis erhöht"),
        F.when(F.col("listing_status") == "removed", "entfernt"), F.when(F.col("listing_status") == "stale", "lange nicht gesehen"), F.when(F.col("verification_status") == "verified", "geprüft"), F.when(F.col("driving_km").isNull(), "Route offen"),
    ))


def best_url(rows: DataFrame) -> DataFrame:
    """Per property: the best-marked row, then verifying, visible, reliable, then the smaller source and URL."""
    key = F.struct(~F.col("is_best"), ~F.col("verifies"), ~F.col("visible"), -F.coalesce("reliability", F.lit(0.0)), "source_id", "url")
    return rows.filter(F.col("url").rlike("^https?://")).groupBy("property_id").agg(F.min_by("url", key).alias("url"))


def map_points(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """With coordinates (and whether they are precise), and without."""
    on = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return rows.filter(on).withColumn("precise", F.col("geo_precision").isin("exact", "street")), rows.filter(~on)


def threshold_sweep(rows: DataFrame, thresholds: list[float], group: str) -> DataFrame:
    """Rejected per threshold and group of ``score``: a cut of a sorted list of literals, one pass."""
    per = rows.select(group, F.explode(F.transform(F.array(*map(F.lit, thresholds)), lambda t: F.struct(t.alias("threshold"), (F.col("score") >= t).alias("hit")))).alias("x"))
    return per.groupBy(F.col("x.threshold").alias("threshold"), group).agg(F.count_if("x.hit").alias("rejected"), F.count(F.lit(1)).alias("total"))


def marked_list(scored: DataFrame, marks: DataFrame, needle: str = "") -> DataFrame:
    """The reader's own list: no slider, no gate; what the ranking lacks is there too."""
    return marks.join(scored, "property_id", "left").filter(matches_search(needle, F.col("town"), F.col("title"))).orderBy(F.col("shortlisted_at").desc_nulls_last(), "property_id")


def long_facts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row per property and fact, for a dossier."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return rows.select("property_id", F.inline(pairs))


def write_log(rows: DataFrame, path: str, day: str = "run_date") -> None:
    """Append-only log, one folder per day."""
    rows.write.mode("append").partitionBy(day).parquet(path)


def write_scores(scored: DataFrame, path: str) -> None:
    """One folder per profile; a scoring of all properties replaces its own profile's rows alone.  Parts of a profile go to a ``ScoreStore``."""
    scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("profile_hash").parquet(path)


def latest_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The state of an appended cache: the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def cache_hits(keys: DataFrame, cache: DataFrame, now: Column, days: dict[str, int]) -> DataFrame:
    """Looked-up values that aren't past their kind's lifetime."""
    ttl = F.element_at(F.create_map(*[F.lit(x) for kv in days.items() for x in kv]), F.col("kind"))
    fresh = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) <= ttl * F.lit(86_400_000_000)
    return keys.join(latest_wins(cache, ["kind", "key"], "ts").filter(fresh), ["kind", "key"], "left")


def of_sources(props: DataFrame, source_rows: DataFrame, source_ids: list[int]) -> DataFrame:
    """Properties that one of these sources brought (a paste, say)."""
    return props.join(source_rows.filter(F.col("source_id").isin(source_ids)), "property_id", "left_semi")


def dossier(facts: DataFrame, costs: DataFrame, scores: DataFrame, fields: list[str]) -> DataFrame:
    """section, field and value of all that is kept of a property: its facts, its costs and its scores, in one table of text.

    ``costs`` and ``scores``: rows as ``ScoreStore`` keeps them.  What isn't known has no row.
    """
    def section(rows: DataFrame, name: str) -> DataFrame:
        own = [c for c in rows.columns if c not in ("property_id", "updated_at", "profile_hash")] if name != "facts" else fields
        text = {c: F.array_join(c, ", ") if kind.startswith("array") else F.col(c).cast("string") for c, kind in rows.dtypes}
        return long_facts(rows.select("property_id", *[text[c].alias(c) for c in own]), own).select("property_id", F.lit(name).alias("section"), "field", "value")

    parts = [section(rows, name) for name, rows in (("facts", facts), ("costs", costs), ("scores", scores))]
    return parts[0].union(parts[1]).union(parts[2]).filter("value is not null")
