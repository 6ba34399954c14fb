"""Facts, prices, states and absences from an append-only observation log.

The log has one row per sighting: property_id, source_id, verifies (whether the source may prove things), visible,
ts and seq (a total order within a property), and the facts read.  Facts are never updated in place: every function folds the
log with aggregates or windows over ``property_id``, and a snapshot is what the fold gives.  A property's log is bounded by how
often it was seen; windows over it spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import materialise

DORMANT = ("removed", "expired", "stale")
ELIGIBLE_FOR_STALE = ("active", "discovered", "verified", "price_changed", "expired")
LEAST_MOVE = 1.0


def _filled(c: Column) -> Column:
    """Blank text counts as unknown."""
    return F.when(F.trim(c.cast("string")) != "", c)


def fold_facts(log: DataFrame, fields: list[str], order: str = "seq") -> DataFrame:
    """Per property and field: the last value of a verifying source, else the first of any.

    Verifying sources overwrite, others only fill what is empty.  One aggregation with map-side parts.
    """
    return log.groupBy("property_id").agg(*fact_columns(log, fields, order))


def fact_columns(log: DataFrame, fields: list[str], order: str = "seq") -> list[Column]:
    """The aggregates of ``fold_facts``."""
    aggs = []
    for f in fields:
        known = _filled(F.col(f)) if dict(log.dtypes)[f] == "string" else F.col(f)
        strong = F.max_by(F.when(F.col("verifies"), known), F.when(F.col("verifies") & known.isNotNull(), F.col(order)))
        weak = F.min_by(known, F.when(~F.col("verifies") & known.isNotNull(), F.col(order)))
        aggs.append(F.coalesce(strong, weak).alias(f))
    return aggs


def running_fact(field: str, order: str = "seq") -> Column:
    """The folded value after each row."""
    w = Window.partitionBy("property_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    strong = F.last(F.when(F.col("verifies"), F.col(field)), ignorenulls=True).over(w)
    weak = F.first(F.when(~F.col("verifies"), F.col(field)), ignorenulls=True).over(w)
    return F.coalesce(strong, weak)


def fold_tags(log: DataFrame, lists: list[str], flags: list[str], order: str = "seq") -> DataFrame:
    """Tags are united in order of first mention, flags stay once raised."""
    def union(name: str) -> Column:
        seen = F.array_sort(F.collect_list(F.struct(order, name)))
        return F.array_distinct(F.flatten(F.transform(seen, lambda x: F.coalesce(x[name], F.array().cast("array<string>"))))).alias(name)

    return log.groupBy("property_id").agg(*map(union, lists), *[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags])


def merge_evidence(log: DataFrame, order: str = "seq") -> DataFrame:
    """``evidence``: map of field to struct with ``confidence``.  The surer statement stays, of equals the earlier."""
    long = log.select("property_id", order, F.explode("evidence").alias("field", "e"))
    best = long.groupBy("property_id", "field").agg(F.max_by("e", F.struct(F.col("e.confidence"), -F.col(order))).alias("e"))
    return best.groupBy("property_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "e")))).alias("evidence"))


def price_journal(log: DataFrame, order: str = "seq") -> DataFrame:
    """Moves of the folded price: property_id, seq, ts, old_price, new_price, delta_abs, delta_pct, reductions.

    The first price is a move from nothing.  A move of less than one unit moves the price but is not journaled.
    """
    w = Window.partitionBy("property_id").orderBy(order)
    moved = log.withColumn("new_price", running_fact("price", order)).withColumn("old_price", F.lag("new_price").over(w))
    moved = moved.filter(F.col("new_price").isNotNull() & ~F.col("new_price").eqNullSafe(F.col("old_price")))
    moved = moved.filter(F.col("old_price").isNull() | (F.abs(F.col("new_price") - F.col("old_price")) >= LEAST_MOVE))
    delta = F.col("new_price") - F.col("old_price")
    out = moved.select("property_id", order, "ts", "old_price", "new_price", delta.alias("delta_abs"), F.round(100 * F.try_divide(delta, F.col("old_price")), 4).alias("delta_pct"))
    cuts = F.count_if(F.col("delta_abs") < 0).over(Window.partitionBy("property_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("reductions", cuts)


def status_after(log: DataFrame, order: str = "seq") -> DataFrame:
    """Add ``status`` after each row: active, removed or discovered.

    A verifying sighting makes it active; a verifying absence removes it unless another verifying source still shows it; others
    revive what is dormant as discovered and else change nothing.  The number of verifying sources that show it is a running sum
    of changes per source, so no row looks at the others.
    """
    return _status(log, order).drop("_ot", "_src")


def shown_before(shown: Column, src) -> Column:
    """What the verifying sighting of the same source before this one showed."""
    return F.last(F.when(F.col("verifies"), F.struct(shown.alias("s"))), ignorenulls=True).over(src.rowsBetween(Window.unboundedPreceding, -1))["s"]


def decided(so_far) -> tuple[Column, Column]:
    """The last decision ``_s``, and whether a source that proves nothing has shown it since."""
    other = F.when(F.col("_s").isNotNull(), F.lit(False)).when(~F.col("verifies"), F.lit(True))
    return F.last("_s", ignorenulls=True).over(so_far), F.coalesce(F.last(other, ignorenulls=True).over(so_far), F.lit(False))


def _status(log: DataFrame, order: str) -> DataFrame:
    """With ``_ot`` and ``_src``, the source's text before and the number of its sighting: what looks at sources comes first, so rows are shuffled once and sorted twice."""
    src = Window.partitionBy("property_id", "source_id").orderBy(order)
    all_ = Window.partitionBy("property_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    shown = F.col("visible").cast("int")
    out = log.repartition("property_id").withColumns({
        "_d": F.when(F.col("verifies"), shown - F.coalesce(shown_before(shown, src), F.lit(0))).otherwise(0), "_ot": F.lag("text_hash").over(src) if "text_hash" in log.columns else F.lit(None), "_src": F.row_number().over(src),
    })
    out = out.withColumn("_n", F.sum("_d").over(all_))
    out = out.withColumn("_s", F.when(F.col("verifies") & F.col("visible"), "active").when(F.col("verifies") & (F.col("_n") == 0), "removed"))
    base, revived = decided(all_)
    out = out.withColumns({"_b": base, "_r": revived})
    return out.withColumn("status", F.when(F.col("_b").isNull() | (F.col("_b").isin(*DORMANT) & F.col("_r")), "discovered").otherwise(F.col("_b"))).drop("_d", "_n", "_s", "_b", "_r")


def change_kinds(log: DataFrame, order: str = "seq") -> DataFrame:
    """Journal of changes: property_id, seq, ts, old_status, new_status, change_kind; a revival with a price move is journaled twice."""
    w = Window.partitionBy("property_id").orderBy(order)
    s = _status(log, order).withColumn("_p", running_fact("price", order))
    s = s.withColumns({"old_status": F.lag("status").over(w), "_op": F.lag("_p").over(w), "_rn": F.row_number().over(w)})
    first, removed = F.col("_rn") == 1, (F.col("status") == "removed") & (F.col("old_status") != "removed")
    priced = F.col("_op").isNotNull() & (F.abs(F.col("_p") - F.col("_op")) >= LEAST_MOVE)
    revived = F.col("old_status").isin(*DORMANT) & ~F.col("status").isin(*DORMANT)
    main = (
        F.when(first, "first_seen").when(removed, "removed").when(priced, "price_change").when(revived, "reactivated").when(F.col("_src") == 1, "source_change")
        .when(F.col("_ot").isNotNull() & F.col("text_hash").isNotNull() & (F.col("_ot") != F.col("text_hash")), "description_change").when(F.col("status") != F.col("old_status"), "status_change")
    )
    kinds = F.array_compact(F.array(F.when(priced & revived & ~first & ~removed, "reactivated"), main))
    return s.select("property_id", order, "ts", "old_status", F.col("status").alias("new_status"), F.explode(kinds).alias("change_kind"))


def prices_as_of(events: DataFrame, prices: DataFrame, key: str = "property_id") -> DataFrame:
    """Each event (key, at, event_id) with the last price row (key, ts, price_id, ...) at or before it; events without one stay.

    Union and a running last value: one shuffle on the key and no range join, however many prices a key has.
    """
    cols = [c for c in prices.columns if c not in (key, "ts")]
    e = events.select(key, F.col("at").alias("_t"), F.lit(1).alias("_k"), F.struct(*events.columns).alias("_e"), F.lit(None).cast(prices.select(F.struct(*cols)).schema[0].dataType).alias("_p"), F.lit(None).cast("long").alias("_i"))
    p = prices.select(key, F.col("ts").alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast(e.schema["_e"].dataType).alias("_e"), F.struct(*cols).alias("_p"), F.col("price_id").cast("long").alias("_i"))
    w = Window.partitionBy(key).orderBy("_t", "_k", "_i").rowsBetween(Window.unboundedPreceding, 0)
    out = e.unionByName(p).withColumn("_p", F.last("_p", ignorenulls=True).over(w)).filter("_k = 1")
    return out.select("_e.*", *[F.col(f"_p.{c}").alias(c) for c in cols])


def changes_since(journal: DataFrame, prices: DataFrame, props: DataFrame, since: Column, kinds: list[str] | None = None) -> DataFrame:
    """The change feed, newest first, with the price move as of each change."""
    j = journal.filter(F.col("ts") >= since)
    if kinds is not None:
        j = j.filter(F.col("change_kind").isin(*kinds))
    j = j.withColumnRenamed("ts", "at")
    j = j if "event_id" in j.columns else j.withColumnRenamed("seq", "event_id")
    prices = prices if "price_id" in prices.columns else prices.withColumnRenamed("seq", "price_id")
    # Written first: a sort samples what it sorts, and would fold the log twice.
    out = materialise(prices_as_of(j, prices).join(props, "property_id"), "feed")
    return out.orderBy(F.col("at").desc(), F.col("event_id").desc())


def source_rows(log: DataFrame, order: str = "seq") -> DataFrame:
    """One row per property, source and URL: first and last sighting, latest visibility and contact."""
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return log.groupBy("property_id", "source_id", "url").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("visible", order).alias("visible"), F.max_by("verifies", order).alias("verifies"), latest("contact_kind"))


def assign_best(rows: DataFrame) -> DataFrame:
    """Mark one row per property: role rank, reliability, last sighting, then the smaller source."""
    rank = F.when(F.col("role") == "primary", 2).when(F.col("role") == "local", 1).otherwise(0)
    w = Window.partitionBy("property_id").orderBy(rank.desc(), F.col("reliability").desc_nulls_last(), F.col("last_seen").desc_nulls_last(), F.col("source_id").asc())
    return rows.withColumn("is_best", F.row_number().over(w) == 1)


def mark_missing(rows: DataFrame, seen: DataFrame, runs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """What a run proves absent.

    ``rows``: property_id, source_id, visible, first_seen, status (of the property).  ``seen``: property_id, source_id.
    ``runs``: source_id, can_verify, complete, ttl_days (null: none).  Returns the transitions (property_id, source_id,
    new_status: expired, removed, or null where another verifying source still shows it) and the refusals (source_id, reason).  All
    guards are decided before any transition, as data: nothing seen refuses; at least three shown rows of which at least two and 30 percent are
    missing unexpired refuse.
    """
    shown = rows.filter("visible").join(runs.filter("can_verify and complete"), "source_id")
    some = seen.select("source_id", "property_id").distinct()
    marked = shown.join(some.withColumn("_s", F.lit(1)), ["source_id", "property_id"], "left").withColumn("missing", F.col("_s").isNull()).drop("_s")
    # fields of the run's own lifetime rule
    old = F.coalesce((F.col("ttl_days") > 0) & (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp")) >= F.col("ttl_days") * F.lit(86_400_000_000)), F.lit(False))
    marked = marked.withColumn("expired", F.col("missing") & old)
    per = marked.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("missing")).alias("seen"), F.count_if(F.col("missing") & ~F.col("expired")).alias("gone"))
    reason = F.when(F.col("seen") == 0, "nothing_seen").when((F.col("n") >= 3) & (F.col("gone") >= 2) & (F.col("gone") >= 0.3 * F.col("n")), "too_many_missing")
    judged = per.select("source_id", reason.alias("reason"))
    lost = marked.filter("missing").join(judged.filter("reason is null").select("source_id"), "source_id")
    verify = runs.filter("can_verify").select("source_id")
    still = rows.filter("visible").join(verify, "source_id").join(lost.select("source_id", "property_id"), ["source_id", "property_id"], "left_anti").select("property_id").distinct().withColumn("_o", F.lit(1))
    out = lost.join(still, "property_id", "left")
    status = F.when(F.col("_o").isNotNull() | (F.col("status") == "removed"), F.lit(None)).when(F.col("expired"), "expired").otherwise("removed")
    return out.select("property_id", "source_id", "expired", status.alias("new_status")), judged.filter("reason is not null")


def stale(props: DataFrame, rows: DataFrame, non_reporting: list[int], now: Column, days: int = 45, unverified_days: int = 180) -> DataFrame:
    """Properties whose last sighting is too old: 45 days where a source reports on its own, else 180."""
    reports = rows.groupBy("property_id").agg(F.bool_or(~F.col("source_id").isin(*non_reporting) if non_reporting else F.lit(True)).alias("reports"))
    out = props.filter(F.col("listing_status").isin(*ELIGIBLE_FOR_STALE)).join(reports, "property_id", "left")
    limit = F.when(F.coalesce("reports", F.lit(False)), days).otherwise(unverified_days)
    return out.filter(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp")) > limit * F.lit(86_400_000_000)).select("property_id", "listing_status", F.lit("stale").alias("new_status"))


def repair_removals(props: DataFrame, journal: DataFrame, non_reporting: list[str]) -> DataFrame:
    """Removed properties whose last removal names a source (``source=...``) that proves nothing: with the status to restore."""
    last = journal.filter("new_status = 'removed'").groupBy("property_id").agg(F.max_by(F.struct("old_status", "detail"), F.struct("ts", "seq")).alias("r"))
    out = props.filter("listing_status = 'removed'").join(last, "property_id")
    key = F.regexp_extract("r.detail", r"source=(\S+)", 1)
    return out.filter(key != "").select("property_id", key.alias("source_key"), F.coalesce("r.old_status", F.lit("active")).alias("restored_status"), key.isin(*non_reporting).alias("restorable"))


def resolve_merges(links: DataFrame) -> DataFrame:
    """``links``: property_id, merged_into_id.  Each merged property with the survivor at the end of its chain.

    Pointer doubling: the number of joins is the logarithm of the longest chain.  A cycle ends at its smallest id.
    """
    from .links import double_pointers

    return double_pointers(links)


def delete_property(tables: dict[str, DataFrame], property_id: int) -> dict[str, DataFrame]:
    """The tables without the property's rows; refused while others are merged into it."""
    props = tables["property"]
    if "merged_into_id" in props.columns and not props.filter(F.col("merged_into_id") == property_id).isEmpty():
        raise ValueError("other properties are merged into this one")
    return {name: t.filter(~F.coalesce(F.col("property_id") == property_id, F.lit(False))) for name, t in tables.items()}


def dependent_rows(tables: dict[str, DataFrame], property_id: int) -> DataFrame:
    counts = [t.filter(F.col("property_id") == property_id).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows")) for name, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out
