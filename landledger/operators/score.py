"""Component scores, gates and ranking under a profile.

``props`` has the columns of ``schemas.PROPERTY`` (one row per property) and, for what its sources say, the columns that
``source_facts`` adds.  Every function is one projection: nothing is shuffled until rows are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import below, points_of, up_to
from ..functions.dates import days_since
from ..functions.text import contains_any, fold
from ..search_profile import Profile
from .cost import estimate_costs, tags_text, with_folded

# Bands as fractions of a slider, points, and the words that earn them.
GEOGRAPHY = ((30 / 80, 15.0), (50 / 80, 13.0), (65 / 80, 10.0), (1.0, 6.0))
PRICE = ((400_000 / 750_000, 20.0), (550_000 / 750_000, 18.0), (650_000 / 750_000, 16.0), (1.0, 13.0))
NEGOTIATION = 5.0
LAND = ((0.5, 0.0), (1.0, 5.0), (2.0, 10.0), (4.0, 13.0))
LAND_TOP = 15.0
CORE = ("sacherl", "hofstelle", "hofanwesen", "bauernhof", "resthof", "vierseithof", "dreiseithof", "einoedhof", "einfirsthof", "landwirtschaftliches anwesen", "aussiedlerhof", "austragshaus")
HISTORIC = ("denkmal", "historisch", "historische bausubstanz", "jahrhundertwende", "fachwerk", "blockbau", "ensembleschutz", "bauernhaus von")
HISTORIC_YEAR = 1900
BARN, STABLE = ("stadl", "stadel", "scheune", "scheuer"), ("stall", "tenne", "kuhstall", "pferdestall")
ALONE = ("alleinlage", "einoede", "einoedhof", "einzellage", "solitaerlage", "abgeschiedene lage", "keine nachbarn", "freie feldlage")
EDGE = ("ortsrand", "ortsrandlage", "randlage", "am dorfrand")
LOOSE = ("weiler", "streusiedlung", "aufgelockerte bebauung", "lockere bebauung", "einzelgehoeft", "kleiner ortsteil")
PROVABLE = ("teilungsgenehmigung", "teilung genehmigt", "grundstueck ist geteilt", "zwei bauplaetze", "zwei baugrundstuecke", "zweites baufenster", "baugenehmigung liegt vor", "positiver bauvorbescheid")
BUILDING_LAW = ("bebauungsplan", "b plan", "34 baugb", "35 baugb", "bauvorbescheid", "baugenehmigung", "baurecht", "innenbereich", "flaechennutzungsplan")
PLAUSIBLE = ("entwicklungspotenzial", "entwicklungsmoeglichkeit", "teilbar", "teilung moeglich", "erweiterbar", "ausbaureserve", "bauerwartungsland", "nachverdichtung", "potenzial")
EVIDENCE_KEYS = ("divisible", "teilbar", "teilung", "baurecht")
SHEDS = (("scheune", "stadl", "stadel", "scheuer"), ("stall",), ("tenne",))
SHED_POINTS = (0.0, 4.0, 7.0, 10.0)
TOTAL_COST = ((0.75, 40.0), (0.90, 34.0), (1.00, 28.0))
EXCEPTIONAL_POINTS, HARD_POINTS, REFERENCE_LIVING, UNKNOWN_SHARE, EXTREME_CAP, MODERATE = 14.0, 6.0, 200.0, 0.4, 10.0, 0.90
PER_SQM = ((0.40, 1.00), (0.70, 0.80), (1.00, 0.55), (1.50, 0.25))
RENOVATION = ((0.25, 1.00), (0.50, 0.80), (0.75, 0.50), (1.00, 0.20))
CHIFFRE = ("chiffre", "zuschriften unter", "chiffre nr")
NO_BROKER = ("kein makler", "provisionsfrei", "ohne makler", "maklerfrei", "von privat", "privatverkauf")
FRESHNESS = ((7, 100.0), (14, 90.0), (30, 75.0), (60, 50.0), (90, 30.0), (180, 10.0))
LONG_ONLINE, STALE_ONLINE, STALE_PENALTY = 180, 730, 10.0
ROLE_FACTOR = {"primary": 1.00, "local": 0.85, "discovery": 0.55}
PRECISION_POINTS = {"exact": 100.0, "street": 85.0, "town": 55.0, "postcode": 35.0, "none": 0.0}
PRICE_TYPE_POINTS = {"asking": 100.0, "negotiable": 80.0, "auction_min": 70.0, "on_request": 35.0, "rent": 0.0, "unknown": 0.0}
AVAILABILITY = ((30, 100.0), (90, 60.0))
CONFIDENCE_WEIGHTS = (0.30, 0.20, 0.20, 0.15, 0.10, 0.05)
UNROUTED_CAP = 65.0
REVIEW = ("needs_review", "needs review", "merge_review")
EXCLUDED_TYPES = ("eigentumswohnung", "doppelhaushaelfte", "reihenhaus", "neubau", "wohnung")
GONE = ("removed", "sold")


def text_of(*more: Column) -> Column:
    """Folded tags, title, type and description, parted so that no term spans two of them.  Needs ``with_folded``."""
    return F.concat_ws(" | ", *tags_text(" | "), fold(F.col("title")), fold(F.col("property_type")), fold(F.col("description")), *more)


def source_facts(property_source: DataFrame, source: DataFrame) -> DataFrame:
    """One row per property: what its sources are and say.  ``source`` is a small dimension; the planner broadcasts it by its size."""
    verify = F.col("role").isin("primary", "local")
    rows = property_source.join(source.select("source_id", "role", "reliability"), "source_id")
    kind = F.lower("contact_kind")
    return rows.groupBy("property_id").agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.coalesce(F.bool_or(kind == "private"), F.lit(False)).alias("private_contact"),
        F.coalesce(F.bool_or(kind == "broker"), F.lit(False)).alias("broker_contact"),
        F.coalesce(F.bool_or(F.coalesce(kind, F.lit("")) != ""), F.lit(False)).alias("any_contact"),
        F.coalesce(F.bool_or((kind == "private") & (F.coalesce("contact_detail", F.lit("")) != "")), F.lit(False)).alias("owner_contact"),
        F.coalesce(F.bool_or((F.col("role") == "local") & (F.coalesce("reliability", F.lit(0.0)) <= 0.75)), F.lit(False)).alias("small_local"),
        F.coalesce(F.bool_or(verify), F.lit(False)).alias("verifying"),
        F.max(F.when(verify, F.col("source_date"))).alias("verified_date"),
        F.max(F.struct("is_best", verify.alias("v"), F.coalesce("reliability", F.lit(0.0)).alias("reliability"), (-F.col("source_id")).alias("i"), "role")).alias("best"),
    ).withColumns({"best_reliability": F.col("best.reliability"), "best_role": F.col("best.role")}).drop("best")


def fit_columns(profile: Profile) -> dict[str, Column]:
    """The seven components, from the columns of a property and ``_text``."""
    t, b = F.col("_text"), profile.budget
    price, land = F.col("price"), F.col("land_sqm")
    historic = F.coalesce(F.col("is_monument"), F.lit(False)) | contains_any(t, HISTORIC) | F.coalesce(F.col("year_built") < HISTORIC_YEAR, F.lit(False))
    substance = F.when(contains_any(t, CORE), 10.0).otherwise(0.0) + F.when(historic, 5.0).otherwise(0.0) + F.when(contains_any(t, BARN), 3.0).otherwise(0.0) + F.when(contains_any(t, STABLE), 2.0).otherwise(0.0)
    proof = F.exists(F.coalesce(F.col("evidence_keys"), F.array().cast("array<string>")), lambda k: contains_any(F.lower(k), EVIDENCE_KEYS))
    development = F.when(contains_any(t, PROVABLE) | (contains_any(t, PLAUSIBLE) & proof), 10.0).when(contains_any(t, BUILDING_LAW), 7.0).when(contains_any(t, PLAUSIBLE), 4.0).otherwise(0.0)
    sheds = sum((F.when(contains_any(t, s), 1).otherwise(0) for s in SHEDS), F.lit(0))
    return {
        "fit_geography": F.when(F.col("air_km").isNotNull(), up_to(F.col("air_km") / profile.radius.air_km_max, GEOGRAPHY)).otherwise(0.0),
        "fit_price": F.when(price != 0, up_to(price / b.purchase_target, (*PRICE, (b.purchase_negotiation / b.purchase_target, NEGOTIATION)))).otherwise(0.0),
        "fit_land": F.when(land != 0, below(land / profile.land_preferred, LAND, LAND_TOP)).otherwise(0.0),
        "fit_substance": substance,
        "fit_seclusion": F.when(contains_any(t, ALONE), 10.0).when(contains_any(t, EDGE), 7.0).when(contains_any(t, LOOSE), 4.0).otherwise(1.0),
        "fit_development": development,
        "fit_outbuildings": F.element_at(F.array(*map(F.lit, SHED_POINTS)), sheds + 1),
    }


FIT = ("fit_geography", "fit_price", "fit_land", "fit_substance", "fit_seclusion", "fit_development", "fit_outbuildings")


def with_fit(props: DataFrame, profile: Profile) -> DataFrame:
    out = props if "_text" in props.columns else with_folded(props).withColumn("_text", text_of())
    out = out.withColumns(fit_columns(profile))
    return out.withColumn("fit_score", F.round(sum((F.col(c) for c in FIT[1:]), F.col(FIT[0])), 2))


def with_deal(costed: DataFrame, profile: Profile) -> DataFrame:
    """Needs the columns of ``estimate_costs``.  Adds four components, capital_risk, deal_flags and deal_score."""
    b, total = profile.budget, F.col("total_mid")
    ratio = total / b.total_max
    price = F.when(F.col("price") != 0, F.col("price"))
    cost = F.when(total > b.total_hard_max, 0.0).otherwise(up_to(ratio, (*TOTAL_COST, (b.total_exceptional / b.total_max, EXCEPTIONAL_POINTS), (b.total_hard_max / b.total_max, HARD_POINTS))))

    def per_sqm(area: str, reference: float) -> Column:
        size = F.when(F.col(area) != 0, F.col(area))
        return F.when(price.isNotNull() & size.isNotNull(), 20.0 * up_to(price / size / reference, PER_SQM)).otherwise(20.0 * UNKNOWN_SHARE)

    share = F.col("renovation_mid") / F.when(F.col("purchase_price") > 0, F.col("purchase_price"))
    risky = F.coalesce(share > profile.gates.renovation_risk_ratio, F.lit(False))
    plain = F.when(total > b.total_hard_max, "extreme").when(total > b.total_max, "high").when(ratio > MODERATE, "moderate").otherwise("low")
    out = costed.withColumns({
        "deal_cost": cost,
        "deal_land": per_sqm("land_sqm", b.purchase_target / profile.land_strong),
        "deal_living": per_sqm("living_sqm", b.purchase_target / REFERENCE_LIVING),
        "deal_renovation": F.when(share.isNotNull(), 20.0 * up_to(share / profile.gates.renovation_risk_ratio, RENOVATION)).otherwise(20.0 * UNKNOWN_SHARE),
        "capital_risk": F.when(risky & plain.isin("low", "moderate"), "high").otherwise(plain),
        "deal_flags": F.array_compact(F.array(
            F.when(total > b.total_max, "OVER_BUDGET"), F.when((total > b.total_exceptional) & (total <= b.total_hard_max), "EXCEPTIONAL_BUDGET_BAND"), F.when(risky, "SANIERUNGSRISIKO"),
        )),
    })
    raw = F.col("deal_cost") + F.col("deal_land") + F.col("deal_living") + F.col("deal_renovation")
    return out.withColumn("deal_score", F.round(F.when(F.col("capital_risk") == "extreme", F.least(raw, F.lit(EXTREME_CAP))).otherwise(raw), 2))


def _or_false(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def online_days(now: Column) -> Column:
    return F.greatest(days_since(F.col("first_seen"), now), days_since(F.col("source_date"), now))


def with_hidden(props: DataFrame, now: Column) -> DataFrame:
    """Needs ``source_facts``, ``with_folded`` and ``_text``.  Adds hidden_score, is_stale and ``_online``."""
    props = props.withColumn("_online", online_days(now))
    t, online = F.col("_text"), F.col("_online")
    kind = F.col("_folded_price_type")
    signals = [
        (_or_false("is_private_seller") | _or_false("private_contact"), 15.0), (kind == "negotiable", 8.0), (kind == "on_request", 8.0), (online >= LONG_ONLINE, 10.0), (online >= STALE_ONLINE, -STALE_PENALTY),
        (F.coalesce(F.col("price_reduction_count"), F.lit(0)) >= 2, 12.0), ((F.coalesce(F.col("n_images"), F.lit(0)) <= 2) & (F.length(F.coalesce(F.col("description"), F.lit(""))) < 400), 5.0),
        (_or_false("small_local"), 8.0), (contains_any(t, CHIFFRE), 15.0), (~_or_false("broker_contact") & (contains_any(t, NO_BROKER) | _or_false("any_contact")), 5.0),
        (_or_false("owner_contact"), 10.0), (_or_false("is_foreclosure"), 15.0), (_or_false("is_off_market_signal"), 20.0),
    ]
    raw = sum((F.when(test, points).otherwise(0.0) for test, points in signals), F.lit(0.0))
    return props.withColumns({"hidden_score": F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)), 2), "is_stale": F.coalesce(online >= STALE_ONLINE, F.lit(False))})


def with_freshness(props: DataFrame, now: Column) -> DataFrame:
    """From the latest date that evidence stands behind; a crawl never makes a listing fresh.  Needs ``_online``."""
    proved = F.when(_or_false("verifying") & F.col("verification_status").isin("verified", "conflicting"), F.col("last_verified"))
    # Dates and days stand as columns, so that they aren't worked out again for each band.
    props = props.withColumn("best_evidence_date", F.greatest(F.col("source_date"), proved, F.when(_or_false("verifying"), F.col("verified_date"))))
    props = props.withColumn("_age", days_since(F.col("best_evidence_date"), now))
    best, base = F.col("best_evidence_date"), up_to(F.col("_age"), FRESHNESS)
    score = F.when(best.isNull(), 0.0).when(F.col("_online") >= STALE_ONLINE, F.greatest(F.lit(0.0), base - STALE_PENALTY)).otherwise(base)
    dates = {"source date": F.col("source_date"), "verified": proved, "source row": F.when(_or_false("verifying"), F.col("verified_date"))}
    named = F.coalesce(*[F.when(best.cast("timestamp") == c.cast("timestamp"), F.lit(n)) for n, c in dates.items()])
    return props.withColumns({"best_evidence": named, "freshness_score": F.round(score, 2), "no_evidence_date": best.isNull()}).drop("_age")


def with_confidence(props: DataFrame, now: Column) -> DataFrame:
    role = points_of(F.col("best_role"), ROLE_FACTOR, ROLE_FACTOR["discovery"])
    source = F.when(F.col("best_role").isNotNull(), 100.0 * F.coalesce(F.col("best_reliability"), F.lit(0.0)) * role).otherwise(0.0)
    checked = days_since(F.col("last_verified"), now)
    proved = fold(F.col("verification_status")).isin("verified", "conflicting") | _or_false("verifying")
    available = F.when(F.col("listing_status").isin(*GONE), 0.0).when(checked.isNull() | ~proved, 0.0).otherwise(up_to(checked, AVAILABILITY, 25.0))
    there = [F.col("price") != 0, F.col("land_sqm") != 0, F.col("living_sqm") != 0, F.col("year_built") != 0, F.col("condition") != "", F.col("property_type") != "", F.col("town") != "", F.col("lat") != 0, F.col("description") != ""]
    complete = 100.0 * sum((F.when(F.coalesce(t, F.lit(False)), 1).otherwise(0) for t in there), F.lit(0)) / len(there)
    n = F.coalesce(F.col("n_sources"), F.lit(0))
    twins = F.when(n >= 2, 100.0).when(n == 1, 70.0).otherwise(40.0)
    review = contains_any(F.col("_text"), REVIEW) | contains_any(F.col("_folded_user_state"), REVIEW)
    parts = [source, available, points_of(fold(F.col("geo_precision")), PRECISION_POINTS), points_of(F.col("_folded_price_type"), PRICE_TYPE_POINTS), complete, F.when(review, F.least(twins, F.lit(40.0))).otherwise(twins)]
    total = sum((w * p for w, p in zip(CONFIDENCE_WEIGHTS, parts, strict=True)), F.lit(0.0))
    return props.withColumn("confidence_score", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)), 2))


def triage(p_rent: Column, p_flat: Column, p_sale: Column, p_house: Column, sheds: Column, threshold: float) -> tuple[Column, Column]:
    """(reason to reject or null, flags) of a second opinion's probabilities."""
    reason = F.when(p_rent >= threshold, "TRIAGE_SAYS_RENTAL").when((p_flat >= threshold) & ~sheds, "TRIAGE_SAYS_FLAT")
    flags = F.array_compact(F.array(F.when(p_rent > p_sale, "TRIAGE_RENT_LIKELY"), F.when(p_flat > p_house, "TRIAGE_FLAT_LIKELY")))
    return reason, flags


def with_gates(scored: DataFrame, profile: Profile) -> DataFrame:
    """Add reject_reasons, flags, rejected and shortlist_blocked."""
    g, b, r = profile.gates, profile.budget, profile.radius
    total, drive, price = F.col("total_mid"), F.col("driving_km"), F.col("price")
    carve = F.col("fit_development") >= g.exceptional_development
    guess = F.col("renovation_evidence") == "inferred"
    over_hard, over_band = total > b.total_hard_max, (total > b.total_exceptional) & (total <= b.total_hard_max)
    unrouted = drive.isNull() & F.lit(r.require_driving_check)
    sheds = F.size(F.coalesce(F.col("outbuildings"), F.array().cast("array<string>"))) > 0
    kind = F.lower(F.trim(F.coalesce(F.col("property_type"), F.lit(""))))
    farm = sheds | ((kind != "") & ~kind.isin(*EXCLUDED_TYPES))
    excluded = (F.size(F.coalesce(F.col("exclusion_flags"), F.array().cast("array<string>"))) > 0) & F.lit(g.reject_excluded)
    reasons = F.array_compact(F.array(
        F.when(F.col("air_km") > r.air_km_max, "AIR_DISTANCE_OVER_LIMIT"), F.when(drive > r.effective_hard, "DRIVING_DISTANCE_OVER_LIMIT"), F.when(unrouted & F.lit(g.reject_unrouted), "DRIVING_UNVERIFIED"),
        F.when((price != 0) & (price > b.purchase_hard_max), "PRICE_OVER_HARD_MAX"), F.when(over_hard & ~carve & ~guess, "TOTAL_COST_OVER_HARD_MAX"), F.when(over_band & ~carve & ~guess, "EXCEPTIONAL_BUDGET_WITHOUT_DEVELOPMENT"),
        F.when(F.col("confidence_score") < g.keep_confidence, "OBSERVATION_ONLY"), F.when(F.col("listing_status").isin(*GONE) & F.lit(g.reject_removed), "LISTING_REMOVED_OR_SOLD"),
        F.when(excluded & ~farm, "EXCLUDED_PROPERTY_TYPE"), F.when(F.lower("price_type") == "rent", "RENTAL_NOT_FOR_SALE"), F.col("triage_reason") if "triage_reason" in scored.columns else F.lit(None).cast("string"),
    ))
    flags = F.array_compact(F.array(
        F.when(F.col("is_stale"), "STALE_LISTING"), F.when(F.col("no_evidence_date"), "NO_EVIDENCE_DATE"), F.when(unrouted & ~F.lit(g.reject_unrouted), "DRIVING_UNVERIFIED"),
        F.when((over_hard | over_band) & carve, "EXCEPTIONAL_DEVELOPMENT_CARVE_OUT"), F.when((over_hard | over_band) & ~carve & guess, "TOTAL_COST_INFERRED"), F.when(excluded & farm, "EXCLUSION_OVERRIDDEN_BY_SUBSTANCE"),
        F.when(F.col("confidence_score") < g.shortlist_confidence, "SHORTLIST_BLOCKED"),
    ))
    out = scored.withColumns({"reject_reasons": reasons, "flags": F.array_distinct(F.concat(F.col("deal_flags"), flags))})
    return out.withColumns({"rejected": F.size("reject_reasons") > 0, "shortlist_blocked": F.col("confidence_score") < g.shortlist_confidence})


def score_properties(props: DataFrame, facts: DataFrame, profile: Profile, now: Column) -> DataFrame:
    """Everything for one profile: costs, five scores, final_score, gates and profile_hash."""
    out = with_folded(props.join(facts, "property_id", "left")).withColumn("_text", text_of())
    out = with_deal(estimate_costs(with_fit(out, profile), profile), profile)
    out = with_confidence(with_freshness(with_hidden(out, now), now), now)
    capped = F.col("driving_km").isNull() & F.lit(profile.radius.require_driving_check)
    out = out.withColumn("confidence_score", F.when(capped, F.least(F.col("confidence_score"), F.lit(UNROUTED_CAP))).otherwise(F.col("confidence_score")))
    w = profile.weights
    final = w.fit * F.col("fit_score") + w.deal * F.col("deal_score") + w.hidden * F.col("hidden_score") + w.freshness * F.col("freshness_score") + w.confidence * F.col("confidence_score")
    out = with_gates(out.withColumn("final_score", F.round(final, 2)), profile).withColumns({"profile_hash": F.lit(profile.profile_hash), "_row": F.monotonically_increasing_id()})
    # Filters and sort keys can't move below a row number; there they would write out the scores' expressions again, once for each use.
    return out.filter("_row >= 0").drop("_row", "_text", "_online", *[c for c in out.columns if c.startswith("_folded_")])


#: Filters that a ranking takes; others are refused.
FILTERS = ("town", "min_land_sqm", "max_price", "status", "user_state", "verified_only", "has_outbuildings", "flags", "q", "shortlisted")


def apply_filters(scored: DataFrame, **filters) -> DataFrame:
    unknown = set(filters) - set(FILTERS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    from ..functions.text import matches_search

    tests: list[Column] = []
    f = {k: v for k, v in filters.items() if v is not None}
    if "town" in f:
        names = [f["town"]] if isinstance(f["town"], str) else list(f["town"])
        tests.append(fold(F.col("town")).isin(*[n.lower().replace("ß", "ss").replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("-", " ") for n in names]))
    if "min_land_sqm" in f:
        tests.append(F.col("land_sqm") >= f["min_land_sqm"])
    if "max_price" in f:
        tests.append(F.col("price") <= f["max_price"])
    if "status" in f:
        tests.append(~F.col("listing_status").isin(*GONE) if f["status"] == "alive" else F.col("listing_status") == f["status"])
    if "user_state" in f:
        states = [f["user_state"]] if isinstance(f["user_state"], str) else list(f["user_state"])
        tests.append(F.coalesce(F.col("user_state"), F.lit("none")).isin(*states))
    if f.get("verified_only"):
        tests.append(F.col("verification_status") == "verified")
    if f.get("has_outbuildings"):
        tests.append(F.size(F.coalesce(F.col("outbuildings"), F.array().cast("array<string>"))) > 0)
    if "flags" in f:
        tests.append(F.size(F.array_except(F.array(*map(F.lit, f["flags"])), F.col("flags"))) == 0)
    if "q" in f:
        tests.append(matches_search(f["q"], *[F.col(c) for c in ("town", "postcode", "district", "title", "user_title") if c in scored.columns]))
    if f.get("shortlisted"):
        tests.append(F.col("shortlisted_at").isNotNull())
    for t in tests:
        scored = scored.filter(F.coalesce(t, F.lit(False)))
    return scored


def not_hidden() -> Column:
    """Archived rows go, rows without a state stay."""
    return F.col("user_state").isNull() | ~F.col("user_state").isin("archived")


def passes_profile(profile: Profile) -> Column:
    """The sliders: unknown passes."""
    over = [F.col("air_km") > profile.radius.air_km_max, F.col("price") > profile.budget.purchase_hard_max, F.col("total_mid") > profile.budget.total_hard_max]
    return ~F.coalesce(over[0], F.lit(False)) & ~F.coalesce(over[1], F.lit(False)) & ~F.coalesce(over[2], F.lit(False))


def ranked(scored: DataFrame, limit: int | None = None, include_rejected: bool = False, **filters) -> DataFrame:
    """Shortlist candidates first, then the best final score, then the smaller id; with a limit a top-k, not a full sort."""
    rows = apply_filters(scored.filter(not_hidden()), **filters)
    if not include_rejected:
        rows = rows.filter(~F.col("rejected"))
    rows = rows.orderBy(F.col("shortlist_blocked").asc(), F.col("final_score").desc(), F.col("property_id").asc())
    return rows.limit(limit) if limit is not None else rows


WEB_SORTS = {
    "score": lambda: (F.col("final_score").desc_nulls_last(),),
    "price": lambda: (F.col("price").asc_nulls_last(),),
    "distance": lambda: (F.col("air_km").asc_nulls_last(),),
    "newest": lambda: (F.col("first_seen").desc_nulls_last(),),
    "drop": lambda: (F.col("price_delta_pct").asc_nulls_last(),),
}


def web_sorted(rows: DataFrame, by: str, limit: int = 60) -> DataFrame:
    return rows.orderBy(*WEB_SORTS[by](), F.col("property_id").asc()).limit(min(limit, 500))


def stored_scores(props: DataFrame, scores: DataFrame, profile_hash: str) -> DataFrame:
    """Properties with the scores that are kept for a profile; those without one are left out."""
    own = scores.filter(F.col("profile_hash") == profile_hash)
    return props.drop(*[c for c in own.columns if c != "property_id"]).join(own, "property_id")


def dirty(props: DataFrame, scores: DataFrame, costs: DataFrame, profile_hash: str) -> DataFrame:
    """Properties whose score or cost is missing, or older than their last update."""
    s = scores.filter(F.col("profile_hash") == profile_hash).select("property_id", F.col("updated_at").alias("_s"))
    c = costs.select("property_id", F.lit(True).alias("_c"))
    out = props.join(s, "property_id", "left").join(c, "property_id", "left")
    return out.filter(F.col("_s").isNull() | F.col("_c").isNull() | (F.col("_s") < F.col("updated_at"))).drop("_s", "_c")


def rescore_all(props: DataFrame, facts: DataFrame, profile: Profile, now: Column, scores: DataFrame | None = None, costs: DataFrame | None = None) -> DataFrame:
    """Scores of all properties, or of the dirty ones where the kept tables are given; ``updated_at`` is ``now``.

    ``report.write_scores`` keeps a scoring of all properties; dirty rows are appended to a ``score_store.ScoreStore``, where clean ones stay.
    """
    todo = props if scores is None or costs is None else dirty(props, scores, costs, profile.profile_hash)
    return score_properties(todo, facts, profile, now).withColumn("updated_at", now)


def flat_breakdown(rows: DataFrame, struct: str, key: str = "property_id") -> DataFrame:
    """key, path, value: one row per leaf of a nested struct, its names joined; a list of plain values is one leaf."""
    from pyspark.sql.types import ArrayType, StructType

    def leaves(kind: StructType, at: Column, path: str) -> list[Column]:
        out: list[Column] = []
        for f in kind.fields:
            name, c = f"{path} › {f.name}" if path else f.name, at[f.name]
            if isinstance(f.dataType, StructType):
                out += leaves(f.dataType, c, name)
            else:
                value = F.array_join(F.transform(c, lambda x: x.cast("string")), ", ") if isinstance(f.dataType, ArrayType) else c.cast("string")
                out.append(F.struct(F.lit(name).alias("path"), value.alias("value")))
        return out

    return rows.select(key, F.inline(F.array(*leaves(rows.schema[struct].dataType, F.col(struct), ""))))
