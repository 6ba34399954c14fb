"""Renovation tier and cost of ownership under a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, fold
from ..search_profile import Profile

# Which words speak for which tier, and typical sizes.
COMPLETE = ("abrissreif", "abbruchreif", "entkernt", "kernsanierung", "ruine", "unbewohnbar", "rohbau")
HEAVY = ("sanierungsbeduerftig", "sanierungsbedarf", "handwerkerobjekt", "unsaniert", "nicht saniert", "grundlegend zu sanieren", "feuchtigkeitsschaden", "hausschwamm")
MEDIUM = ("renovierungsbeduerftig", "renovierungsbedarf", "modernisierungsbedarf", "instandsetzungsbedarf")
LIGHT = ("kernsaniert", "vollsaniert", "saniert", "neuwertig", "modernisiert", "renoviert", "bezugsfertig", "erstbezug nach sanierung")
CONDITIONS = {"good": 0, "gut": 0, "gepflegt": 0, "neuwertig": 0, "saniert": 0, "fair": 1, "mittel": 1, "durchschnittlich": 1, "bad": 2, "schlecht": 2, "desolat": 2, "abbruch": 3}
NO_CONDITION = ("", "unknown", "unbekannt", "conflicting")
TIERS = ("light", "medium", "heavy", "complete")
OUTBUILDING_SQM = {"scheune": 200.0, "stadel": 180.0, "stadl": 180.0, "stall": 150.0, "tenne": 120.0, "remise": 60.0, "schuppen": 60.0, "wagenremise": 60.0, "garage": 40.0}
OTHER_OUTBUILDING_SQM, LIVING_SQM, USABLE_SHARE, STOREYS, ROOF_FACTOR = 100.0, 180.0, 0.45, 1.6, 1.5

TAGS = ("building_features", "outbuildings", "special_features", "exclusion_flags")
#: Texts that are read folded more than once.
TEXTS = ("condition", "price_type", "user_state")


def known(c: Column) -> Column:
    """Zero counts as unknown."""
    return F.when(c > 0, c)


def with_folded(props: DataFrame) -> DataFrame:
    """Add tags and texts as ``_folded_`` columns: folded once, however many terms are looked for in them.  Those that are there stay."""
    tags = {f"_folded_{t}": F.transform(F.coalesce(F.col(t), F.array().cast("array<string>")), fold) for t in TAGS}
    texts = {f"_folded_{c}": fold(F.col(c)) for c in TEXTS if c in props.columns}
    new = {c: v for c, v in {**tags, **texts}.items() if c not in props.columns}
    return props.withColumns(new) if new else props


def tags_text(parting: str) -> list[Column]:
    return [F.array_join(f"_folded_{t}", parting) for t in TAGS]


def tier_from_tags(t: Column) -> Column:
    """Severity 0 to 3, or -1; the worst kind of word that occurs decides."""
    return F.when(contains_any(t, COMPLETE), 3).when(contains_any(t, HEAVY), 2).when(contains_any(t, MEDIUM), 1).when(contains_any(t, LIGHT), 0).otherwise(-1)


def tier_from_condition() -> Column:
    c = F.col("_folded_condition")
    found = F.coalesce(*[F.when(F.contains(c, F.lit(word)), F.lit(tier)) for word, tier in CONDITIONS.items()])
    return F.when(c.isin(*NO_CONDITION), -1).otherwise(F.coalesce(found, F.lit(-1)))


def _tier_name(severity: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), severity + 1)


def with_tier(props: DataFrame, profile: Profile) -> DataFrame:
    """Needs ``with_folded``.  Add renovation_tier, automatic_tier and renovation_evidence (manual, observed or inferred)."""
    r, year = profile.renovation, F.col("year_built")
    stated = F.greatest(tier_from_tags(F.col("_tags")), tier_from_condition())
    by_age = F.when(year.isNull() | (year < r.pre_modern_year), 2).when(year < r.modern_year, 1).otherwise(0)
    bumped = F.when((year < r.pre_modern_year) & (F.col("_stated") < 2), F.col("_stated") + 1).otherwise(F.col("_stated"))
    own = F.lower(F.trim(F.col("user_tier")))
    out = props.withColumn("_tags", F.concat_ws(" ", *tags_text(" "), F.col("_folded_condition"))).withColumn("_stated", stated).withColumn("_auto", F.when(F.col("_stated") < 0, by_age).otherwise(bumped))
    out = out.withColumns({
        "automatic_tier": _tier_name(F.col("_auto")),
        "renovation_tier": F.when(own.isin(*TIERS), own).otherwise(_tier_name(F.col("_auto"))),
        "renovation_evidence": F.when(own.isin(*TIERS), "manual").when(F.col("_stated") >= 0, "observed").otherwise("inferred"),
    })
    return out.drop("_tags", "_stated", "_auto")


def outbuilding_area() -> Column:
    """Typical areas added up; equal tags each count."""
    def size(tag: Column) -> Column:
        return F.coalesce(*[F.when(F.contains(tag, F.lit(k)), F.lit(v)) for k, v in OUTBUILDING_SQM.items()], F.lit(OTHER_OUTBUILDING_SQM))

    named = F.filter("_folded_outbuildings", lambda t: t != "")
    return F.aggregate(F.transform(named, size), F.lit(0.0), lambda a, x: a + x)


def acquisition_costs(price: Column, profile: Profile) -> Column:
    return F.when(price > 0, F.round(price * profile.budget.acquisition, 2)).otherwise(0.0)


def estimate_costs(props: DataFrame, profile: Profile) -> DataFrame:
    """Add purchase_price, acquisition_costs, renovation_low/mid/high, immediate_capex, total_low/mid/high and the tier columns."""
    r = profile.renovation
    rates = {t: getattr(r, t) for t in TIERS}
    low = F.element_at(F.create_map(*[F.lit(x) for t, (a, _) in rates.items() for x in (t, a)]), F.col("renovation_tier"))
    high = F.element_at(F.create_map(*[F.lit(x) for t, (_, b) in rates.items() for x in (t, b)]), F.col("renovation_tier"))
    out = with_tier(with_folded(props), profile)
    out = out.withColumns({"_living": F.coalesce(known(F.col("living_sqm")), known(F.col("usable_sqm")) * USABLE_SHARE, F.lit(LIVING_SQM)), "_low": low, "_high": high, "_sheds": outbuilding_area()})
    fixed = F.col("_living") / STOREYS * ROOF_FACTOR * r.roof_per_sqm + F.col("_sheds") * r.outbuilding_per_sqm + r.utilities
    price = F.coalesce(F.col("price"), F.lit(0.0))
    out = out.withColumns({
        "purchase_price": F.when(price != 0, price),
        "acquisition_costs": acquisition_costs(price, profile),
        "immediate_capex": F.lit(r.capex),
        **{f"_ren_{k}": (F.col("_living") * rate + fixed) * (1 + r.contingency) for k, rate in (("low", F.col("_low")), ("mid", (F.col("_low") + F.col("_high")) / 2), ("high", F.col("_high")))},
    })
    out = out.withColumns({
        **{f"renovation_{k}": F.round(f"_ren_{k}", 2) for k in ("low", "mid", "high")},
        **{f"total_{k}": F.round(price + F.col("acquisition_costs") + r.capex + F.col(f"_ren_{k}"), 2) for k in ("low", "mid", "high")},
    }).drop("_living", "_low", "_high", "_sheds", "_ren_low", "_ren_mid", "_ren_high")
    return out.drop(*[c for c in out.columns if c.startswith("_folded_") and c not in props.columns])
