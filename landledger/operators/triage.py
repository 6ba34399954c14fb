"""Second opinions: what goes out for review, what comes back, what it decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..search_profile import Profile
from .score import triage

STATE_CHARS = 6000
VERDICT = "offer_kind string, dwelling_kind string, offer_probabilities map<string,double>, dwelling_probabilities map<string,double>, farm_substance double"
REVIEW = "verdict string, summary string, risks array<string>"


def review_state(most: int = STATE_CHARS) -> Column:
    """A listing as one JSON document, its prose cut so that the document stays short."""
    return F.to_json(F.struct("property_id", "title", F.substring(F.coalesce(F.col("description"), F.lit("")), 1, most).alias("description"), "price", "price_type", "land_sqm", "living_sqm", "year_built", "town"))


def json_in_prose(c: Column) -> Column:
    """The outermost braces of an answer, fenced or not."""
    found = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def parse_verdict(c: Column, schema: str = VERDICT) -> Column:
    """Null where the answer holds no readable JSON."""
    return F.from_json(json_in_prose(c), schema, {"mode": "PERMISSIVE"})


def to_evidence(verdict: Column, url: Column) -> Column:
    """The surest of the deciding answers as the evidence's confidence."""
    p = lambda m, k: F.coalesce(F.element_at(verdict[m], F.lit(k)), F.lit(0.0))
    sure = F.greatest(p("offer_probabilities", "rent"), p("dwelling_probabilities", "flat"), F.coalesce(F.element_at(verdict["offer_probabilities"], verdict["offer_kind"]), F.lit(0.0)))
    return F.when(verdict.isNotNull(), F.struct(F.lit("triage").alias("source"), url.alias("url"), F.round(sure, 4).alias("confidence"), verdict.alias("answer")))


def from_evidence(evidence: Column) -> Column:
    """The verdict back from the evidence map of a property, if its ``triage`` entry holds one."""
    return F.try_element_at(evidence, F.lit("triage"))["answer"]


# What the reviewer is told and asked.
DOSSIER = {
    "titel": "title", "ort": "town", "plz": "postcode", "typ": "property_type", "preis": "price", "preis_art": "price_type", "grundstueck_qm": "land_sqm", "wohnflaeche_qm": "living_sqm", "nutzflaeche_qm": "usable_sqm", "baujahr": "year_built", "zustand": "condition",
    "nebengebaeude": "outbuildings", "merkmale": "building_features", "besonderheiten": "special_features", "entfernung_luftlinie_km": "air_km", "entfernung_fahrstrecke_km": "driving_km", "zwangsversteigerung": "is_foreclosure", "denkmal": "is_monument",
    "privatverkauf": "is_private_seller", "erstmals_gesehen": "first_seen", "preisreduktionen": "price_reduction_count", "geschaetzte_gesamtkosten": "total_mid",
}


def review_prompt(rows: DataFrame, profile: Profile, most: int = STATE_CHARS) -> Column:
    """The whole question to a reviewer: the dossier as JSON (what a row lacks is left out), then the shape of the answer."""
    known = [F.col(c).alias(n) for n, c in DOSSIER.items() if c in rows.columns]
    dossier = F.struct(*known, F.col("driving_km").isNotNull().alias("fahrstrecke_geprueft"), F.lit(profile.budget.total_max).alias("budget_gesamt"), F.substring(F.coalesce("description", F.lit("")), 1, most).alias("beschreibung"))
    return F.concat(F.lit("Objektdossier:\n"), F.to_json(dossier, {"pretty": "true"}), F.lit("\n\nAntworte mit JSON nach diesem Schema:\n" + REVIEW))


def decide(rows: DataFrame, verdict: str, profile: Profile) -> DataFrame:
    """Add triage_reason (or null) and triage_flags: a rental rejects on its probability; a flat unless outbuildings speak against it; else a flag."""
    v = F.col(verdict)
    p = lambda m, k: F.coalesce(F.element_at(v[m], F.lit(k)), F.lit(0.0))
    sheds = F.size(F.coalesce(F.col("outbuildings"), F.array().cast("array<string>"))) > 0
    reason, _ = triage(p("offer_probabilities", "rent"), p("dwelling_probabilities", "flat"), F.lit(0.0), F.lit(0.0), sheds, profile.gates.triage_probability)
    likely = F.coalesce((v["offer_kind"] == "rent") | (v["dwelling_kind"] == "flat"), F.lit(False))
    return rows.withColumns({"triage_reason": reason, "triage_flags": F.array_compact(F.array(F.when(reason.isNull() & likely, "TRIAGE_DOUBT")))})


def review_candidates(ranked: DataFrame, profile: Profile) -> DataFrame:
    """The first so many of a ranking (a top-k)."""
    return ranked.limit(profile.gates.review_size)
