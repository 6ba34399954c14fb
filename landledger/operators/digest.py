"""The weekly digest and the results page: entries, sections, texts, and where they are kept.

Everything up to the shortlist is a DataFrame.  Only the shortlist (``shortlist_size`` rows) and small tables of counters, sources and
towns reach the driver, to be written out as text.
"""

from __future__ import annotations

import html
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import german_format as de
from ..search_profile import Profile
from . import report, score

# What a German reader is told.
ACTION_CALL, ACTION_WATCH, ACTION_CHECK = "📞 SOFORT", "👀 BEOBACHTEN", "📄 PRÜFEN"
CATEGORY_LABELS = {"new": "🆕 NEU", "reactivated": "♻️ REAKTIVIERT", "price_change": "🔻 PREISÄNDERUNG", "known": "♻️ BEKANNT"}
GOOD_FLAGS = {"EXCEPTIONAL_DEVELOPMENT_CARVE_OUT": "Belegtes Entwicklungspotenzial trägt das Budget", "EXCLUSION_OVERRIDDEN_BY_SUBSTANCE": "Trotz Ausschlussbegriff echte Hofsubstanz"}
BAD_FLAGS = {"SANIERUNGSRISIKO": "Sanierungskosten übersteigen den Kaufpreis deutlich", "TRIAGE_DOUBTS_FARMSTEAD": "Triage hält das Inserat eher für Mietangebot oder Wohnung"}
CALL_FROM, CUT_WORTH_TELLING = 75.0, -3.0
PERIOD_DAYS, YIELD_DAYS = 7, 28
COUNT_ROWS = {
    "tracked": "Objekte erfasst", "active": "aktiv", "removed": "entfernt", "stale": "lange nicht gesehen", "verified": "verifiziert", "without_price": "ohne Preis", "without_distance": "ohne Entfernung", "rejected": "aussortiert",
    "shortlistable": "shortlistfähig", "risky": "mit Kapitalrisiko",
}


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _joined(label: str, name: str, most: int) -> Column:
    return F.when(F.size(_list(name)) > 0, F.concat(F.lit(label), F.array_join(F.slice(_list(name), 1, most), ", ")))


def _phrases(flags: Column, labels: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.array_compact(F.transform(F.coalesce(flags, F.array().cast("array<string>")), lambda f: F.try_element_at(known, f)))


def reasons_for(profile: Profile, most: int = 5) -> Column:
    """Why an entry is interesting, from its facts and flags."""
    delta = report.total_price_delta_pct(F.col("price"), F.col("price_first"))
    said = F.concat(
        F.array_compact(F.array(
            F.when(F.col("land_sqm") >= profile.land_strong, F.concat(F.lit("Sehr großes Grundstück ("), de.square_metres(F.col("land_sqm")), F.lit(")")))
            .when(F.col("land_sqm") >= profile.land_preferred, F.concat(F.lit("Grundstück über Zielgröße ("), de.square_metres(F.col("land_sqm")), F.lit(")"))),
            _joined("Nebengebäude: ", "outbuildings", 4), F.when(delta <= CUT_WORTH_TELLING, F.concat(F.lit("Preis seit Ersterfassung "), de.percent(delta))),
            F.when(F.col("is_private_seller"), "Privatverkauf – kein Maklerhonorar"), F.when(F.col("is_off_market_signal"), "Off-Market-Signal, noch nicht auf den Portalen"),
            F.when(F.col("air_km") <= profile.radius.air_km_max * 0.5, F.concat(F.lit("Nah am Suchzentrum ("), de.kilometres(F.col("air_km")), F.lit(" Luftlinie)"))),
            _joined("Besonderheiten: ", "special_features", 3),
        )), _phrases(F.col("flags"), GOOD_FLAGS),
    )
    return F.slice(F.when(F.size(said) > 0, said).otherwise(F.array_compact(F.array(F.when(F.col("price").isNotNull(), F.concat(F.lit("Im Budget ("), de.euro(F.col("price")), F.lit(")")))))), 1, most)


def risks_of(profile: Profile, most: int = 6) -> Column:
    """What speaks against it: gates first, then scores, then facts."""
    by_hand = F.when(F.col("renovation_evidence") == "manual", " (manuell)").otherwise("")
    said = F.concat(
        _list("reject_reasons"), _phrases(F.col("flags"), BAD_FLAGS),
        F.array_compact(F.array(
            F.when(F.col("capital_risk") != "low", F.concat(F.lit("Kapitalrisiko: "), "capital_risk")),
            F.when(F.col("confidence_score") < profile.gates.shortlist_confidence, F.concat(F.lit("Konfidenz nur "), F.bround("confidence_score", 0).cast("int").cast("string"), F.lit(" – Fakten ungeprüft"))),
            F.when(F.col("verification_status") != "verified", F.concat(F.lit("Verifikation: "), "verification_status")), F.when(F.col("driving_km").isNull(), "Fahrstrecke nicht geprüft"),
            F.when(F.col("geo_precision").isin("none", "postcode", "town"), F.concat(F.lit("Standort nur auf "), "geo_precision", F.lit("-Ebene bekannt"))), F.when(F.col("is_monument"), "Denkmalschutz – Auflagen und Kosten prüfen"),
            F.when(F.col("is_foreclosure"), "Zwangsversteigerung – Besichtigung oft nicht möglich"), _joined("Ausschlussmerkmale: ", "exclusion_flags", 3),
            F.when(F.col("total_high") > profile.budget.total_hard_max, F.concat(F.lit("Oberes Kostenband "), de.euro(F.col("total_high")), F.lit(" über Budgetgrenze"))),
            F.when(F.col("renovation_tier").isin("heavy", "complete"), F.concat(F.lit("Sanierungsstufe "), "renovation_tier", by_hand)),
        )),
    )
    return F.slice(F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("Keine harten Risiken erkannt – trotzdem vor Ort prüfen"))), 1, most)


def action(profile: Profile) -> Column:
    """Check what isn't verified or sure, call where it is worth it, else watch."""
    unsure = (F.coalesce("verification_status", F.lit("")) != "verified") | (F.coalesce("confidence_score", F.lit(0.0)) < profile.gates.shortlist_confidence)
    return F.when(unsure, ACTION_CHECK).when((F.coalesce("final_score", F.lit(0.0)) >= CALL_FROM) | F.coalesce("is_off_market_signal", F.lit(False)), ACTION_CALL).otherwise(ACTION_WATCH)


def price_events_since(prices: DataFrame, since: Column) -> DataFrame:
    """Moves in the window; the first price ever learned is none."""
    return prices.filter(F.col("old_price").isNotNull() & (F.col("ts") >= since))


def status_events_since(journal: DataFrame, since: Column) -> DataFrame:
    return journal.filter(F.col("ts") >= since)


def demote(entries: DataFrame, earliest: DataFrame, since: Column) -> DataFrame:
    """The last check of the one rule that must hold: what anything speaks of before ``since``, or nothing at all, isn't new.  ``demoted`` tells whom it met."""
    out = entries.join(earliest.select("property_id", F.col("earliest").alias("_e")), "property_id", "left")
    unearned = (F.col("category") == "new") & ~F.coalesce(F.col("_e") >= since, F.lit(False))
    return out.withColumn("demoted", unearned).withColumn("category", F.when(unearned, "known").otherwise(F.col("category"))).drop("_e")


def price_series(props: DataFrame, prices: DataFrame) -> DataFrame:
    """property_id, seq, at, value: the price before the first move (at first sight), each new price, and today's where it differs by more than half a unit.

    ``props``: property_id, price, first_seen, last_seen.  ``prices``: property_id, ts, seq, old_price, new_price.
    """
    w = Window.partitionBy("property_id").orderBy("ts", "seq")
    p = prices.withColumns({"_n": F.row_number().over(w), "_last": F.last("new_price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    opening = p.filter("_n = 1 and old_price is not null").join(props.select("property_id", "first_seen"), "property_id").select("property_id", F.lit(0).alias("_k"), F.lit(0).alias("_i"), F.col("first_seen").alias("at"), F.col("old_price").alias("value"))
    moves = p.filter("new_price is not null").select("property_id", F.lit(1).alias("_k"), F.col("_n").alias("_i"), F.col("ts").alias("at"), F.col("new_price").alias("value"))
    last = p.filter("_n = 1").select("property_id", F.coalesce("_last", "old_price").alias("_last"))
    today = props.filter("price is not null").join(last, "property_id", "left").filter(F.col("_last").isNull() | (F.abs(F.col("_last") - F.col("price")) > 0.5)).select("property_id", F.lit(2).alias("_k"), F.lit(0).alias("_i"), F.col("last_seen").alias("at"), F.col("price").alias("value"))
    rows = opening.union(moves).union(today)
    return rows.select("property_id", F.row_number().over(Window.partitionBy("property_id").orderBy("_k", "_i")).alias("seq"), "at", "value")


def history_events(earliest: DataFrame, prices: DataFrame, journal: DataFrame, sightings: DataFrame) -> DataFrame:
    """The four kinds of events in one table, for ``report.timeline``: property_id, ts, seq, kind, title, text.

    First evidence, prices (the first one named so), changes of state (not the first sighting, which the evidence tells, nor rows without a
    change), sightings.  At equal times in this order.
    """
    first = earliest.select("property_id", F.col("earliest").alias("ts"), F.lit(0).alias("_o"), F.lit(None).cast("string").alias("_i"), F.lit("first_seen").alias("kind"), F.lit("Erstmals erfasst").alias("title"), F.concat(F.lit("Seit "), de.month_year(F.col("earliest")), F.lit(" bekannt.")).alias("text"))
    opening, fell = F.col("old_price").isNull(), F.coalesce("new_price", F.lit(0.0)) < F.col("old_price")
    told = F.concat(F.lit("Preis von "), de.euro(F.col("old_price")), F.lit(" auf "), de.euro(F.col("new_price")), F.when(fell, " gefallen.").otherwise(" gestiegen."))
    p = prices.select("property_id", "ts", F.lit(1).alias("_o"), F.to_json(F.struct("seq")).alias("_i"), F.when(opening, "price_first").otherwise("price_change").alias("kind"), F.when(opening, "Erster bekannter Preis").otherwise("Preisänderung").alias("title"), F.when(opening, F.concat(F.lit("Erster bekannter Preis: "), de.euro(F.col("new_price")), F.lit("."))).otherwise(told).alias("text"))
    j = journal.filter((F.col("change_kind") != "first_seen") & ~F.col("old_status").eqNullSafe(F.col("new_status")))
    j = j.select("property_id", "ts", F.lit(2).alias("_o"), F.to_json(F.struct("seq")).alias("_i"), F.col("change_kind").alias("kind"), F.lit("Statuswechsel").alias("title"), F.when(F.col("old_status").isNull(), F.concat(F.lit("Jetzt „"), de.status(F.col("new_status")), F.lit("“."))).otherwise(F.concat(F.lit("„"), de.status(F.col("old_status")), F.lit("“ → „"), de.status(F.col("new_status")), F.lit("“."))).alias("text"))
    s = sightings.select("property_id", "ts", F.lit(3).alias("_o"), F.to_json(F.struct("seq")).alias("_i"), F.lit("observation").alias("kind"), F.lit("Beobachtung").alias("title"), F.concat(de.date(F.col("ts")), F.lit(": Quelle abgerufen"), F.when(F.col("visible"), "").otherwise(" – Inserat nicht mehr erreichbar")).alias("text"))
    rows = first.union(p).union(j).union(s)
    return rows.withColumn("seq", F.struct("_o", "_i")).drop("_o", "_i")


def history_sentence() -> Column:
    """One line for a dossier, from earliest, the last price move (changed_days ago, old_price, new_price) and price."""
    fell = F.coalesce("new_price", F.lit(0.0)) < F.coalesce("old_price", F.lit(0.0))
    moved = F.when(F.col("changed_days").isNotNull(), F.concat(de.relative_days(F.col("changed_days")), F.lit(" von "), de.euro(F.col("old_price")), F.lit(" auf "), de.euro(F.col("new_price")), F.when(fell, " gefallen").otherwise(" gestiegen")))
    said = F.array_compact(F.array(F.when(F.col("earliest").isNotNull(), F.concat(F.lit("Seit "), de.month_year(F.col("earliest")), F.lit(" bekannt"))), F.coalesce(moved, F.when(F.col("price").isNotNull(), F.concat(F.lit("unveränderter Preis "), de.euro(F.col("price")))))))
    return F.when(F.size(said) > 0, F.concat(F.array_join(said, ", "), F.lit("."))).otherwise("Noch keine Historie erfasst.")


def pick_document(documents: DataFrame) -> DataFrame:
    """Per property the document worth opening: one with a local copy before one on the web, of equals the smaller id."""
    usable = documents.withColumn("_k", F.when(F.col("local_path").isNotNull(), 0).when(F.col("url").rlike("^https?://"), 1)).filter("_k is not null")
    best = usable.groupBy("property_id").agg(F.min_by(F.struct("document_id", "url", "local_path"), F.struct("_k", "document_id")).alias("d"))
    href = F.when(F.col("d.local_path").isNotNull(), F.concat(F.lit("/document/"), F.col("d.document_id").cast("string"))).otherwise(F.col("d.url"))
    return best.select("property_id", F.col("d.document_id").alias("document_id"), href.alias("document_href"))


def open_links(best: DataFrame, source_rows: DataFrame, documents: DataFrame) -> DataFrame:
    """property_id, href, label, external: the best row's page, else any other page on the web, else the document that is held."""
    web = source_rows.filter(F.col("url").rlike("^https?://")).groupBy("property_id").agg(F.min_by("url", F.struct("source_id", "url")).alias("_w"))
    out = best.select("property_id", F.when(F.col("url").rlike("^https?://"), F.col("url")).alias("_b")).join(web, "property_id", "full").join(pick_document(documents).select("property_id", "document_href"), "property_id", "full")
    page = F.coalesce("_b", "_w")
    out = out.select("property_id", F.coalesce(page, "document_href").alias("href"), F.when(page.isNotNull(), "Inserat öffnen").when(F.col("document_href").isNotNull(), "Dokument öffnen").alias("label"))
    return out.filter("href is not null").withColumn("external", ~F.col("href").startswith("/"))


def results(scored: DataFrame, profile: Profile, sort: str = "score", limit: int = 60, include_rejected: bool = False, include_hidden: bool = False, shortlisted_only: bool = False, **filters) -> tuple[DataFrame, DataFrame]:
    """The results page: (rows with their rank, one row of counts).

    ``scored`` is every property with its (stored or fresh) score.  The sliders, filters and gates apply in this order; a reader's own list
    (``shortlisted_only``) is free of sliders and gates.
    """
    live = scored.filter(F.col("merged_into_id").isNull()) if "merged_into_id" in scored.columns else scored
    marked = F.col("shortlisted_at").isNotNull() if shortlisted_only else F.lit(True)
    shown = F.lit(True) if include_hidden else score.not_hidden()
    pool = live.filter(marked & shown)
    if not shortlisted_only:
        pool = pool.filter(score.passes_profile(profile))
    pool = score.apply_filters(pool, **filters)
    rejected = F.coalesce(F.col("rejected"), F.lit(False))
    out = pool if include_rejected or shortlisted_only else pool.filter(~rejected)
    dropped = F.lit(0) if include_rejected or shortlisted_only else F.count_if(rejected)
    counts = pool.agg((F.count(F.lit(1)) - dropped).alias("matched"), dropped.alias("hidden_rejected"))
    counts = counts.crossJoin(live.agg(F.count_if(marked).alias("total"), F.count_if(marked & ~score.not_hidden() & F.lit(not include_hidden)).alias("hidden_archived")))  # one row by one row
    top = score.web_sorted(out, sort, limit)
    return ranked_rows(top, sort), counts


def ranked_rows(top: DataFrame, sort: str = "score") -> DataFrame:
    """Add ``rank`` (from 1) to a page of rows, 500 at most."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*score.WEB_SORTS[sort](), F.col("property_id").asc())))


def degraded_order(rows: DataFrame) -> DataFrame:
    """Where no ranking is to be had: best score first, then the newest."""
    return rows.orderBy(F.col("final_score").desc_nulls_last(), F.col("first_seen").desc_nulls_last(), F.col("property_id").asc())


def source_places(rows: DataFrame) -> DataFrame:
    """Add ``place``: where a dossier lists a source among its property's (best first, then primary, then the smaller id)."""
    w = Window.partitionBy("property_id").orderBy(F.col("is_best").desc(), (F.col("role") == "primary").desc(), F.col("source_id").asc())
    return rows.withColumn("place", F.row_number().over(w))


def source_order(rows: DataFrame) -> DataFrame:
    """A property's sources as a dossier lists them."""
    return source_places(rows).orderBy("property_id", "place").drop("place")


def newest(rows: DataFrame, by: str, n: int = 30) -> DataFrame:
    """The newest runs or reports (a top-k)."""
    return rows.orderBy(F.col(by).desc_nulls_last()).limit(n)


def health(runs: DataFrame, now: Column, late_days: int = 8) -> DataFrame:
    """One row: the last run, how it ended, and whether it is too long ago."""
    last = runs.agg(F.max_by(F.struct("run_id", "status", "finished_at"), "finished_at").alias("r"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("r.finished_at").cast("timestamp"))) / 86_400_000_000
    return last.select(F.col("r.run_id").alias("run_id"), F.col("r.status").alias("status"), F.round(age, 3).alias("days_ago"), (F.coalesce(F.col("r.status") == "ok", F.lit(False)) & F.coalesce(age <= late_days, F.lit(False))).alias("healthy"))


@dataclass
class Digest:
    """A digest's small parts, on the driver."""

    week_label: str
    profile_name: str
    profile_hash: str
    since: str
    counts: dict
    entries: list[Row]
    yields: list[Row]
    towns: list[Row]
    notes: list[str] = field(default_factory=list)


def entries(scored: DataFrame, categories: DataFrame, earliest: DataFrame, urls: DataFrame, profile: Profile, since: Column) -> DataFrame:
    """The shortlist as rows: rank, facts, scores, costs, why, risks, action, category, URL."""
    top = score.ranked(scored, limit=profile.gates.shortlist_size)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("shortlist_blocked").asc(), F.col("final_score").desc(), F.col("property_id").asc())))  # shortlist_size rows
    out = demote(top.join(categories.select("property_id", "category"), "property_id", "left"), earliest, since).join(urls, "property_id", "left")
    return out.withColumns({"why": reasons_for(profile), "risks": risks_of(profile), "action": action(profile)}).orderBy("rank")


def build(scored: DataFrame, categories: DataFrame, earliest: DataFrame, urls: DataFrame, yields: DataFrame, towns: DataFrame, profile: Profile, since: Column, now: Column) -> Digest:
    """Collects ``shortlist_size`` entries, one row of counters, and a row for each source and expected town."""
    counts = report.digest_counts(scored, profile.gates.shortlist_confidence).first().asDict()
    rows = entries(scored, categories, earliest, urls, profile, since).collect()
    label = scored.sparkSession.range(1).select(de.week_label(now), F.date_format(since, "dd.MM.yyyy")).first()
    notes = [f"{r['property_id']}: als bekannt eingestuft – Belege reichen vor den Berichtszeitraum zurück." for r in rows if r["demoted"]]
    return Digest(label[0], profile.name, profile.profile_hash, label[1], counts, rows, yields.orderBy(F.col("observed").desc(), "source_key").collect(), towns.orderBy("ord").collect(), notes)


def _sections(d: Digest) -> list[tuple[str, list[list[str]]]]:
    """Heading and rows of cells, for both renderings."""
    out = [("Lage der Woche", [[label, str(d.counts[name])] for name, label in COUNT_ROWS.items() if name in d.counts])]
    out.append(("Quellen-Ausbeute", [[r["source_key"], str(r["observed"]), str(r["in_radius"])] for r in d.yields]))
    out.append(("Dunkle Gemeinden", [[r["town"]] for r in d.towns if r["observed"] == 0]))
    for r in d.entries:
        facts = [["Status", f"{r['listing_status']} · {CATEGORY_LABELS.get(r['category'], '')}"], ["Preis", "k. A." if r["price"] is None else f"{r['price']:,.0f} €".replace(",", ".")], ["Score", "–" if r["final_score"] is None else f"{r['final_score']:.0f}"], ["Warum interessant", "; ".join(r["why"]) or "–"], ["Risiko", "; ".join(r["risks"]) or "–"]]
        out.append((f"{r['rank']}. {r['action']} — {r['title']}, {r['town'] or 'Ort unbekannt'}", facts + ([["Quelle", r["url"]]] if r["url"] else [])))
    out.append(("Hinweise", [[n] for n in d.notes]))
    return out


def as_markdown(d: Digest) -> str:
    lines = [f"# {d.week_label}", "", f"**Suchprofil:** {d.profile_name} (`{d.profile_hash}`) · seit {d.since}", ""]
    for heading, rows in _sections(d):
        lines += [f"## {heading}", "", *([f"- {' · '.join(cells)}" for cells in rows] or ["- –"]), ""]
    return "\n".join(lines)


def as_html(d: Digest) -> str:
    """An article to be put into a page."""
    parts = [f"<article><h1>{html.escape(d.week_label)}</h1><p>{html.escape(d.profile_name)} · seit {d.since}</p>"]
    for heading, rows in _sections(d):
        body = "".join("<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in cells) + "</tr>" for cells in rows)
        parts.append(f"<section><h2>{html.escape(heading)}</h2><table>{body}</table></section>")
    return "".join(parts) + "</article>"


REPORT_SCHEMA = "week_label string, profile_hash string, since string, markdown string, html string"


def save_report(spark: SparkSession, d: Digest, path: str) -> None:
    """One folder per week and profile; writing again replaces it alone."""
    row = spark.createDataFrame([(d.week_label, d.profile_hash, d.since, as_markdown(d), as_html(d))], REPORT_SCHEMA)
    row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_label", "profile_hash").parquet(path)


# The columns of an export.
EXPORT = ("rank", "property_id", "title", "town", "postcode", "price", "price_type", "land_sqm", "living_sqm", "air_km", "driving_km", "listing_status", "verification_status", "final_score", "fit_score", "deal_score", "hidden_score", "freshness_score", "confidence_score", "total_low", "total_mid", "total_high", "marked")


def export_rows(rows: DataFrame) -> DataFrame:
    """The export's columns in their order, all text; a mark is 1 or empty, what is missing is empty."""
    marked = F.when(F.col("shortlisted_at").isNotNull(), "1").otherwise("") if "shortlisted_at" in rows.columns else F.lit("")
    cols = [(marked if c == "marked" else F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")).alias(c) for c in EXPORT]
    return rows.select(*cols)


def write_export(rows: DataFrame, path: str) -> None:
    """Semicolon-separated, with a header whose first name follows a byte order mark."""
    out = export_rows(rows)
    out.withColumnRenamed("rank", "﻿rank").write.option("sep", ";").option("header", True).option("emptyValue", "").csv(path)


def json_documents(props: DataFrame, source_rows: DataFrame, prices: DataFrame) -> DataFrame:
    """property_id, document: each property with its sources and price moves as one JSON text."""
    s = source_rows.groupBy("property_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "url", "visible", "first_seen", "last_seen"))).alias("sources"))
    p = prices.groupBy("property_id").agg(F.array_sort(F.collect_list(F.struct("ts", "old_price", "new_price"))).alias("prices"))
    return props.join(s, "property_id", "left").join(p, "property_id", "left").select("property_id", F.to_json(F.struct(*[c for c in props.columns], "sources", "prices")).alias("document"))


def write_stage(spark: SparkSession, path: str, run_id: int, stage: str, detail: dict) -> None:
    """Append an entry to the stage log."""
    row = spark.createDataFrame([(run_id, stage, {k: str(v) for k, v in detail.items()})], "run_id long, stage string, detail map<string,string>")
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def backup(spark: SparkSession, tables: dict[str, str], path: str) -> dict[str, int]:
    """Copy tables (name to path) into a new folder and compare row counts.  Refuses a folder that exists."""
    counts = {}
    for name, at in tables.items():
        spark.read.parquet(at).write.mode("errorifexists").parquet(f"{path}/{name}")
        counts[name] = spark.read.parquet(f"{path}/{name}").count()
        if counts[name] != spark.read.parquet(at).count():
            raise RuntimeError(f"the copy of {name} is not whole")
    return counts
