"""Queries over the log's folds, the digest and the results page, each beside its DuckDB SQL (none where SQL can't express it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import geo, german_format
from ..operators import digest, ingest, lifecycle, report, resolve, score
from ..search_profile import SHIPPED
from ..sources import files
from . import oracles, roles
from .queries import Query, _facts, _now, _scored, _since

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_with, _NOW = oracles._with, oracles.NOW


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_RANK = "CASE geo_precision WHEN 'exact' THEN 4 WHEN 'street' THEN 3 WHEN 'town' THEN 2 WHEN 'postcode' THEN 1 ELSE 0 END"
_ON = "lat IS NOT NULL AND lon IS NOT NULL"
_PLACE = f"""anchor AS (SELECT property_id, max(seq) AS a FROM placed WHERE verifies AND {_ON} GROUP BY 1),
place AS (SELECT property_id, lat, lon, coalesce(geo_precision, 'none') AS geo_precision FROM placed LEFT JOIN anchor USING (property_id) WHERE {_ON} AND (a IS NULL OR seq >= a)
  QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY {_RANK} DESC, seq) = 1),
ways AS (SELECT property_id, arg_max(air_km, seq) FILTER ({_ON} AND air_km IS NOT NULL) AS air_km FROM placed GROUP BY 1),
route AS (SELECT property_id, driving_km, driving_minutes FROM placed WHERE {_ON} AND routed QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY seq DESC) = 1)"""
_STAMPS = """stamps AS (SELECT property_id, arg_min(ts, seq) AS first_seen, arg_max(ts, seq) AS last_seen, arg_max(ts, seq) FILTER (verifies AND visible) AS last_verified,
  arg_max(source_date, seq) FILTER (verifies AND visible AND source_date IS NOT NULL) AS source_date, CASE WHEN bool_or(verifies AND visible) THEN 'verified' ELSE 'unverified' END AS verification_status FROM placed GROUP BY 1)"""


@query(_with(roles.PLACED_CTE, _PLACE) + "SELECT property_id, lat, lon, geo_precision, air_km, driving_km, driving_minutes FROM ways LEFT JOIN place USING (property_id) LEFT JOIN route USING (property_id)")
def place_fold(spark, d):
    return ingest.fold_place(roles.placed_sightings(spark, d))


@query(_with(roles.PLACED_CTE, _STAMPS) + "SELECT * FROM stamps")
def stamps_fold(spark, d):
    return ingest.fold_stamps(roles.placed_sightings(spark, d))


@query(_with(roles.SIGHTING_CTE) + "SELECT property_id, source_id, ts AS checked_at, url, CASE WHEN visible THEN 'verified' ELSE 'gone' END AS outcome FROM sighting WHERE verifies")
def verification_events(spark, d):
    return ingest.verification_events(roles.sightings(spark, d))


_LAST_STATUS = "last AS (SELECT property_id, arg_max(status, seq) AS listing_status, count(*) AS n_sightings FROM st GROUP BY 1)"
_FOLDED = "folded AS (SELECT property_id, " + ", ".join(f"coalesce(arg_max({v}, seq) FILTER (verifies AND {v} IS NOT NULL), arg_min({v}, seq) FILTER (NOT verifies AND {v} IS NOT NULL)) AS {c}" for c, v in (("price", "price"), ("land_sqm", "land_sqm"), ("title", "nullif(trim(title), '')"))) + " FROM sighting GROUP BY 1)"


@query(
    _with(roles.SIGHTING_CTE, oracles._STATUS, roles.PLACED_CTE, _PLACE, _STAMPS, _LAST_STATUS, _FOLDED)
    + "SELECT property_id, title, price, land_sqm, air_km, driving_km, driving_minutes, first_seen, last_seen, last_verified, source_date, verification_status, listing_status, n_sightings, lat, lon, geo_precision FROM folded JOIN ways USING (property_id) JOIN stamps USING (property_id) JOIN last USING (property_id) LEFT JOIN place USING (property_id) LEFT JOIN route USING (property_id)"
)
def snapshot(spark, d):
    """Facts, place, stamps and state of every property, from the whole log."""
    log = roles.placed_sightings(spark, d)
    return ingest.snapshot(log, ("title", "price", "land_sqm"), (), ())


_INGESTED = "j AS (SELECT property_id, count(*) AS journaled, count(*) FILTER (change_kind = 'price_change') AS price_changes FROM kinds GROUP BY 1) SELECT * FROM last JOIN j USING (property_id)"


@query(_with(roles.SIGHTING_CTE.replace("FROM lineitem", "FROM lineitem WHERE l_orderkey % 10 <> 9 OR l_suppkey % 4 <> 0"), oracles._KINDS, _LAST_STATUS, _INGESTED))
def ingest_batch(spark, d):
    """Rows of the last orders are a batch of listings; some are index pages and refused."""
    log = roles.sightings(spark, d)
    old, new = log.filter("l_orderkey % 10 <> 9"), log.filter("l_orderkey % 10 = 9")
    batch = new.withColumn("page_kind", F.when(F.col("supplier") % 4 == 0, "index").otherwise("listing"))
    done = ingest.ingest(old, batch)
    j = done.journal.groupBy("property_id").agg(F.count(F.lit(1)).alias("journaled"), F.count_if(F.col("change_kind") == "price_change").alias("price_changes"))
    return done.snapshot.select("property_id", "listing_status", "n_sightings").join(j, "property_id")


@query(_with(roles.SIGHTING_CTE, oracles._KINDS) + "SELECT CAST(year(ts) AS INT) AS run_id, count(*) AS changes, count(*) FILTER (change_kind = 'first_seen') AS new, count(*) FILTER (change_kind IN ('source_change', 'description_change', 'status_change', 'reactivated')) AS updated, count(*) FILTER (change_kind = 'price_change') AS price_changes, count(*) FILTER (change_kind = 'removed') AS removed FROM kinds GROUP BY 1")
def run_counters(spark, d):
    return ingest.run_counts(lifecycle.change_kinds(roles.sightings(spark, d)).withColumn("run_id", F.year("ts")))


@query(
    "WITH r AS (SELECT l_suppkey AS s, 'u' || (l_partkey * 10 + l_linenumber) AS url, CASE WHEN l_linenumber < 4 THEN 'x' || l_partkey END AS e, l_partkey AS p FROM lineitem), u AS (SELECT s, url, min(p) AS p FROM r GROUP BY 1, 2), i AS (SELECT s, e, min(p) AS p FROM r WHERE e IS NOT NULL GROUP BY 1, 2), "
    "l AS (SELECT l_orderkey, l_linenumber, l_suppkey AS s, 'u' || (l_partkey * 10 + l_linenumber % 3) AS url, 'x' || l_partkey AS e FROM lineitem) SELECT l_orderkey, l_linenumber, l.s AS source_key, coalesce(u.p, i.p) AS known_id FROM l LEFT JOIN u ON u.s = l.s AND u.url = l.url LEFT JOIN i ON i.s = l.s AND i.e = l.e"
)
def known_id_lookup(spark, d):
    """Listings by source and URL, else by source and external id."""
    li = roles.table(spark, d, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("source_key"), F.concat(F.lit("u"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).cast("string")).alias("url"), F.when(F.col("l_linenumber") < 4, F.concat(F.lit("x"), F.col("l_partkey").cast("string"))).alias("external_id"), F.col("l_partkey").alias("property_id"))
    asked = li.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("source_key"), F.concat(F.lit("u"), (F.col("l_partkey") * 10 + F.col("l_linenumber") % 3).cast("string")).alias("url"), F.concat(F.lit("x"), F.col("l_partkey").cast("string")).alias("external_id"))
    return ingest.known_ids(asked, rows).select("l_orderkey", "l_linenumber", "source_key", "known_id")


@query("SELECT DISTINCT l_suppkey AS source_id, l_partkey AS property_id FROM lineitem WHERE l_linenumber = 1 OR l_linenumber % 2 = 0")
def seen_credit(spark, d):
    """Read rows, and rows that were only enumerated."""
    li = roles.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("property_id"), "l_linenumber", F.concat(F.lit("u"), F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("url"))
    return ingest.credited(li.filter("l_linenumber = 1"), li.filter("l_linenumber % 2 = 0"), li.select("source_id", "url", "property_id").distinct())


_STATE = "WITH s AS (SELECT user_id AS property_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1) "


@query(_STATE + "SELECT p_partkey AS property_id, max(CASE WHEN event_type = 'click' THEN CAST(event_id AS VARCHAR) END) AS user_note, max(CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'watch' END) AS user_state, coalesce(max(CASE WHEN event_type = 'purchase' AND event_id % 3 <> 0 THEN 'Hof ' || event_id END), any_value(p_name)) AS display_title FROM part LEFT JOIN s ON s.property_id = p_partkey GROUP BY 1")
def reader_state(spark, d):
    """Acts of a reader on a property; the last one on each field counts, and null or blank takes back."""
    e = roles.table(spark, d, "events")
    n = F.col("event_id")
    value = F.when(F.col("event_type") == "click", n.cast("string")).when(F.col("event_type") == "view", F.when(n % 2 == 0, "watch")).otherwise(F.when(n % 3 != 0, F.concat(F.lit("Hof "), n.cast("string"))).otherwise(" "))
    field = F.when(F.col("event_type") == "click", "user_note").when(F.col("event_type") == "view", "user_state").when(F.col("event_type") == "purchase", "user_title").otherwise("other")
    state = e.select(F.col("user_id").alias("property_id"), field.alias("field"), value.alias("value"), n.alias("ts"))
    return ingest.with_reader_state(roles.properties(spark, d).select("property_id", "title"), state).select("property_id", "user_note", "user_state", "display_title")


_SERIES = """p AS (SELECT *, row_number() OVER w AS n, last_value(new_price) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lastp FROM cuts WINDOW w AS (PARTITION BY property_id ORDER BY ts, seq)),
s AS (SELECT property_id, 0 AS k, 0 AS i, old_price AS value FROM p WHERE n = 1 AND old_price IS NOT NULL UNION ALL SELECT property_id, 1, n, new_price FROM p WHERE new_price IS NOT NULL
  UNION ALL SELECT q.property_id, 2, 0, q.price FROM property q LEFT JOIN p ON p.property_id = q.property_id AND p.n = 1 WHERE q.price IS NOT NULL AND (p.lastp IS NULL OR abs(p.lastp - q.price) > 0.5))"""


@query(_with(roles.SIGHTING_CTE, oracles._RUNNING, roles.PROPERTY_CTE, _SERIES) + "SELECT property_id, CAST(row_number() OVER (PARTITION BY property_id ORDER BY k, i) AS INT) AS seq, value FROM s")
def price_series(spark, d):
    return digest.price_series(roles.properties(spark, d), lifecycle.price_journal(roles.sightings(spark, d))).select("property_id", "seq", "value")


_EVENTS = """ev AS (SELECT property_id, min(ts) AS ts, 0 AS o, 0 AS i, 'first_seen' AS kind FROM sighting GROUP BY 1 UNION ALL SELECT property_id, ts, 1, seq, CASE WHEN old_price IS NULL THEN 'price_first' ELSE 'price_change' END FROM cuts
UNION ALL SELECT property_id, ts, 2, seq, change_kind FROM kinds WHERE change_kind <> 'first_seen' AND old_status IS DISTINCT FROM new_status UNION ALL SELECT property_id, ts, 3, seq, 'observation' FROM sighting),
folded AS (SELECT *, CASE WHEN kind = 'observation' AND lag(kind) OVER (PARTITION BY property_id ORDER BY ts, o) = 'observation' THEN 0 ELSE 1 END AS new FROM ev)"""


@query(_with(roles.SIGHTING_CTE, oracles._RUNNING, oracles._KINDS, _EVENTS) + "SELECT property_id, count(*) AS events, CAST(sum(new) AS BIGINT) AS lines, count(*) FILTER (kind = 'price_change') AS price_changes FROM folded GROUP BY 1")
def history_timeline(spark, d):
    """First evidence, prices, states and sightings of a property in one line, runs of sightings folded."""
    log = roles.sightings(spark, d)
    first = log.groupBy("property_id").agg(F.min("ts").alias("earliest"))
    events = digest.history_events(first, lifecycle.price_journal(log), lifecycle.change_kinds(log), log)
    folded = report.timeline(events)
    return folded.groupBy("property_id").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(F.when(F.col("kind") == "price_change", F.col("n"))), F.lit(0)).alias("price_changes"))


@query(_with(roles.SIGHTING_CTE, oracles._RUNNING) + f"SELECT property_id, ts, old_price, new_price FROM cuts WHERE old_price IS NOT NULL AND ts >= {_NOW} - INTERVAL 100 DAY")
def recent_price_moves(spark, d):
    return digest.price_events_since(lifecycle.price_journal(roles.sightings(spark, d)), _since(100)).select("property_id", "ts", "old_price", "new_price")


_WEB = "WITH s AS (SELECT l_partkey AS p, l_suppkey AS i, CASE WHEN l_suppkey % 5 = 0 THEN 'upload:' || l_suppkey ELSE 'https://x/' || l_suppkey END AS url, l_linenumber AS n FROM lineitem WHERE l_partkey % 3 <> 0), "


@query(
    _WEB + "b AS (SELECT p, url FROM s QUALIFY row_number() OVER (PARTITION BY p ORDER BY n, i, url) = 1), w AS (SELECT p, url FROM s WHERE starts_with(url, 'http') QUALIFY row_number() OVER (PARTITION BY p ORDER BY i, url) = 1), "
    "o AS (SELECT p_partkey AS p, CASE WHEN p_partkey % 2 = 0 THEN '/document/' || p_partkey WHEN p_partkey % 4 = 1 THEN 'https://d/' || p_partkey END AS h FROM part), j AS (SELECT coalesce(b.p, o.p) AS p, CASE WHEN starts_with(b.url, 'http') THEN b.url ELSE w.url END AS page, h FROM b FULL JOIN o ON o.p = b.p LEFT JOIN w ON w.p = b.p) "
    "SELECT p AS property_id, coalesce(page, h) AS href, CASE WHEN page IS NOT NULL THEN 'Inserat öffnen' ELSE 'Dokument öffnen' END AS label, NOT starts_with(coalesce(page, h), '/') AS external FROM j WHERE coalesce(page, h) IS NOT NULL"
)
def open_links(spark, d):
    """What a reader may open: the best page, another page, else a document."""
    li = roles.table(spark, d, "lineitem").filter("l_partkey % 3 <> 0")
    url = F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("upload:"), F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("https://x/"), F.col("l_suppkey").cast("string")))
    rows = li.select(F.col("l_partkey").alias("property_id"), F.col("l_suppkey").alias("source_id"), url.alias("url"), "l_linenumber")
    best = rows.groupBy("property_id").agg(F.min_by("url", F.struct("l_linenumber", "source_id", "url")).alias("url"))
    p = roles.table(spark, d, "part").select(F.col("p_partkey").alias("property_id"), F.col("p_partkey").alias("document_id"), F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("https://d/"), F.col("p_partkey").cast("string"))).otherwise(F.lit("manual:1")).alias("url"), F.when(F.col("p_partkey") % 2 == 0, "a.pdf").alias("local_path"))
    return digest.open_links(best, rows, p)


@query(
    "WITH d AS (SELECT l_partkey AS p, 'u' || (l_suppkey % 3) AS url, l_shipmode_ AS kind, CASE WHEN l_tax > 0.03 THEN 't' || l_linenumber END AS title, CASE WHEN l_discount > 0.05 THEN l_linenumber END AS pages, (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS seq FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem)) "
    "SELECT p AS property_id, url, arg_max(kind, seq) AS kind, arg_max(title, seq) FILTER (title IS NOT NULL) AS title, arg_max(pages, seq) FILTER (pages IS NOT NULL) AS page_count FROM d GROUP BY 1, 2"
)
def document_upsert(spark, d):
    li = roles.table(spark, d, "lineitem")
    docs = li.select(
        F.col("l_partkey").alias("property_id"), F.concat(F.lit("u"), (F.col("l_suppkey") % 3).cast("string")).alias("url"), F.col("l_returnflag").alias("kind"), F.when(F.col("l_tax") > 0.03, F.concat(F.lit("t"), F.col("l_linenumber").cast("string"))).alias("title"),
        F.when(F.col("l_discount") > 0.05, F.col("l_linenumber")).alias("page_count"), F.lit(None).cast("string").alias("local_path"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("bigint")).alias("seq"),
    )
    return ingest.upsert_documents(docs.filter("seq % 2 = 0"), docs.filter("seq % 2 = 1")).select("property_id", "url", "kind", "title", "page_count")


@query(oracles._scored(SHIPPED) + "SELECT CAST(row_number() OVER (ORDER BY final_score DESC, property_id) AS INT) AS rank, property_id, final_score FROM scored WHERE NOT rejected AND (user_state IS NULL OR user_state <> 'archived') AND NOT coalesce(air_km > 80, FALSE) AND NOT coalesce(price > 900000, FALSE) AND NOT coalesce(total_mid > 1500000, FALSE) AND land_sqm >= 2000 QUALIFY rank <= 60")
def results_page(spark, d):
    """Sliders, filters and gates, then the first page with its ranks."""
    rows, _ = digest.results(_scored(spark, d).withColumn("shortlisted_at", F.lit(None).cast("timestamp")), SHIPPED, min_land_sqm=2000)
    return rows.select("rank", "property_id", "final_score")


@query(oracles._scored(SHIPPED) + ", pool AS (SELECT * FROM scored WHERE (user_state IS NULL OR user_state <> 'archived') AND NOT coalesce(air_km > 80, FALSE) AND NOT coalesce(price > 900000, FALSE) AND NOT coalesce(total_mid > 1500000, FALSE)) SELECT count(*) FILTER (NOT rejected) AS matched, count(*) FILTER (rejected) AS hidden_rejected, (SELECT count(*) FROM scored) AS total, (SELECT count(*) FILTER (user_state = 'archived') FROM scored) AS hidden_archived FROM pool")
def results_counts(spark, d):
    return digest.results(_scored(spark, d).withColumn("shortlisted_at", F.lit(None).cast("timestamp")), SHIPPED)[1]


def _kept_scores(spark, d):
    """Scores as they might be kept: some missing, some older than their property's last update."""
    p = roles.table(spark, d, "part").select(F.col("p_partkey").alias("property_id"))
    day = lambda k: F.expr(f"timestamp_ntz'1998-01-01' + make_interval(0, 0, 0, cast({k} as int))")
    scores = p.filter("property_id % 5 <> 0").select("property_id", F.when(F.col("property_id") % 2 == 0, "h1").otherwise("h2").alias("profile_hash"), (F.col("property_id") % 100).cast("double").alias("final_score"), day("property_id % 50").alias("updated_at"))
    return p.withColumn("updated_at", day("property_id % 30")), scores, p.filter("property_id % 7 <> 0")


@query("SELECT p_partkey AS property_id, CAST(p_partkey % 100 AS DOUBLE) AS final_score FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 2 = 0")
def stored_scores(spark, d):
    p, scores, _ = _kept_scores(spark, d)
    return score.stored_scores(p, scores, "h1").select("property_id", "final_score")


@query("SELECT p_partkey AS property_id FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 2 <> 0 OR p_partkey % 7 = 0 OR p_partkey % 50 < p_partkey % 30")
def dirty_scores(spark, d):
    return score.dirty(*_kept_scores(spark, d), "h1").select("property_id")


_CATEGORY = f"""j AS (SELECT property_id, bool_or(change_kind = 'reactivated') AS r, bool_or(change_kind = 'price_change') AS p FROM kinds WHERE ts >= {_NOW} - INTERVAL 300 DAY GROUP BY 1),
early AS (SELECT property_id, min(ts) AS e FROM sighting GROUP BY 1),
top AS (SELECT * FROM scored WHERE NOT rejected AND (user_state IS NULL OR user_state <> 'archived') ORDER BY shortlist_blocked, final_score DESC, property_id LIMIT 10)"""


@query(
    oracles._scored(SHIPPED) + ", " + ", ".join([roles.SIGHTING_CTE, oracles._KINDS, _CATEGORY])
    + f" SELECT CAST(row_number() OVER (ORDER BY shortlist_blocked, final_score DESC, property_id) AS INT) AS rank, property_id, CASE WHEN r THEN 'reactivated' WHEN first_seen >= {_NOW} - INTERVAL 300 DAY AND e >= {_NOW} - INTERVAL 300 DAY THEN 'new' WHEN NOT (first_seen >= {_NOW} - INTERVAL 300 DAY) AND p THEN 'price_change' ELSE 'known' END AS category, "
    "CASE WHEN verification_status <> 'verified' OR confidence_score < 60 THEN '📄 PRÜFEN' WHEN final_score >= 75 OR is_off_market_signal THEN '📞 SOFORT' ELSE '👀 BEOBACHTEN' END AS action FROM top LEFT JOIN j USING (property_id) LEFT JOIN early USING (property_id)"
)
def digest_entries(spark, d):
    """The shortlist of the digest: ranks, categories with the new rule enforced, actions."""
    log, scored = roles.sightings(spark, d), _scored(spark, d).withColumn("price_first", F.lit(None).cast("double"))
    p = roles.properties(spark, d).select("property_id", F.col("first_seen").cast("timestamp_ntz").alias("earliest"))
    categories = report.categorise(p, lifecycle.change_kinds(log), _since(300))
    early = log.groupBy("property_id").agg(F.min("ts").alias("earliest"))
    urls = p.select("property_id", F.lit(None).cast("string").alias("url"))
    return digest.entries(scored, categories, early, urls, SHIPPED, _since(300)).select("rank", "property_id", "category", "action")


@query("SELECT p_partkey AS property_id FROM part WHERE p_partkey IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey % 9 = 4)")
def pasted_properties(spark, d):
    """Properties that one source's paste brought."""
    pasted = roles.table(spark, d, "lineitem").select(F.col("l_partkey").alias("property_id"), (F.col("l_suppkey") % 9).alias("source_id"))
    return report.of_sources(roles.properties(spark, d), pasted, [4]).select("property_id")


_EDGES = "e AS (SELECT p_partkey AS u, p_partkey + 3 AS v FROM part WHERE p_partkey % 6 = 1 AND p_partkey + 3 IN (SELECT p_partkey FROM part))"
_GROUP = "g AS (SELECT p.*, coalesce(e.u, p.property_id) AS survivor_id FROM property p LEFT JOIN e ON e.v = p.property_id)"


def _merged_pairs(spark, d):
    p = roles.table(spark, d, "part").select(F.col("p_partkey").alias("u"))
    edges = p.filter("u % 6 = 1").withColumn("v", F.col("u") + 3)
    return resolve.survivors(edges.join(p.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v"))


@query(
    _with(roles.PROPERTY_CTE, _EDGES, _GROUP) + "SELECT survivor_id, count(*) AS merged, arg_min(price, property_id) FILTER (price IS NOT NULL) AS price, arg_min(postcode, property_id) FILTER (trim(postcode) <> '') AS postcode, arg_min(condition, property_id) FILTER (trim(condition) <> '') AS condition, "
    f"arg_min(lat, (-{_RANK}, property_id)) FILTER (lat IS NOT NULL) AS lat, arg_min(geo_precision, (-{_RANK}, property_id)) FILTER (lat IS NOT NULL) AS geo_precision, min(first_seen) AS first_seen, max(last_seen) AS last_seen, max(last_verified) AS last_verified, max(price_reduction_count) AS price_reduction_count, bool_or(is_monument) AS is_monument, "
    "coalesce(arg_min(price_type, property_id) FILTER (price_type <> 'unknown'), arg_min(price_type, property_id)) AS price_type, arg_max(listing_status, (CASE listing_status WHEN 'active' THEN 5 WHEN 'discovered' THEN 2 WHEN 'stale' THEN 1 ELSE 0 END, -property_id)) AS listing_status, CASE WHEN bool_or(verification_status = 'verified') THEN 'verified' ELSE 'unverified' END AS verification_status FROM g GROUP BY 1"
)
def merged_properties(spark, d):
    """Everything that a merge folds, for all properties."""
    out = resolve.merge_properties(roles.properties(spark, d), _merged_pairs(spark, d))
    return out.select("survivor_id", "merged", "price", "postcode", "condition", "lat", "geo_precision", "first_seen", "last_seen", "last_verified", "price_reduction_count", "is_monument", "price_type", "listing_status", "verification_status")


@query(_with(_EDGES, roles.PROPERTY_SOURCE_CTE) + "SELECT coalesce(u, property_id) AS property_id, source_id % 20 AS source_id, min(first_seen) AS first_seen, max(last_seen) AS last_seen, bool_or(visible) AS visible FROM property_source LEFT JOIN e ON v = property_id GROUP BY 1, 2")
def repointed_sources(spark, d):
    """Source rows follow their property to its survivor; those that meet there become one."""
    rows = roles.property_sources(spark, d).withColumn("source_id", F.col("source_id") % 20).withColumn("url", F.lit("https://x/"))
    out = resolve.fold_source_rows(resolve.repoint(rows, _merged_pairs(spark, d)))
    return out.select("property_id", "source_id", "first_seen", "last_seen", "visible")


@query()
def duplicate_search(spark, d):
    """Each property again as a listing (price a little off), against all properties.  A test holds it against brute force."""
    p = _facts(spark, d)
    rows = roles.properties(spark, d).select("property_id", F.lit("s").alias("source_key"), F.lit(None).cast("string").alias("external_id"), F.lit(None).cast("string").alias("url"))
    stored = resolve.property_facts(roles.properties(spark, d), rows)
    listings = resolve.listing_facts(p.select((F.col("id") + 1_000_000).alias("listing_id"), "title", "description", "postcode", "town", "lat", "lon", "geo_precision", "land_sqm", "living_sqm", (F.col("price") * 1.01).alias("price"), "year_built", "property_type", F.lit("s").alias("source_key"), F.lit(None).cast("string").alias("external_id"), F.lit(None).cast("string").alias("url")))
    return resolve.find_duplicates(listings, stored)


@query(_with(roles.PROPERTY_CTE) + "SELECT property_id, array_to_string(list_distinct_(q), '|') AS asked FROM (SELECT property_id, CASE WHEN coalesce(postcode, '') <> '' AND town IS NOT NULL THEN [postcode || ' ' || town, town, postcode] WHEN town IS NOT NULL THEN [town] WHEN coalesce(postcode, '') <> '' THEN [postcode] ELSE [] END AS q FROM property)".replace("list_distinct_(q)", "q"))
def geocode_questions(spark, d):
    p = roles.properties(spark, d).withColumns({"street": F.lit(" "), "district": F.lit(None).cast("string")})
    return p.select("property_id", F.array_join(geo.geocode_queries(), "|").alias("asked"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 DAY THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id AS property_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k")
def sighting_sessions(spark, d):
    """Sightings of a property that follow each other within two days, as sessions."""
    from ..streaming import sessions

    e = roles.table(spark, d, "events").select(F.col("user_id").alias("property_id"), "ts")
    return sessions(e, "ts", "property_id", "2 days").select("property_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query(_with(roles.PROPERTY_CTE) + "SELECT property_id, CASE WHEN driving_km IS NULL THEN 'nicht geprüft' ELSE replace(format('{:.1f}', driving_km), '.', ',') || ' km' END AS driving, CASE listing_status WHEN 'removed' THEN 'Entfernt' WHEN 'stale' THEN 'Veraltet' WHEN 'discovered' THEN 'Entdeckt' WHEN 'sold' THEN 'Verkauft' ELSE 'Aktiv' END AS status, strftime(first_seen, '%d.%m.%Y %H:%M') AS first_seen, CASE property_id % 4 WHEN 0 THEN 'vor einem Monat' WHEN 1 THEN 'gestern' WHEN 2 THEN 'vor 2 Jahren' ELSE 'heute' END AS seen FROM property")
def reader_formats(spark, d):
    p = roles.properties(spark, d)
    days = F.element_at(F.array(*map(F.lit, (35.0, 1.5, 800.0, 0.2))), (F.col("property_id") % 4 + 1).cast("int"))
    return p.select("property_id", german_format.driving(F.col("driving_km")).alias("driving"), german_format.status(F.col("listing_status")).alias("status"), german_format.date_time(F.col("first_seen")).alias("first_seen"), german_format.relative_days(days).alias("seen"))


@query("SELECT a.l_partkey AS a, b.l_partkey AS b FROM (SELECT l_partkey, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1) a JOIN (SELECT l_partkey, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1) b ON b.l_partkey = a.l_partkey + 1 WHERE list_has_any(a.s, b.s)")
def shared_sources(spark, d):
    """Neighbouring properties that a source in common proves to be one."""
    li = roles.table(spark, d, "lineitem")
    rows = li.select(F.col("l_partkey").alias("property_id"), F.lit("s").alias("source_key"), F.col("l_suppkey").cast("string").alias("external_id"), F.lit(None).cast("string").alias("url"))
    f = resolve.property_facts(rows.select("property_id").distinct(), rows)
    a, b = f.select(F.struct("*").alias("a")), f.select(F.struct("*").alias("b"))
    judged = resolve.evidence(a.join(b, F.col("b.id") == F.col("a.id") + 1), similarity=False)
    return judged.filter(F.col("is_duplicate") & (F.col("confidence") == resolve.SURE)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query(_with(roles.PROPERTY_SOURCE_CTE, roles.SOURCE_CTE) + "SELECT property_id, source_id, CAST(row_number() OVER (PARTITION BY property_id ORDER BY is_best DESC, role = 'primary' DESC, source_id) AS INT) AS place FROM property_source JOIN source USING (source_id)")
def source_listing(spark, d):
    """Sources of each property in the order a dossier lists them."""
    return digest.source_places(roles.property_sources(spark, d).join(roles.sources(spark, d), "source_id")).select("property_id", "source_id", "place")


@query("SELECT o_orderkey AS run_id, o_orderdate AS finished_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30")
def newest_runs(spark, d):
    o = roles.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.struct("o_orderdate", "o_orderkey").alias("k"), F.col("o_orderdate").alias("finished_at"))
    return digest.newest(o, "k").select("run_id", "finished_at")


@query(oracles._scored(SHIPPED) + "SELECT property_id, coalesce(CAST(final_score AS VARCHAR), '') <> '' AS scored, title, coalesce(town, '') AS town, '' AS marked FROM scored")
def export_table(spark, d):
    return digest.export_rows(_scored(spark, d)).select(F.col("property_id").cast("long").alias("property_id"), (F.col("final_score") != "").alias("scored"), "title", "town", "marked")


_SEGMENTS = "merkliste|merkzettel|favoriten|suchagent|login|logout|anmelden|abmelden|register|registrieren|impressum|datenschutz|agb|kontakt|suche|search"


@query(
    f"WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') || CASE page_id % 9 WHEN 0 THEN '/Suche.html' WHEN 1 THEN '/forschungssuche' ELSE '' END AS path FROM pages) "
    f"SELECT page_id, CASE WHEN regexp_matches(lower(path), '(^|/)({_SEGMENTS})(\\.[a-z0-9]+)?(/|$)') OR page_id % 7 = 3 THEN 'utility' WHEN page_id % 5 = 1 THEN 'index' WHEN page_id % 5 = 2 THEN 'listing' WHEN page_id % 20 >= 10 THEN 'index' ELSE 'listing' END AS kind FROM p"
)
def page_kinds(spark, d):
    """Kinds of pages by address, headline, declaration and sibling links."""
    p = roles.table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("u"))
    n = F.col("page_id")
    url = F.concat("u", F.when(n % 9 == 0, "/Suche.html").when(n % 9 == 1, "/forschungssuche").otherwise(""))
    title = F.when(n % 7 == 3, "Datenschutzerklärung").otherwise("Hof")
    declares = F.when(n % 5 == 1, "index").when(n % 5 == 2, "listing")
    return p.select("page_id", files.page_kind(url, title, (n % 20).cast("int"), declares).alias("kind"))
