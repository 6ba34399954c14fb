"""The registered queries in DuckDB's SQL, written from the rules rather than from the DataFrame code."""

from __future__ import annotations

import re

from ..functions.towns import TOWNS
from ..operators import cost, score
from ..search_profile import BUILT_IN, SHIPPED
from .queries import TERMS
from .roles import PROPERTY_CTE, PROPERTY_SOURCE_CTE, SIGHTING_CTE, SOURCE_CTE

NOW = "TIMESTAMP '1998-12-01'"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _band(x: str, bands, default: float = 0.0, sign: str = "<=") -> str:
    slack = "+ 1e-9" if sign == "<=" else "- 1e-9"
    return "CASE " + " ".join(f"WHEN {x} {sign} {t!r} {slack} THEN {p!r}" for t, p in bands) + f" ELSE {default!r} END"


def _any(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


def _fold(x: str) -> str:
    return f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(lower(coalesce({x}, '')), 'ß', 'ss'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), '-', ' '), '/', ' '), '\\s+', ' ', 'g'))"


def _days(ts: str) -> str:
    return f"greatest(0.0, (epoch_us({NOW}) - epoch_us({ts})) / 86400000000.0)"


COSTED = f"""tagged AS (SELECT *, trim(concat_ws(' ', '', replace(sheds, ',', ' '), '', excluded, {_fold('condition')})) AS tags, {_fold('condition')} AS cond FROM property),
stated AS (SELECT *, greatest(CASE WHEN {_any('tags', cost.COMPLETE)} THEN 3 WHEN {_any('tags', cost.HEAVY)} THEN 2 WHEN {_any('tags', cost.MEDIUM)} THEN 1 WHEN {_any('tags', cost.LIGHT)} THEN 0 ELSE -1 END,
  CASE WHEN cond IN ('', 'unknown', 'unbekannt', 'conflicting') THEN -1 {' '.join(f"WHEN contains(cond, '{k}') THEN {v}" for k, v in cost.CONDITIONS.items())} ELSE -1 END) AS st FROM tagged),
tiered AS (SELECT *, lower(trim(user_tier)) AS own, CASE WHEN st < 0 THEN CASE WHEN year_built IS NULL OR year_built < 1960 THEN 2 WHEN year_built < 1995 THEN 1 ELSE 0 END
  WHEN year_built < 1960 AND st < 2 THEN st + 1 ELSE st END AS auto FROM stated),
rated AS (SELECT *, CASE WHEN own IN ('light', 'medium', 'heavy', 'complete') THEN own ELSE ['light', 'medium', 'heavy', 'complete'][auto + 1] END AS renovation_tier,
  CASE WHEN own IN ('light', 'medium', 'heavy', 'complete') THEN 'manual' WHEN st >= 0 THEN 'observed' ELSE 'inferred' END AS renovation_evidence,
  CASE WHEN living_sqm > 0 THEN living_sqm WHEN usable_sqm > 0 THEN usable_sqm * 0.45 ELSE 180.0 END AS living,
  CASE sheds WHEN 'stadel,tenne' THEN 300.0 WHEN 'garage' THEN 40.0 WHEN 'pavillon,stall' THEN 250.0 ELSE 0.0 END AS shed_area,
  CASE WHEN price > 0 THEN round(price * (0.035 + 0.015 + 0.005 + 0.0357), 2) ELSE 0.0 END AS acquisition_costs FROM tiered)"""


def _costed(profile) -> str:
    r = profile.renovation
    low = "CASE renovation_tier " + " ".join(f"WHEN '{t}' THEN {getattr(r, t)[0]}" for t in cost.TIERS) + " END"
    high = "CASE renovation_tier " + " ".join(f"WHEN '{t}' THEN {getattr(r, t)[1]}" for t in cost.TIERS) + " END"
    fixed = "living / 1.6 * 1.5 * 350.0 + shed_area * 450.0 + 80000.0"
    return COSTED + f""",
ren AS (SELECT *, (living * {low} + ({fixed})) * 1.2 AS rl, (living * (({low} + {high}) / 2) + ({fixed})) * 1.2 AS rm, (living * {high} + ({fixed})) * 1.2 AS rh FROM rated),
costed AS (SELECT *, CASE WHEN price <> 0 THEN price END AS purchase_price, round(rl, 2) AS renovation_low, round(rm, 2) AS renovation_mid, round(rh, 2) AS renovation_high,
  round(coalesce(price, 0.0) + acquisition_costs + 25000.0 + rl, 2) AS total_low, round(coalesce(price, 0.0) + acquisition_costs + 25000.0 + rm, 2) AS total_mid, round(coalesce(price, 0.0) + acquisition_costs + 25000.0 + rh, 2) AS total_high FROM ren)"""


def _fitted(profile, base: str = "costed") -> str:
    b = profile.budget
    blob = f"concat_ws(' | ', '', replace(sheds, ',', ' | '), '', excluded, {_fold('title')}, {_fold('property_type')}, {_fold('description')})"
    price = (*score.PRICE, (b.purchase_negotiation / b.purchase_target, score.NEGOTIATION))
    return f"""worded AS (SELECT *, {blob} AS t FROM {base}),
fitted0 AS (SELECT *, CASE WHEN air_km IS NULL THEN 0.0 ELSE {_band(f'(air_km / {profile.radius.air_km_max!r})', score.GEOGRAPHY)} END AS fit_geography,
  CASE WHEN price <> 0 THEN {_band(f'(price / {b.purchase_target!r})', price)} ELSE 0.0 END AS fit_price,
  CASE WHEN land_sqm <> 0 THEN {_band(f'(land_sqm / {profile.land_preferred!r})', score.LAND, score.LAND_TOP, '<')} ELSE 0.0 END AS fit_land,
  CASE WHEN {_any('t', score.CORE)} THEN 10.0 ELSE 0.0 END + CASE WHEN is_monument OR {_any('t', score.HISTORIC)} OR coalesce(year_built < 1900, FALSE) THEN 5.0 ELSE 0.0 END
    + CASE WHEN {_any('t', score.BARN)} THEN 3.0 ELSE 0.0 END + CASE WHEN {_any('t', score.STABLE)} THEN 2.0 ELSE 0.0 END AS fit_substance,
  CASE WHEN {_any('t', score.ALONE)} THEN 10.0 WHEN {_any('t', score.EDGE)} THEN 7.0 WHEN {_any('t', score.LOOSE)} THEN 4.0 ELSE 1.0 END AS fit_seclusion,
  CASE WHEN {_any('t', score.PROVABLE)} THEN 10.0 WHEN {_any('t', score.BUILDING_LAW)} THEN 7.0 WHEN {_any('t', score.PLAUSIBLE)} THEN 4.0 ELSE 0.0 END AS fit_development,
  CASE {' + '.join(f'CASE WHEN {_any("t", s)} THEN 1 ELSE 0 END' for s in score.SHEDS)} WHEN 0 THEN 0.0 WHEN 1 THEN 4.0 WHEN 2 THEN 7.0 ELSE 10.0 END AS fit_outbuildings FROM worded),
fitted AS (SELECT *, round(fit_geography + fit_price + fit_land + fit_substance + fit_seclusion + fit_development + fit_outbuildings, 2) AS fit_score FROM fitted0)"""


def _dealt(profile, base: str = "fitted") -> str:
    b = profile.budget
    total = (*score.TOTAL_COST, (b.total_exceptional / b.total_max, score.EXCEPTIONAL_POINTS), (b.total_hard_max / b.total_max, score.HARD_POINTS))

    def sqm(area: str, ref: float) -> str:
        return f"CASE WHEN price <> 0 AND {area} <> 0 THEN 20.0 * {_band(f'(price / {area} / {ref!r})', score.PER_SQM)} ELSE 8.0 END"

    return f"""deal0 AS (SELECT *, CASE WHEN purchase_price > 0 THEN renovation_mid / purchase_price END AS share,
  CASE WHEN total_mid > {b.total_hard_max} THEN 0.0 ELSE {_band(f'(total_mid / {b.total_max!r})', total)} END AS deal_cost,
  {sqm('land_sqm', b.purchase_target / profile.land_strong)} AS deal_land, {sqm('living_sqm', b.purchase_target / 200.0)} AS deal_living,
  CASE WHEN total_mid > {b.total_hard_max} THEN 'extreme' WHEN total_mid > {b.total_max} THEN 'high' WHEN total_mid / {b.total_max} > 0.9 THEN 'moderate' ELSE 'low' END AS plain FROM {base}),
deal1 AS (SELECT *, CASE WHEN share IS NULL THEN 8.0 ELSE 20.0 * {_band('(share / 1.5)', score.RENOVATION)} END AS deal_renovation,
  CASE WHEN coalesce(share > 1.5, FALSE) AND plain IN ('low', 'moderate') THEN 'high' ELSE plain END AS capital_risk,
  concat_ws(',', CASE WHEN total_mid > {b.total_max} THEN 'OVER_BUDGET' END, CASE WHEN total_mid > {b.total_exceptional} AND total_mid <= {b.total_hard_max} THEN 'EXCEPTIONAL_BUDGET_BAND' END, CASE WHEN share > 1.5 THEN 'SANIERUNGSRISIKO' END) AS deal_flags FROM deal0),
dealt AS (SELECT *, round(CASE WHEN capital_risk = 'extreme' THEN least(deal_cost + deal_land + deal_living + deal_renovation, 10.0) ELSE deal_cost + deal_land + deal_living + deal_renovation END, 2) AS deal_score FROM deal1)"""


def _scored(profile) -> str:
    r, g, b, w = profile.radius, profile.gates, profile.budget, profile.weights
    online = f"greatest({_days('first_seen')}, CASE WHEN source_date IS NULL THEN 0.0 ELSE {_days('source_date')} END)"
    best = "greatest(source_date, CASE WHEN verifying AND verification_status = 'verified' THEN last_verified END, CASE WHEN verifying THEN verified_date END)"
    case = lambda x, table, d=0.0: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {d!r} END"
    complete = " + ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END" for t in ("price <> 0", "land_sqm <> 0", "living_sqm <> 0", "year_built <> 0", "condition <> ''", "property_type <> ''", "town <> ''", "lat <> 0", "description <> ''"))
    return _with(PROPERTY_CTE, SOURCE_CTE, PROPERTY_SOURCE_CTE, _costed(profile), _fitted(profile), _dealt(profile)) + f""",
ps AS (SELECT a.property_id, a.source_id, a.source_date, a.contact_kind, a.contact_detail, a.is_best, s.role, s.reliability, s.role IN ('primary', 'local') AS v FROM property_source a JOIN source s USING (source_id)),
facts AS (SELECT property_id AS fid, count(*) AS n_sources, coalesce(bool_or(contact_kind = 'private'), FALSE) AS private_contact, coalesce(bool_or(contact_kind = 'broker'), FALSE) AS broker_contact, bool_or(contact_kind IS NOT NULL) AS any_contact,
  coalesce(bool_or(contact_kind = 'private' AND contact_detail IS NOT NULL), FALSE) AS owner_contact, bool_or(role = 'local' AND reliability <= 0.75) AS small_local, bool_or(v) AS verifying, max(CASE WHEN v THEN source_date END) AS verified_date FROM ps GROUP BY 1),
bests AS (SELECT property_id AS bid, role AS best_role, reliability AS best_reliability FROM ps QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY is_best DESC, v DESC, reliability DESC, source_id ASC) = 1),
joined AS (SELECT d.*, coalesce(n_sources, 0) AS ns, coalesce(private_contact, FALSE) AS pc, coalesce(broker_contact, FALSE) AS bc, coalesce(any_contact, FALSE) AS ac, coalesce(owner_contact, FALSE) AS oc, coalesce(small_local, FALSE) AS sl, coalesce(verifying, FALSE) AS verifying, verified_date, best_role, best_reliability
  FROM dealt d LEFT JOIN facts ON fid = property_id LEFT JOIN bests ON bid = property_id),
timed AS (SELECT *, {online} AS online, {best} AS best_date FROM joined),
sig AS (SELECT *, online >= 730 AS is_stale, round(least(100.0, greatest(0.0, CASE WHEN is_private_seller OR pc THEN 15.0 ELSE 0.0 END + CASE WHEN price_type IN ('negotiable', 'on_request') THEN 8.0 ELSE 0.0 END + CASE WHEN online >= 180 THEN 10.0 ELSE 0.0 END
    - CASE WHEN online >= 730 THEN 10.0 ELSE 0.0 END + CASE WHEN price_reduction_count >= 2 THEN 12.0 ELSE 0.0 END + CASE WHEN n_images <= 2 AND length(coalesce(description, '')) < 400 THEN 5.0 ELSE 0.0 END + CASE WHEN sl THEN 8.0 ELSE 0.0 END
    + CASE WHEN {_any('t', score.CHIFFRE)} THEN 15.0 ELSE 0.0 END + CASE WHEN NOT bc AND ({_any('t', score.NO_BROKER)} OR ac) THEN 5.0 ELSE 0.0 END + CASE WHEN oc THEN 10.0 ELSE 0.0 END + CASE WHEN is_foreclosure THEN 15.0 ELSE 0.0 END + CASE WHEN is_off_market_signal THEN 20.0 ELSE 0.0 END)), 2) AS hidden_score,
  round(CASE WHEN best_date IS NULL THEN 0.0 WHEN online >= 730 THEN greatest(0.0, {_band('(' + _days('best_date') + ')', score.FRESHNESS)} - 10.0) ELSE {_band('(' + _days('best_date') + ')', score.FRESHNESS)} END, 2) AS freshness_score,
  round(least(100.0, greatest(0.0, 0.30 * CASE WHEN best_role IS NULL THEN 0.0 ELSE 100.0 * best_reliability * {case('best_role', score.ROLE_FACTOR, 0.55)} END
    + 0.20 * CASE WHEN listing_status IN ('removed', 'sold') OR last_verified IS NULL OR NOT (verification_status = 'verified' OR verifying) THEN 0.0 ELSE {_band('(' + _days('last_verified') + ')', score.AVAILABILITY, 25.0)} END
    + 0.20 * {case('geo_precision', score.PRECISION_POINTS)} + 0.15 * {case('price_type', score.PRICE_TYPE_POINTS)} + 0.10 * (100.0 * ({complete}) / 9) + 0.05 * CASE WHEN ns >= 2 THEN 100.0 WHEN ns = 1 THEN 70.0 ELSE 40.0 END)), 2) AS conf FROM timed),
capped AS (SELECT *, CASE WHEN driving_km IS NULL THEN least(conf, 65.0) ELSE conf END AS confidence_score FROM sig),
final AS (SELECT *, round({w.fit!r} * fit_score + {w.deal!r} * deal_score + {w.hidden!r} * hidden_score + {w.freshness!r} * freshness_score + {w.confidence!r} * confidence_score, 2) AS final_score, confidence_score < {g.shortlist_confidence} AS shortlist_blocked,
  fit_development >= 8 AS carve, renovation_evidence = 'inferred' AS guess, sheds <> '' OR (property_type <> '' AND property_type NOT IN ('eigentumswohnung', 'doppelhaushaelfte', 'reihenhaus', 'neubau', 'wohnung')) AS farm FROM capped),
scored AS (SELECT *, reject_reasons <> '' AS rejected FROM (SELECT *, concat_ws(',', CASE WHEN air_km > {r.air_km_max} THEN 'AIR_DISTANCE_OVER_LIMIT' END, CASE WHEN driving_km > {r.effective_hard} THEN 'DRIVING_DISTANCE_OVER_LIMIT' END, CASE WHEN price > {b.purchase_hard_max} THEN 'PRICE_OVER_HARD_MAX' END,
  CASE WHEN total_mid > {b.total_hard_max} AND NOT carve AND NOT guess THEN 'TOTAL_COST_OVER_HARD_MAX' END, CASE WHEN total_mid > {b.total_exceptional} AND total_mid <= {b.total_hard_max} AND NOT carve AND NOT guess THEN 'EXCEPTIONAL_BUDGET_WITHOUT_DEVELOPMENT' END,
  CASE WHEN confidence_score < {g.keep_confidence} THEN 'OBSERVATION_ONLY' END, CASE WHEN listing_status IN ('removed', 'sold') THEN 'LISTING_REMOVED_OR_SOLD' END, CASE WHEN excluded <> '' AND NOT farm THEN 'EXCLUDED_PROPERTY_TYPE' END, CASE WHEN price_type = 'rent' THEN 'RENTAL_NOT_FOR_SALE' END) AS reject_reasons FROM final))
"""


_RUNNING = """run AS (SELECT *, coalesce(last_value(CASE WHEN verifies THEN price END IGNORE NULLS) OVER w, first_value(CASE WHEN NOT verifies THEN price END IGNORE NULLS) OVER w) AS np
  FROM sighting WINDOW w AS (PARTITION BY property_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
moves AS (SELECT *, lag(np) OVER (PARTITION BY property_id ORDER BY seq) AS op FROM run),
journal AS (SELECT property_id, seq, l_orderkey, ts, op AS old_price, np AS new_price, np - op AS delta_abs FROM moves WHERE np IS NOT NULL AND np IS DISTINCT FROM op AND (op IS NULL OR abs(np - op) >= 1)),
cuts AS (SELECT *, CAST(count(*) FILTER (delta_abs < 0) OVER (PARTITION BY property_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS reductions FROM journal)"""

_STATUS = """d AS (SELECT *, CASE WHEN verifies THEN CAST(visible AS INT) - coalesce(lag(CAST(visible AS INT)) OVER (PARTITION BY property_id, source_id ORDER BY seq), 0) ELSE 0 END AS dv FROM sighting),
n AS (SELECT *, sum(dv) OVER (PARTITION BY property_id ORDER BY seq) AS shown FROM d),
s0 AS (SELECT *, CASE WHEN verifies AND visible THEN 'active' WHEN verifies AND shown = 0 THEN 'removed' END AS dec FROM n),
g AS (SELECT *, count(dec) OVER (PARTITION BY property_id ORDER BY seq) AS grp FROM s0),
b AS (SELECT *, max(dec) OVER (PARTITION BY property_id, grp) AS base, count(*) FILTER (NOT verifies) OVER (PARTITION BY property_id, grp ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS others FROM g),
st AS (SELECT *, CASE WHEN base IS NULL OR (base = 'removed' AND others > 0) THEN 'discovered' ELSE base END AS status FROM b)"""

_KINDS = _STATUS + """,
k0 AS (SELECT *, lag(status) OVER p AS os, row_number() OVER p AS rn, row_number() OVER (PARTITION BY property_id, source_id ORDER BY seq) AS sn, lag(text_hash) OVER (PARTITION BY property_id, source_id ORDER BY seq) AS ot,
  coalesce(last_value(CASE WHEN verifies THEN price END IGNORE NULLS) OVER r, first_value(CASE WHEN NOT verifies THEN price END IGNORE NULLS) OVER r) AS np FROM st
  WINDOW p AS (PARTITION BY property_id ORDER BY seq), r AS (PARTITION BY property_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k1 AS (SELECT *, lag(np) OVER (PARTITION BY property_id ORDER BY seq) AS op FROM k0),
k2 AS (SELECT *, rn = 1 AS f, coalesce(status = 'removed' AND os <> 'removed', FALSE) AS rem, coalesce(abs(np - op) >= 1, FALSE) AS pr, coalesce(os = 'removed' AND status <> 'removed', FALSE) AS rev FROM k1),
k3 AS MATERIALIZED (SELECT *, CASE WHEN f THEN 'first_seen' WHEN rem THEN 'removed' WHEN pr THEN 'price_change' WHEN rev THEN 'reactivated' WHEN sn = 1 THEN 'source_change' WHEN ot <> text_hash THEN 'description_change' WHEN status <> os THEN 'status_change' END AS main FROM k2),
kinds AS (SELECT property_id, seq, l_orderkey, l_linenumber, supplier, ts, os AS old_status, status AS new_status, main AS change_kind FROM k3 WHERE main IS NOT NULL
  UNION ALL SELECT property_id, seq, l_orderkey, l_linenumber, supplier, ts, os, status, 'reactivated' FROM k3 WHERE pr AND rev AND NOT f AND NOT rem)"""

_MISSING = _with(PROPERTY_CTE, SOURCE_CTE, PROPERTY_SOURCE_CTE) + f""",
r AS (SELECT a.*, p.listing_status AS status FROM property_source a JOIN property p USING (property_id)),
seen AS (SELECT DISTINCT l_partkey AS property_id, l_suppkey AS source_id FROM lineitem WHERE (l_suppkey % 4 <> 1 OR l_partkey % 7 <> 0) AND l_suppkey % 8 <> 2),
runs AS (SELECT source_id, role IN ('primary', 'local') AS can_verify, source_id % 10 <> 3 AS complete, CASE WHEN source_id % 6 = 1 THEN 900 WHEN source_id % 6 = 5 THEN 0 END AS ttl FROM source),
m AS (SELECT r.*, ttl, s.property_id IS NULL AS missing FROM r JOIN runs USING (source_id) LEFT JOIN seen s ON s.property_id = r.property_id AND s.source_id = r.source_id WHERE visible AND can_verify AND complete),
x AS (SELECT *, missing AND coalesce(ttl > 0 AND epoch_us({NOW}) - epoch_us(first_seen) >= ttl * 86400000000, FALSE) AS expired FROM m),
per AS (SELECT source_id, count(*) AS n, count(*) FILTER (NOT missing) AS s, count(*) FILTER (missing AND NOT expired) AS g FROM x GROUP BY 1),
judged AS (SELECT source_id, CASE WHEN s = 0 THEN 'nothing_seen' WHEN n >= 3 AND g >= 2 AND g >= 0.3 * n THEN 'too_many_missing' END AS reason FROM per)
"""

_BLOCKS = _with(PROPERTY_CTE) + """,
half AS (SELECT *, lower(replace(coalesce(town, ''), ' ', '-')) AS slug, 2.0 / 111.0 AS step FROM property),
f AS (SELECT *, concat_ws('|', coalesce(nullif(postcode, ''), CAST(CAST(round_even(lat / 0.01, 0) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(round_even(lon / 0.01, 0) AS BIGINT) AS VARCHAR), ''), slug,
  coalesce(CAST(CAST(round_even(land_sqm / 500.0, 0) * 500 AS BIGINT) AS VARCHAR), ''), coalesce(CAST(CAST(round_even(living_sqm / 25.0, 0) * 25 AS BIGINT) AS VARCHAR), ''), coalesce(CAST(CAST(round_even(price / 10000.0, 0) * 10000 AS BIGINT) AS VARCHAR), ''), coalesce(CAST(year_built // 10 * 10 AS VARCHAR), '')) AS fp FROM half),
pairs AS (SELECT a.property_id AS a, b.property_id AS b, 2 AS pass FROM f a JOIN f b ON a.fp = b.fp AND a.property_id < b.property_id
 UNION ALL SELECT a.property_id, b.property_id, 3 FROM f a JOIN f b ON a.postcode = b.postcode AND a.property_id < b.property_id WHERE a.postcode <> ''
 UNION ALL SELECT a.property_id, b.property_id, 4 FROM f a JOIN f b ON a.slug = b.slug AND a.property_id < b.property_id WHERE a.slug <> ''
 UNION ALL SELECT a.property_id, b.property_id, 5 FROM f a JOIN f b ON a.property_id < b.property_id AND abs(a.lat - b.lat) <= a.step AND abs(a.lon - b.lon) * cos(radians(a.lat)) <= a.step AND a.lat IS NOT NULL AND b.lat IS NOT NULL),
blocks AS (SELECT a, b, min(pass) AS pass FROM pairs GROUP BY 1, 2)
"""


def _delta(c: str) -> str:
    return f"CASE WHEN greatest(abs(x.{c}), abs(y.{c})) = 0 THEN 0.0 ELSE abs(x.{c} - y.{c}) / greatest(abs(x.{c}), abs(y.{c})) END"


_PAIR = _BLOCKS + f""",
j AS (SELECT x.property_id AS id_a, y.property_id AS id_b, CASE WHEN x.geo_precision IN ('exact', 'street') AND y.geo_precision IN ('exact', 'street') AND x.lat + x.lon + y.lat + y.lon IS NOT NULL THEN 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin((radians(y.lat) - radians(x.lat)) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin((radians(y.lon) - radians(x.lon)) / 2), 2)))) END AS m,
  CASE WHEN x.land_sqm IS NOT NULL AND y.land_sqm IS NOT NULL THEN {_delta('land_sqm')} END AS dl, CASE WHEN x.living_sqm IS NOT NULL AND y.living_sqm IS NOT NULL THEN {_delta('living_sqm')} END AS dv, CASE WHEN x.price IS NOT NULL AND y.price IS NOT NULL THEN {_delta('price')} END AS dp,
  x.year_built AS ya, y.year_built AS yb, CASE WHEN x.postcode <> '' AND y.postcode <> '' THEN x.postcode = y.postcode WHEN x.town IS NOT NULL AND y.town IS NOT NULL THEN x.town = y.town END AS place, x.property_type = y.property_type AND x.property_type <> '' AS kind
  FROM blocks JOIN f x ON x.property_id = a JOIN f y ON y.property_id = b WHERE pass <= 3),
s AS (SELECT *, (CASE WHEN m <= 150 THEN 0.30 WHEN m <= 600 THEN 0.12 WHEN m > 3000 THEN -0.60 ELSE 0.0 END) + (CASE WHEN dl <= 0.05 THEN 0.20 WHEN dl >= 0.25 THEN -0.30 WHEN dl IS NOT NULL THEN -0.20 ELSE 0.0 END) + (CASE WHEN dv <= 0.05 THEN 0.18 WHEN dv >= 0.25 THEN -0.27 WHEN dv IS NOT NULL THEN -0.18 ELSE 0.0 END)
  + (CASE WHEN dp <= 0.03 THEN 0.14 WHEN dp IS NOT NULL THEN -0.05 ELSE 0.0 END) + (CASE WHEN ya = yb THEN 0.10 WHEN ya // 10 = yb // 10 THEN 0.04 WHEN ya IS NOT NULL AND yb IS NOT NULL THEN -0.15 ELSE 0.0 END) + (CASE WHEN place THEN 0.12 WHEN NOT place THEN -0.10 ELSE 0.0 END) + (CASE WHEN kind THEN 0.05 ELSE 0.0 END) AS total,
  CASE WHEN m <= 150 THEN 1 ELSE 0 END + CASE WHEN dl <= 0.05 THEN 1 ELSE 0 END + CASE WHEN dv <= 0.05 THEN 1 ELSE 0 END + CASE WHEN dp <= 0.03 THEN 1 ELSE 0 END + CASE WHEN ya = yb THEN 1 ELSE 0 END AS proofs FROM j),
v AS (SELECT *, greatest(0.0, least(1.0, total)) AS c, coalesce(m > 3000, FALSE) AS veto, coalesce(place, FALSE) AND coalesce(kind, FALSE) AS alike FROM s),
w AS (SELECT *, NOT veto AND c >= 0.70 AND proofs >= 2 AS is_duplicate FROM v)
SELECT id_a, id_b, CAST(proofs AS INT) AS proofs, round(CASE WHEN NOT is_duplicate AND NOT veto AND proofs = 0 AND alike THEN greatest(c, 0.45) ELSE c END, 3) AS confidence, is_duplicate,
  NOT is_duplicate AND NOT veto AND CASE WHEN proofs = 0 THEN alike ELSE round(c, 4) >= 0.40 END AS needs_review FROM w
"""


def _literal_table(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if not isinstance(v, str) else f"'{v}'" for v in r) + ")" for r in rows)


def _by_position(values, key: str = "o_orderkey") -> str:
    return f"SELECT ([{', '.join(repr(v) if not isinstance(v, str) else chr(39) + v + chr(39) for v in values)}])[CAST({key} % {len(values)} + 1 AS INT)]"



TAG_ANSWERS = (
    ("stadel,stall", "alleinlage", "hofstelle,stadel", False, False, False, "hofstelle"), ("", "ortsrand,teilbar", "", False, False, False, "bauernhof"), ("", "", "", True, False, False, None), ("", "", "", False, True, False, None),
    ("scheune,tenne", "bebauungsplan", "", False, False, False, None), ("", "", "", False, False, True, None), ("", "", "einoede", False, False, False, "einoede"), ("", "", "", False, False, False, None), ("", "", "", False, False, False, None), ("", "", "", False, False, False, None),
)
#: Edges join each multiple of 5 (but of 20) with the next, unless the next is a multiple of 3: groups are runs of such links.
MERGED = """e AS (SELECT property_id AS u, property_id + 5 AS v FROM property WHERE property_id % 5 = 0 AND property_id % 20 <> 0 AND (property_id + 5) % 3 <> 0 AND property_id + 5 IN (SELECT property_id FROM property)),
m AS (SELECT p.*, CASE WHEN p.property_id % 5 <> 0 THEN p.property_id ELSE (SELECT max(q.property_id) FROM property q WHERE q.property_id % 5 = 0 AND q.property_id <= p.property_id AND q.property_id NOT IN (SELECT v FROM e)) END AS survivor_id,
  CASE listing_status WHEN 'active' THEN 5 WHEN 'discovered' THEN 2 WHEN 'stale' THEN 1 ELSE 0 END AS rank FROM property p)
SELECT survivor_id, count(*) AS merged, arg_min(price, property_id) FILTER (price IS NOT NULL) AS price, arg_min(land_sqm, property_id) FILTER (land_sqm IS NOT NULL) AS land_sqm, arg_min(town, property_id) FILTER (town IS NOT NULL) AS town, bool_or(is_monument) AS is_monument,
  array_to_string(list_sort(list_distinct(flatten(list(list_filter(string_split(sheds, ','), lambda x: x <> ''))))), ',') AS sheds, arg_max(listing_status, (rank, -property_id)) AS listing_status FROM m GROUP BY 1"""

ORACLES: dict[str, str] = {
    "source_yield": _with(PROPERTY_CTE, SOURCE_CTE) + f"SELECT source_key, count(DISTINCT l_partkey) AS observed, count(DISTINCT CASE WHEN air_km <= 80 THEN l_partkey END) AS in_radius FROM lineitem JOIN property ON property_id = l_partkey JOIN source ON source_id = l_suppkey WHERE l_shipdate >= {NOW} - INTERVAL 400 DAY GROUP BY 1",
    "coverage_zero_fill": _with(PROPERTY_CTE, "e(ord, town) AS (VALUES (0, 'Ort 3'), (1, 'Ort 5'), (2, 'Ort 89'), (3, 'Ort 400'), (4, 'Ort 7'), (5, 'Ort 12'))") + "SELECT ord, e.town, count(p.property_id) AS observed FROM e LEFT JOIN property p ON p.town = e.town GROUP BY 1, 2",
    "digest_counts": _scored(SHIPPED) + "SELECT count(*) FILTER (listing_status NOT IN ('removed', 'sold')) AS tracked, count(*) FILTER (listing_status = 'active') AS active, count(*) FILTER (listing_status = 'removed') AS removed, count(*) FILTER (listing_status = 'stale') AS stale, count(*) FILTER (verification_status = 'verified') AS verified, count(*) FILTER (price IS NULL) AS without_price, count(*) FILTER (air_km IS NULL) AS without_distance, count(*) FILTER (rejected) AS rejected, count(*) FILTER (NOT rejected AND confidence_score >= 60) AS shortlistable, count(*) FILTER (capital_risk IN ('high', 'extreme')) AS risky FROM scored",
    "earliest_evidence": _with(PROPERTY_CTE) + "SELECT property_id, min(ts) AS earliest FROM (SELECT property_id, first_seen AS ts FROM property UNION ALL SELECT property_id, source_date FROM property UNION ALL SELECT l_partkey, l_shipdate FROM lineitem) GROUP BY 1",
    "reject_histogram": _with(PROPERTY_CTE) + "SELECT coalesce(CASE WHEN property_id % 19 = 0 THEN 'not_a_listing' WHEN price_type = 'rent' AND property_id % 2 <> 0 THEN 'rental' WHEN price_type <> 'rent' AND excluded <> '' THEN 'excluded' WHEN property_id % 23 = 0 AND property_id % 2 <> 0 THEN 'triage' WHEN air_km > 80 THEN 'outside_radius' END, 'kept') AS reason, count(*) AS n FROM property GROUP BY 1",
    "reporting_sources": "SELECT l_partkey AS property_id, bool_or(l_suppkey % 5 <> 0) AS reports FROM lineitem GROUP BY 1",
    "absence_guard": _MISSING + "SELECT source_id, reason FROM judged WHERE reason IS NOT NULL",
    "absence_transitions": _MISSING + ", lost AS (SELECT x.* FROM x JOIN judged USING (source_id) WHERE missing AND reason IS NULL), still AS (SELECT DISTINCT r.property_id FROM r JOIN runs USING (source_id) WHERE visible AND can_verify AND (r.source_id, r.property_id) NOT IN (SELECT (source_id, property_id) FROM lost)) SELECT property_id, source_id, expired, CASE WHEN property_id IN (SELECT property_id FROM still) OR status = 'removed' THEN NULL WHEN expired THEN 'expired' ELSE 'removed' END AS new_status FROM lost",
    "best_source": _with(SOURCE_CTE, PROPERTY_SOURCE_CTE) + "SELECT property_id, source_id, role, reliability FROM property_source JOIN source USING (source_id) QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY CASE role WHEN 'primary' THEN 2 WHEN 'local' THEN 1 ELSE 0 END DESC, reliability DESC, last_seen DESC, source_id) = 1",
    "latest_observation": _with(SIGHTING_CTE) + "SELECT property_id, ts, l_orderkey FROM sighting QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY seq DESC) = 1",
    "authority_fold": _with(SIGHTING_CTE) + "SELECT property_id, " + ", ".join(f"coalesce(arg_max({v}, seq) FILTER (verifies AND {v} IS NOT NULL), arg_min({v}, seq) FILTER (NOT verifies AND {v} IS NOT NULL)) AS {c}" for c, v in (("price", "price"), ("land_sqm", "land_sqm"), ("title", "nullif(trim(title), '')"))) + " FROM sighting GROUP BY 1",
    "price_journal": _with(SIGHTING_CTE, _RUNNING) + "SELECT property_id, l_orderkey, ts, old_price, new_price, delta_abs, reductions FROM cuts",
    "price_reductions": _with(SIGHTING_CTE, _RUNNING) + "SELECT property_id, count(*) FILTER (delta_abs < 0) AS cuts, max(reductions) AS reductions FROM cuts GROUP BY 1",
    "status_fold": _with(SIGHTING_CTE, _STATUS) + "SELECT property_id, ts, l_orderkey, l_linenumber, supplier, status FROM st",
    "change_kinds": _with(SIGHTING_CTE, _KINDS) + "SELECT property_id, l_orderkey, l_linenumber, supplier, old_status, new_status, change_kind FROM kinds",
    "change_feed": _with(SIGHTING_CTE, _RUNNING, _KINDS) + f"SELECT k.property_id, p_name AS title, k.ts, old_status, k.new_status, change_kind, c.new_price AS price_then FROM kinds k JOIN part ON p_partkey = k.property_id LEFT JOIN cuts c ON c.property_id = k.property_id AND c.ts <= k.ts WHERE change_kind IN ('removed', 'reactivated') AND k.ts >= {NOW} - INTERVAL 200 DAY QUALIFY row_number() OVER (PARTITION BY k.property_id, k.seq, change_kind ORDER BY c.ts DESC NULLS LAST, c.seq DESC NULLS LAST) = 1",
    "price_asof_status": "SELECT e.user_id AS property_id, e.ts AS at, e.event_id, p.event_id AS price_id, p.value AS price FROM events e LEFT JOIN events p ON p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts WHERE e.event_type <> 'purchase' QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY p.ts DESC NULLS LAST, p.event_id DESC NULLS LAST) = 1",
    "visible_semi": "SELECT p_partkey AS property_id FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag <> 'R' AND l_suppkey % 3 <> 0)",
    "unscored_anti": _scored(SHIPPED) + "SELECT p_partkey AS property_id FROM part WHERE NOT EXISTS (SELECT 1 FROM scored WHERE property_id = p_partkey AND final_score >= 60)",
    "set_difference": _with(PROPERTY_SOURCE_CTE) + "SELECT property_id, source_id FROM property_source WHERE visible EXCEPT ALL SELECT property_id, source_id FROM property_source WHERE is_best",
    "blocking_union": _BLOCKS + "SELECT CAST(pass AS INT) AS pass, count(*) AS pairs, CAST(sum(a) AS BIGINT) AS sum_a, CAST(sum(b) AS BIGINT) AS sum_b FROM blocks GROUP BY 1",
    "fingerprint_blocks": _BLOCKS + "SELECT sha256(fp) AS fingerprint, count(*) AS n, min(property_id) AS first_id FROM f GROUP BY 1",
    "pair_evidence": _PAIR,
    "merge_chain": "SELECT p_partkey AS property_id, CASE WHEN p_partkey = 0 THEN -1 ELSE p_partkey - ((p_partkey - 1) % 8) END AS survivor_id FROM part WHERE p_partkey % 8 <> 1",
    "phash_near": "WITH b0 AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN 1 ELSE 0 END) AS v FROM embeddings), b AS (SELECT * FROM b0 UNION ALL SELECT vec_id + 10000000, list_transform(range(1, 65), lambda i: CASE WHEN i % 8 = 1 AND i <= 1 + 8 * (vec_id % 8) THEN 1 - v[i] ELSE v[i] END) FROM b0), p AS (SELECT x.vec_id AS a, y.vec_id AS b, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN x.v[i] <> y.v[i] THEN 1 ELSE 0 END)) AS INT) AS bits FROM b x JOIN b y ON x.vec_id < y.vec_id) SELECT a, b, bits FROM p WHERE bits <= 14",
    "haversine_bands": _with(PROPERTY_CTE) + f"SELECT property_id, round(CASE WHEN lat + lon IS NOT NULL THEN 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((radians(lat) - radians(47.907)) / 2), 2) + cos(radians(47.907)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(11.84)) / 2), 2)))) END, 6) AS km, CASE WHEN driving_km IS NULL THEN 'unknown' WHEN driving_km <= 100 THEN 'within_soft' WHEN driving_km <= 116 THEN 'within_hard' ELSE 'beyond' END AS band, coalesce(air_km <= 80, FALSE) AS within_air, driving_km <= 116 AS within_driving FROM property",
    "threshold_sweep": "SELECT threshold, event_type AS grp, count(*) FILTER (value >= threshold) AS rejected, count(*) AS total FROM events, (VALUES (10.0::DOUBLE), (50.0), (90.0)) t(threshold) GROUP BY 1, 2",
    "cost_estimate": _with(PROPERTY_CTE, _costed(SHIPPED)) + "SELECT property_id, renovation_tier, renovation_evidence, acquisition_costs, renovation_low, renovation_mid, renovation_high, total_low, total_mid, total_high FROM costed",
    "fit_bands": _with(PROPERTY_CTE, _fitted(SHIPPED, "property")) + "SELECT property_id, " + ", ".join(score.FIT) + ", fit_score FROM fitted",
    "deal_score": _with(PROPERTY_CTE, _costed(SHIPPED), _dealt(SHIPPED, "costed")) + "SELECT property_id, deal_cost, deal_land, deal_living, deal_renovation, capital_risk, deal_score, deal_flags FROM dealt",
    "signal_scores": _scored(SHIPPED) + "SELECT property_id, hidden_score, freshness_score, confidence_score, is_stale FROM scored",
    "gates": _scored(SHIPPED) + "SELECT property_id, reject_reasons, rejected, shortlist_blocked, fit_score, deal_score FROM scored",
    "gates_built_in": _scored(BUILT_IN) + "SELECT property_id, rejected, shortlist_blocked, capital_risk FROM scored",
    "ranked_topk": _scored(SHIPPED) + "SELECT property_id, final_score, shortlist_blocked FROM scored WHERE NOT rejected AND (user_state IS NULL OR user_state <> 'archived') ORDER BY shortlist_blocked, final_score DESC, property_id LIMIT 10",
    "filters_nullsafe": _with(PROPERTY_CTE) + "SELECT property_id, land_sqm, listing_status FROM property WHERE (user_state IS NULL OR user_state = 'watch') AND land_sqm >= 3000 AND listing_status NOT IN ('removed', 'sold') AND sheds <> ''",
    "slider_pass": _scored(SHIPPED) + "SELECT property_id, total_mid FROM scored WHERE NOT coalesce(air_km > 80, FALSE) AND NOT coalesce(price > 900000, FALSE) AND NOT coalesce(total_mid > 1500000, FALSE)",
    "search_substring": _with(PROPERTY_CTE) + "SELECT property_id FROM property WHERE contains(lower(concat_ws(' ', town, title)), 'ort 1')",
    "text_hash_groups": "SELECT n, first_id FROM (SELECT count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY trim(regexp_replace(regexp_replace(replace(replace(replace(replace(lower(text), 'ß', 'ss'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), '[^\\p{L}\\p{N}\\p{M}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) WHERE n > 1",
    "canonical_urls": "WITH u AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h, rtrim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/') AS p, list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND split_part(x, '=', 1) <> 'ref')) AS q, regexp_extract(url, '#(.*)$', 1) AS f FROM pages) SELECT page_id, 'https://' || regexp_replace(lower(h), '^www\\.', '') || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END || CASE WHEN f <> '' THEN '#' || f ELSE '' END AS canonical FROM u",
    "keyword_tags": "WITH n AS (SELECT doc_id, ' ' || trim(regexp_replace(regexp_replace(replace(replace(replace(replace(lower(text), 'ß', 'ss'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), '[^\\p{L}\\p{N}\\p{M}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) || ' ' AS t FROM documents) SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"'{t}'" for t in sorted(TERMS)) + "], lambda x: contains(t, ' ' || x || ' ')), ',') AS tags FROM n",
    "parse_prices": "WITH v AS (SELECT o_orderkey, o_orderkey % 7 AS k, CAST(floor(o_totalprice) AS BIGINT) + 1000 AS v FROM orders) SELECT o_orderkey, CASE k WHEN 1 THEN (v // 1000) * 1000.0::DOUBLE WHEN 5 THEN v + 0.5::DOUBLE WHEN 6 THEN NULL ELSE v * 1.0::DOUBLE END AS value, CASE k WHEN 2 THEN 'negotiable' WHEN 3 THEN 'auction_min' WHEN 4 THEN 'rent' WHEN 6 THEN 'on_request' ELSE 'asking' END AS kind FROM v",
    "parse_areas": "WITH v AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderkey % 9000 + 1 AS n FROM orders) SELECT o_orderkey, CASE k WHEN 0 THEN n * 1.0::DOUBLE WHEN 1 THEN round(n * 1000.0::DOUBLE, 3) WHEN 2 THEN n * 3407.0::DOUBLE WHEN 3 THEN n * 1.0::DOUBLE END AS sqm FROM v",
    "parse_dates": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 3 THEN CAST(date_trunc('week', o_orderdate) AS DATE) WHEN 4 THEN DATE '2026-09-03' - CAST(o_orderkey % 40 + 2 AS INT) WHEN 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders",
    "german_numbers": _with(PROPERTY_CTE) + "SELECT property_id, CASE WHEN price IS NULL THEN 'k. A.' ELSE replace(format('{:,}', CAST(floor(price) AS BIGINT)), ',', '.') || ' €' END AS price, CASE WHEN land_sqm IS NULL THEN 'k. A.' ELSE replace(format('{:,}', CAST(land_sqm AS BIGINT)), ',', '.') || ' m²' END AS land FROM property",
    "iso_week_digest": "SELECT 'KW ' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') || ' / ' || CAST(isoyear(o_orderdate) AS VARCHAR) AS week, count(*) AS n FROM orders GROUP BY 1",
    "timeline_islands": "WITH a AS (SELECT *, CASE WHEN role = 'assistant' AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant' THEN 0 ELSE 1 END AS new FROM conversations), b AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM a) SELECT conv_id AS property_id, CAST(island AS BIGINT) AS island, role AS kind, min(turn) AS first_ts, max(turn) AS last_ts, count(*) AS n FROM b GROUP BY 1, 2, 3",
    "sparkline": "WITH a AS (SELECT user_id, event_id, value, count(*) OVER p AS n, min(value) OVER p AS lo, max(value) OVER p AS hi, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, arg_min(value, event_id) OVER p AS f, arg_max(value, event_id) OVER p AS l FROM events WINDOW p AS (PARTITION BY user_id)) SELECT user_id AS property_id, event_id AS seq, round(CASE WHEN n > 1 THEN (rn - 1) * 120.0::DOUBLE / (n - 1) ELSE 60.0 END, 3) AS x, round(CASE WHEN hi > lo THEN 28.0::DOUBLE - (value - lo) / (hi - lo) * 28.0::DOUBLE ELSE 14.0 END, 3) AS y, CASE WHEN l > f THEN 'up' WHEN l < f THEN 'down' ELSE 'flat' END AS trend FROM a",
    "stale_clock": _with(PROPERTY_CTE, PROPERTY_SOURCE_CTE) + f"SELECT p.property_id, listing_status, 'stale' AS new_status FROM property p LEFT JOIN (SELECT property_id, bool_or(source_id NOT BETWEEN 0 AND 59) AS reports FROM property_source GROUP BY 1) r USING (property_id) WHERE listing_status IN ('active', 'discovered', 'verified', 'price_changed') AND epoch_us({NOW}) - epoch_us(last_seen) > CASE WHEN coalesce(reports, FALSE) THEN 45 ELSE 180 END * 86400000000",
    "yield_tumbling": "SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2",
    "source_row_sync": _with(SIGHTING_CTE) + "SELECT property_id, source_id, url, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(visible, seq) AS visible, arg_max(contact_kind, seq) FILTER (contact_kind IS NOT NULL) AS contact_kind FROM sighting GROUP BY 1, 2, 3",
    "categorise": _with(SIGHTING_CTE, _KINDS, PROPERTY_CTE) + f", j AS (SELECT property_id, bool_or(change_kind = 'reactivated') AS r, bool_or(change_kind = 'price_change') AS p FROM kinds WHERE ts >= {NOW} - INTERVAL 300 DAY GROUP BY 1) SELECT property_id, CASE WHEN r THEN 'reactivated' WHEN first_seen >= {NOW} - INTERVAL 300 DAY THEN 'new' WHEN p THEN 'price_change' ELSE 'known' END AS category FROM property LEFT JOIN j USING (property_id)",
    "cache_lookup": "WITH c AS (SELECT event_type AS kind, user_id AS key, value, TIMESTAMP '2024-01-01' + to_seconds(event_id) AS ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) = 1) SELECT kind, count(*) AS n, count(CASE WHEN epoch_us(TIMESTAMP '2024-02-15') - epoch_us(ts) <= CASE kind WHEN 'click' THEN 45 WHEN 'view' THEN 40 WHEN 'purchase' THEN 60 END * 86400000000 THEN value END) AS fresh FROM c GROUP BY 1",
    "liveness_check": "WITH p AS (SELECT ([200, 404, 410, 503, NULL])[page_id % 5 + 1] AS s, html FROM pages) SELECT CASE WHEN s IS NULL THEN 'alive' WHEN s IN (404, 410) THEN 'gone' WHEN s >= 400 THEN 'unknown_alive' WHEN regexp_matches(lower(html), 'nicht mehr verfügbar|nicht mehr online|wurde deaktiviert|bereits verkauft|no longer available') THEN 'gone' ELSE 'alive' END AS state, regexp_matches(lower(substr(html, 1, 5000)), 'captcha|are you a robot|access denied|zugriff verweigert|checking your browser|cf-challenge') AS wall, count(*) AS n FROM p GROUP BY 1, 2",
    "keyword_hits": "WITH h AS (SELECT doc_id, term, text, strpos(lower(text), term) AS p FROM documents, (VALUES ('license'), ('gpl')) t(term)) SELECT 'u#page=' || doc_id AS url, doc_id AS page, term, substr(text, greatest(1, p - 80), least(p, 81) - 1 + length(term) + 80) AS snippet FROM h WHERE p > 0",
    "marked_list": _scored(SHIPPED) + "SELECT property_id, final_score, rejected FROM scored WHERE property_id % 31 = 0",
    "dossier_facts": _with(PROPERTY_CTE) + "SELECT property_id, 'town' AS field, town AS value FROM property UNION ALL SELECT property_id, 'price_type', price_type FROM property UNION ALL SELECT property_id, 'year_built', CAST(year_built AS VARCHAR) FROM property",
    "parse_places": "WITH c AS (SELECT c_custkey, c_custkey % 6 AS form, 'Bad ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS t, CAST(10000 + c_custkey * 7 % 80000 AS VARCHAR) AS code FROM customer) "
    "SELECT c_custkey, CASE WHEN form = 0 THEN 'Hauptstr. ' || (c_custkey % 200 + 1) END AS street, CASE WHEN form IN (0, 1, 4) THEN code END AS postcode, CASE WHEN form < 5 THEN t END AS town, CASE form WHEN 1 THEN 'Rosenheim' WHEN 4 THEN t END AS district FROM c",
    "town_lookup": f"WITH t(i, name, postcode) AS (VALUES {_literal_table((i, n, p) for i, (n, p, *_) in enumerate(TOWNS))}), f AS (SELECT postcode, arg_min(name, i) AS name FROM t GROUP BY 1) "
    f"SELECT o_orderkey, CASE WHEN o_orderkey // {len(TOWNS)} % 3 = 2 THEN f.name ELSE t.name END AS name, t.postcode FROM orders JOIN t ON i = o_orderkey % {len(TOWNS)} JOIN f USING (postcode)",
    "listing_tags": f"WITH a(k, outbuildings, building_features, special_features, is_monument, is_private_seller, is_off_market_signal, property_type) AS (VALUES {_literal_table((i, *p) for i, p in enumerate(TAG_ANSWERS))}) SELECT outbuildings, building_features, special_features, is_monument, is_private_seller, is_off_market_signal, property_type, count(*) AS n FROM part JOIN a ON k = p_partkey % 10 GROUP BY ALL",
    "best_urls": _with(SOURCE_CTE, PROPERTY_SOURCE_CTE) + "SELECT property_id, 'https://x/' || source_id AS url FROM property_source JOIN source USING (source_id) WHERE source_id % 9 <> 0 QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY is_best DESC, role <> 'discovery' DESC, visible DESC, reliability DESC, source_id) = 1",
    "review_states": _with(PROPERTY_CTE) + f"SELECT property_id, CASE WHEN property_id % 3 = 0 AND (property_id % 100) / 100.0 >= {SHIPPED.gates.triage_probability} THEN 'TRIAGE_SAYS_RENTAL' WHEN property_id % 3 = 1 AND (property_id % 100) / 100.0 >= {SHIPPED.gates.triage_probability} AND sheds = '' THEN 'TRIAGE_SAYS_FLAT' END AS triage_reason, CASE WHEN property_id % 3 < 2 AND NOT ((property_id % 100) / 100.0 >= {SHIPPED.gates.triage_probability} AND (property_id % 3 = 0 OR sheds = '')) THEN 'TRIAGE_DOUBT' ELSE '' END AS flags FROM property",
    "merge_survivors": _with(PROPERTY_CTE) + ", " + MERGED,
    "map_split": _with(PROPERTY_CTE) + "SELECT CASE WHEN lat IS NULL THEN NULL ELSE geo_precision IN ('exact', 'street') END AS precise, count(*) AS n FROM property GROUP BY 1",
}


def _doubles(sql: str) -> str:
    """Written decimals as doubles: DuckDB would take them for exact ones."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", sql)


ORACLES = {name: _doubles(sql) for name, sql in ORACLES.items()}
