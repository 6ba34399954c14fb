"""The expressions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

# SQL functions are expanded by the planner: no Python runs.
DEFINITIONS = (
    "ll_band(km DOUBLE, soft DOUBLE, hard DOUBLE) RETURNS STRING RETURN CASE WHEN km IS NULL THEN 'unknown' WHEN km <= soft THEN 'within_soft' WHEN km <= hard THEN 'within_hard' ELSE 'beyond' END",
    "ll_normalize(t STRING) RETURNS STRING RETURN trim(regexp_replace(regexp_replace(replace(replace(replace(replace(lower(t), 'ß', 'ss'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), '(?U)[^\\\\w\\\\s]', ' '), '(?U)\\\\s+', ' '))",
    "ll_haversine_km(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN CASE WHEN a + b + c + d IS NOT NULL THEN 2 * 6371.0088D * "
    "asin(least(1.0D, sqrt(power(sin((radians(c) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(c)) * power(sin((radians(d) - radians(b)) / 2), 2)))) END",
    "ll_slug(t STRING) RETURNS STRING RETURN replace(ll_normalize(t), ' ', '_')",
    "ll_text_hash(t STRING) RETURNS STRING RETURN sha2(ll_normalize(t), 256)",
    "ll_number(v DOUBLE, digits INT) RETURNS STRING RETURN coalesce(translate(format_number(bround(v, 0) + CASE WHEN digits > 0 THEN v - bround(v, 0) ELSE 0 END, digits), ',.', '.,'), 'k. A.')",
    "ll_euro(v DOUBLE) RETURNS STRING RETURN CASE WHEN v IS NULL THEN 'k. A.' ELSE concat(ll_number(v, 0), ' €') END",
    "ll_km(v DOUBLE) RETURNS STRING RETURN CASE WHEN v IS NULL THEN 'k. A.' ELSE concat(ll_number(v, 1), ' km') END",
    "ll_is_web_url(u STRING) RETURNS BOOLEAN RETURN coalesce(u RLIKE '^https?://', FALSE)",
    "ll_week(t TIMESTAMP) RETURNS STRING RETURN concat('KW ', lpad(CAST(weekofyear(t) AS STRING), 2, '0'), ' / ', CAST(extract(YEAROFWEEK FROM t) AS STRING))",
    "ll_within_driving(km DOUBLE, hard DOUBLE) RETURNS BOOLEAN RETURN km <= hard",
)


def register(spark: SparkSession) -> list[str]:
    """Define the functions for the session; gives their names."""
    for d in DEFINITIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {d}")
    from ..operators.resolve import _ratio

    spark.udf.register("ll_token_set_ratio", _ratio)
    return [d.split("(")[0] for d in DEFINITIONS] + ["ll_token_set_ratio"]
