"""The driver's tables in their roles: sources, properties, sightings, journals.

The expressions are written in the part of SQL that Spark and DuckDB share, so a query and its oracle read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "1998-12-01"

SOURCE = {
    "source_id": "s_suppkey", "source_key": "s_name", "role": "CASE s_suppkey % 3 WHEN 0 THEN 'discovery' WHEN 1 THEN 'primary' ELSE 'local' END",
    "reliability": "CAST(s_suppkey % 10 AS DOUBLE) / 10", "town_key": "s_nationkey",
}
PROPERTY = {
    "property_id": "p_partkey", "title": "p_name",
    "property_type": "CASE p_partkey % 6 WHEN 0 THEN 'hofstelle' WHEN 1 THEN 'sacherl' WHEN 2 THEN 'wohnung' WHEN 3 THEN 'reihenhaus' WHEN 4 THEN '' ELSE 'bauernhof' END",
    "description": "CASE p_partkey % 10 WHEN 0 THEN 'Hofstelle in Alleinlage mit Stadel und Stall' WHEN 1 THEN 'Bauernhof am Ortsrand, teilbar' WHEN 2 THEN 'Fachwerk, Denkmal, Weiler' WHEN 3 THEN 'provisionsfrei von privat, renoviert' WHEN 4 THEN 'Bebauungsplan liegt vor; Scheune, Tenne' WHEN 5 THEN 'Chiffre 123, sanierungsbedarf' WHEN 6 THEN 'positiver Bauvorbescheid, Einöde' WHEN 7 THEN 'Großzügig und saniert' WHEN 8 THEN NULL ELSE 'Entkernt, Ruine' END",
    "sheds": "CASE p_partkey % 4 WHEN 0 THEN 'stadel,tenne' WHEN 1 THEN 'garage' WHEN 2 THEN 'pavillon,stall' ELSE '' END", "excluded": "CASE p_partkey % 9 WHEN 0 THEN 'neubau' ELSE '' END",
    "condition": "CASE p_partkey % 8 WHEN 0 THEN 'gut' WHEN 1 THEN 'desolat' WHEN 2 THEN 'unbekannt' WHEN 3 THEN 'mittel' ELSE NULL END",
    "price": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(floor(p_retailprice) AS DOUBLE) * 400 END", "price_type": "CASE p_partkey % 7 WHEN 0 THEN 'rent' WHEN 1 THEN 'negotiable' WHEN 2 THEN 'on_request' WHEN 3 THEN 'auction_min' WHEN 4 THEN 'unknown' ELSE 'asking' END",
    "land_sqm": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST((p_partkey * 37) % 12000 AS DOUBLE) END", "living_sqm": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(80 + (p_partkey * 13) % 220 AS DOUBLE) END",
    "usable_sqm": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(200 + ((p_partkey * 17) % 60) * 8 AS DOUBLE) END", "year_built": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(1800 + (p_partkey * 7) % 225 AS INT) END",
    "air_km": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST((p_partkey * 29) % 1200 AS DOUBLE) / 10 END", "driving_km": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST((p_partkey * 41) % 1600 AS DOUBLE) / 10 END",
    "lat": "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 47.0 + CAST((p_partkey * 31) % 1000 AS DOUBLE) / 1000 END", "lon": "11.0 + CAST((p_partkey * 53) % 1000 AS DOUBLE) / 1000",
    "geo_precision": "CASE p_partkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'street' WHEN 2 THEN 'town' WHEN 3 THEN 'postcode' ELSE 'none' END", "postcode": "CASE WHEN p_partkey % 6 = 0 THEN '' ELSE CAST(83000 + p_partkey % 400 AS VARCHAR(5)) END",
    "town": "CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE concat('Ort ', CAST(p_partkey % 90 AS VARCHAR(9))) END", "listing_status": "CASE p_partkey % 12 WHEN 0 THEN 'removed' WHEN 1 THEN 'stale' WHEN 2 THEN 'discovered' WHEN 3 THEN 'sold' ELSE 'active' END",
    "verification_status": "CASE WHEN p_partkey % 3 = 0 THEN 'unverified' ELSE 'verified' END", "is_private_seller": "p_partkey % 10 = 3", "is_monument": "p_partkey % 10 = 2", "is_foreclosure": "p_partkey % 21 = 0", "is_off_market_signal": "p_partkey % 25 = 0",
    "price_reduction_count": "CAST(p_partkey % 4 AS INT)", "n_images": "CAST(p_partkey % 6 AS INT)", "user_state": "CASE p_partkey % 15 WHEN 0 THEN 'archived' WHEN 1 THEN 'watch' ELSE NULL END", "user_tier": "CASE p_partkey % 40 WHEN 0 THEN 'Light ' WHEN 1 THEN 'bogus' ELSE NULL END",
    "first_seen": "CAST('1995-01-01' AS TIMESTAMP) + make_interval(0, 0, 0, CAST(p_partkey % 1400 AS INT))", "last_verified": "CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE CAST('1998-06-01' AS TIMESTAMP) + make_interval(0, 0, 0, CAST(p_partkey % 180 AS INT)) END",
    "source_date": "CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE CAST('1998-01-01' AS TIMESTAMP) + make_interval(0, 0, 0, CAST(p_partkey % 330 AS INT)) END", "last_seen": "CAST('1998-03-01' AS TIMESTAMP) + make_interval(0, 0, 0, CAST(p_partkey % 270 AS INT))",
}
SIGHTING = {
    "property_id": "l_partkey", "source_id": "l_suppkey % 7", "verifies": "(l_suppkey % 7) % 3 <> 0", "visible": "l_returnflag <> 'R'", "ts": "l_shipdate", "price": "CASE WHEN l_quantity < 10 THEN NULL ELSE l_extendedprice / l_quantity END",
    "land_sqm": "CASE WHEN l_tax > 0.04 THEN NULL ELSE l_quantity * 100 END", "title": "CASE WHEN l_discount < 0.02 THEN ' ' ELSE l_linestatus END", "text_hash": "l_linestatus", "contact_kind": "CASE WHEN l_linenumber = 1 THEN 'private' WHEN l_linenumber = 2 THEN 'broker' ELSE NULL END",
    "url": "concat('https://x/', CAST(l_suppkey AS VARCHAR(20)))", "supplier": "l_suppkey", "l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber",
}
ORDER = ("ts", "l_orderkey", "l_linenumber", "supplier")


def _spark(expr: str) -> str:
    return expr.replace("AS VARCHAR(5))", "AS STRING)").replace("AS VARCHAR(9))", "AS STRING)").replace("AS VARCHAR(20))", "AS STRING)")


def _duck(expr: str) -> str:
    return expr.replace("make_interval(0, 0, 0, CAST(", "to_days(CAST(")


def cte(name: str, columns: dict[str, str], table: str) -> str:
    """The role as a DuckDB common table expression."""
    return f"{name} AS (SELECT " + ", ".join(f"{_duck(e)} AS {c}" for c, e in columns.items()) + f" FROM {table})"


SOURCE_CTE, PROPERTY_CTE = cte("source", SOURCE, "supplier"), cte("property", PROPERTY, "part")
SIGHTING_CTE = cte("sighting0", SIGHTING, "lineitem") + ", sighting AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY ts, l_orderkey, l_linenumber, supplier) AS seq FROM sighting0)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{_spark(e)} AS {c}" for c, e in columns.items()])


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as(table(spark, sf_dir, "supplier"), SOURCE)


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    out = _as(table(spark, sf_dir, "part"), PROPERTY)
    none = F.array().cast("array<string>")
    return out.withColumns({"outbuildings": tags("sheds"), "exclusion_flags": tags("excluded"), "building_features": none, "special_features": none, "evidence_keys": none}).drop("sheds", "excluded")


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ``seq``, a total order within a property, as a struct: no window is spent on numbering."""
    return _as(table(spark, sf_dir, "lineitem"), SIGHTING).withColumn("seq", F.struct(*ORDER))


def property_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per property and supplier that was seen together.

    Pairs hardly repeat within a task, so sightings go to their property first: nothing is grouped before the shuffle, and what is grouped by property next stays
    in place.  The partitions stay as many as the session has for shuffles, so that a task's groups stay few.  Texts are told from flags, which are grouped without a sort.
    """
    li = table(spark, sf_dir, "lineitem").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_partkey")
    line = lambda n: F.coalesce(F.bool_or(F.col("l_linenumber") == n), F.lit(False))
    return li.groupBy(F.col("l_partkey").alias("property_id"), F.col("l_suppkey").alias("source_id")).agg(
        F.max("l_shipdate").alias("source_date"), F.when(line(2), "broker").when(line(1), "private").alias("contact_kind"),
        F.when(F.bool_or(F.col("l_discount") > 0.05), "x").alias("contact_detail"), (F.min("l_linenumber") == 1).alias("is_best"), F.bool_or(F.col("l_returnflag") != "R").alias("visible"), F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"),
    )


PROPERTY_SOURCE_CTE = """property_source AS (SELECT l_partkey AS property_id, l_suppkey AS source_id, max(l_shipdate) AS source_date,
  min(CASE WHEN l_linenumber = 1 THEN 'private' WHEN l_linenumber = 2 THEN 'broker' END) AS contact_kind, max(CASE WHEN l_discount > 0.05 THEN 'x' END) AS contact_detail,
  min(l_linenumber) = 1 AS is_best, bool_or(l_returnflag <> 'R') AS visible, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1, 2)"""

#: Where a sighting places its property, and when the listing is dated.
SIGHTING_PLACE = {
    "lat": "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 47.0 + CAST(l_suppkey % 100 AS DOUBLE) / 100 END", "lon": "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 11.0 + CAST(l_orderkey % 100 AS DOUBLE) / 100 END",
    "geo_precision": "CASE l_orderkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'street' WHEN 2 THEN 'town' WHEN 3 THEN 'postcode' ELSE NULL END", "air_km": "CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE CAST(l_orderkey % 200 AS DOUBLE) END",
    "driving_km": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_orderkey % 300 AS DOUBLE) END", "driving_minutes": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_orderkey % 400 AS DOUBLE) END", "routed": "l_orderkey % 3 = 0",
    "source_date": "CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE l_shipdate END",
}
PLACED_CTE = cte("placed0", {**SIGHTING, **SIGHTING_PLACE}, "lineitem") + ", placed AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY ts, l_orderkey, l_linenumber, supplier) AS seq FROM placed0)"


def placed_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings with places and dates."""
    return _as(table(spark, sf_dir, "lineitem"), {**SIGHTING, **SIGHTING_PLACE}).withColumn("seq", F.struct(*ORDER))
