"""Verdicts on URLs from host and path rules, by hashed expressions.

A rule names a host and a path prefix.  It fits a URL if the URL's host is the rule's or a subdomain
of it and the URL's path starts with the rule's.  Each URL is expanded into its host suffixes (no
longer, in labels, than the longest rule's) times its path prefixes (of the lengths that rules have),
and each expansion is hashed.  An equi-join on the first 32 bits finds possible rules, the full SHA-256
digest confirms them, and of several the longest wins (of equal ones, ``block``).

Odd inputs: a null URL or one without ``://`` has an empty host and path; only a rule could judge
it, and no rule has an empty host, so it gets the default verdict.  A null id stays null.  Repeated
rows are all returned.  Columns beside the id and the URL are ignored, so their names can't clash.
An empty table gives no rows; empty rules give everyone the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Rule tables of up to so many rows are sent to every executor (about 100 bytes each); larger ones are shuffled.
BROADCAST_RULES = 200_000
PREFIX_HEX = 8


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def _hashed(rules: DataFrame) -> DataFrame:
    text = F.concat(ascii_lower(F.col("host")), F.col("path"))
    kept = rules.filter(F.col("host").isNotNull() & (F.col("host") != "") & F.col("path").isNotNull())
    out = kept.select(text.alias("rule"), "verdict", F.sha2(text, 256).alias("digest"), F.length(text).alias("rule_length"))
    return out.select("*", F.substring("digest", 1, PREFIX_HEX).alias("key"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Columns: the id, host, path, rule (null if none fits), verdict."""
    shape = rules.filter(F.col("path").isNotNull()).agg(
        F.array_sort(F.collect_set(F.length("path"))).alias("lengths"), F.max(F.size(F.split("host", r"\."))).alias("labels"), F.count(F.lit(1)).alias("n")
    ).first()  # one row, whatever the number of rules
    lengths, labels = list(shape["lengths"]) or [0], int(shape["labels"] or 1)

    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    at = F.instr(url, "://")
    parts = pages.select(F.col(f"`{id_col}`").alias("id"), F.when(at > 0, F.expr("substring(coalesce(`%s`, ''), instr(coalesce(`%s`, ''), '://') + 3)" % (url_col, url_col))).otherwise("").alias("rest"))
    parts = parts.select("id", "rest", F.regexp_extract("rest", "^[^/?#]*", 0).alias("raw_host"))
    parts = parts.select("id", ascii_lower(F.col("raw_host")).alias("host"), F.regexp_extract(F.expr("substring(rest, length(raw_host) + 1)"), "^[^?#]*", 0).alias("path"))

    names = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))), lambda k: F.array_join(F.slice(names, F.size(names) - k + 1, k), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expansions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    wide = parts.select("id", "host", "path", F.explode(expansions).alias("text"))
    wide = wide.select("id", "host", "path", F.sha2("text", 256).alias("full"))
    wide = wide.select("*", F.substring("full", 1, PREFIX_HEX).alias("key"))

    table = _hashed(rules)
    if shape["n"] <= BROADCAST_RULES:
        table = F.broadcast(table)
    else:
        # Rules that some page asks for: hot expansions (``com/``) are one row each by then, and partial sets are made before the shuffle.
        asked = wide.select("key", "full").distinct()
        table = table.join(asked, (table["key"] == asked["key"]) & (table["digest"] == asked["full"]), "left_semi")
    hit = F.struct("rule_length", "verdict", "rule")
    found = wide.join(table, "key").filter(F.col("digest") == F.col("full")).select("id", "host", "path", hit.alias("hit"), F.lit(0).alias("row"))
    # Every row itself, whether or not a rule fits; it counts repeated rows.
    every = parts.select("id", "host", "path", F.lit(None).cast(found.schema["hit"].dataType).alias("hit"), F.lit(1).alias("row"))
    best = every.union(found).groupBy("id", "host", "path").agg(F.max("hit").alias("hit"), F.sum("row").alias("times"))
    out = best.select("id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"), F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("one"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")


ORACLE_SQL = """
WITH a AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
b AS (SELECT page_id, CASE WHEN position('://' IN u) > 0 THEN substr(u, position('://' IN u) + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM b),
d AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM c),
e AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM d)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM e
"""
