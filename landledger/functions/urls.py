"""Canonical URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track.
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "yclid", "ref")


def canonical_url(c: Column) -> Column:
    """Scheme https, host in lower case without ``www.``, user and default port, path without a closing slash (case kept),
    parameters sorted without tracking ones, fragment kept.  Null where there is no host."""
    u = F.trim(c)
    m = r"^(?i)(?:https?:)?//(?:[^/?#@]*@)?([^/?#:]+)(:\d+)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    host = F.regexp_replace(F.lower(F.regexp_extract(u, m, 1)), r"^www\.", "")
    port = F.regexp_extract(u, m, 2)
    path = F.regexp_replace(F.regexp_extract(u, m, 3), "/+$", "")
    kept = F.filter(F.split(F.regexp_extract(u, m, 4), "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    fragment = F.regexp_extract(u, m, 5)
    tail = F.concat(F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
    return F.when(host != "", F.concat(F.lit("https://"), host, F.when(port.isin("", ":80", ":443"), "").otherwise(port), path, tail))


def is_web_url(c: Column) -> Column:
    return F.coalesce(c.rlike("^https?://"), F.lit(False))


# Path segments of a portal's functions.
UTILITY_SEGMENTS = ("merkliste", "merkzettel", "favoriten", "suchagent", "login", "logout", "anmelden", "abmelden", "register", "registrieren", "impressum", "datenschutz", "agb", "kontakt", "suche", "search")


def looks_like_utility(c: Column) -> Column:
    """Portal functions rather than listings, by a segment of the path (with or without an ending)."""
    path = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.coalesce(F.lower(path).rlike("(^|/)(" + "|".join(UTILITY_SEGMENTS) + r")(\.[a-z0-9]+)?(/|$)"), F.lit(False))
