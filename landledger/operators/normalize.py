"""Raw listings to typed ones: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import listings as ls
from ..functions import numbers
from ..functions.dates import german_date
from ..functions.text import normalize_text

STATED, RECOVERED = 0.8, 0.6


def normalize_listings(raw: DataFrame, today) -> DataFrame:
    """Typed facts, tags, flags, text hash, evidence (field to quote and confidence) and warnings of raw listings.

    ``raw`` has the textual columns of ``sources.files.RAW_FIELDS``.  A field that is there but can't be read gives a warning and
    no fact; a place that is only in the text counts less than a stated one; a rental's price type is rent.
    """
    c = F.col
    prose = F.concat_ws("\n", "title", "description")
    place = F.coalesce(c("location_raw"), F.when(F.trim(c("town")) != "", F.concat_ws(" ", "postcode", "town")))
    out = raw.withColumns({"_place": F.coalesce(place, ls.find_location(prose)), "_stated": place.isNotNull(), "_prose": prose, "_norm": normalize_text(prose)})
    out = out.withColumns({"_loc": ls.parse_location(c("_place")), "_price": numbers.parse_price(c("price_raw")), **ls.features(c("_prose"), c("_norm"))})
    year = F.regexp_extract("year_raw", r"\b(\d{4})\b", 1).try_cast("int")
    year = F.when((year >= 1000) & (year <= 2100), year)
    out = out.withColumns({
        "price": c("_price.value"), "price_type": F.when(c("is_rental"), "rent").otherwise(c("_price.kind")), "land_sqm": numbers.parse_area(c("land_raw")), "living_sqm": numbers.parse_area(c("living_raw")), "usable_sqm": numbers.parse_area(c("usable_raw")),
        "rooms": numbers.german_number(c("rooms_raw")), "year_built": year, "street": c("_loc.street"), "postcode": F.coalesce(c("postcode"), c("_loc.postcode")), "town": F.coalesce(c("town"), c("_loc.town")), "district": c("_loc.district"),
        "property_type": ls.property_type(c("title"), c("description")), "source_date": german_date(c("source_date_raw"), today), "text_hash": F.sha2("_norm", 256),
    })
    quotes = {"price": "price_raw", "land_sqm": "land_raw", "living_sqm": "living_raw", "usable_sqm": "usable_raw", "rooms": "rooms_raw", "year_built": "year_raw", "town": "_place", "source_date": "source_date_raw"}
    entry = lambda f, q: F.when(c(f).isNotNull(), F.struct(c("url").alias("url"), c(q).alias("quote"), F.when(F.lit(f == "town") & ~c("_stated"), RECOVERED).otherwise(STATED).alias("confidence")))
    evidence = F.map_filter(F.create_map(*[x for f, q in quotes.items() for x in (F.lit(f), entry(f, q))]), lambda k, v: v.isNotNull())
    warnings = F.array_compact(F.array(*[F.when((F.trim(c(q)) != "") & c(f).isNull() & (F.lit(f != "price") | (c("price_type") != "on_request")), F.concat(F.lit(f"{f}: "), c(q))) for f, q in quotes.items()], F.when(c("town").isNull(), F.lit("town: missing"))))
    return out.withColumns({"evidence": evidence, "warnings": warnings}).drop("_place", "_stated", "_prose", "_norm", "_loc", "_price")
