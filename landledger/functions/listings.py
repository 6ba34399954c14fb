"""What a listing's free text says: place, features, type, signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, normalize_text, slugify

# The vocabulary and the patterns of signals (on normalised text).
BUILDINGS = ("Stadel", "Stadl", "Scheune", "Tenne", "Stall", "Wirtschaftsgebäude", "Remise", "Schupfen", "Schuppen", "Heuboden", "Kuhstall", "Pferdestall", "Maschinenhalle", "Nebengebäude")
FEATURES = (
    "Alleinlage", "Einzellage", "Ortsrand", "Außenbereich", "Aussenbereich", "freie Lage", "ruhige Lage", "Südlage", "historische Bausubstanz", "denkmalgeschützt", "Denkmalschutz", "Baudenkmal", "Obstgarten", "Streuobstwiese", "Weide", "Wiese", "Wald",
    "Bachlauf", "Quelle", "Brunnen", "Photovoltaik", "teilbar", "Teilung möglich", "Bauerwartungsland", "Bebauungsplan", "Bauvoranfrage", "Flurstück", "Entwicklungspotenzial", "Entwicklungspotential", "Innenbereich", "Bestandsschutz", "Nachverdichtung",
)
REGIONAL = ("Sacherl", "Stadl", "Stadel", "Schupfa", "Austrag", "Austragshaus", "Einöde", "Hofstelle", "Hoamat")
NEGATIVE = (
    "Eigentumswohnung", "Doppelhaushälfte", "Reihenhaus", "Reihenmittelhaus", "Reihenendhaus", "Neubau", "Erstbezug", "Baugrundstück ohne Bestand", "Gewerbehalle", "Lagerhalle", "Bürofläche", "Wohnung zur Miete", "Wohnung zu vermieten", "Mietwohnung",
    "Etagenwohnung", "Erdgeschosswohnung", "Dachgeschosswohnung", "Souterrainwohnung", "Maisonette", "Maisonettewohnung", "Penthouse", "Apartment", "Appartement", "Zimmer-Wohnung", "Zimmer-Whg", "Zi-Wohnung", "Zi-Whg", "Ferienwohnung", "Zeitwohnen", "Mikroapartment",
)
HIDDEN = (
    "nicht mehr landwirtschaftlich genutzt", "ehemalige Landwirtschaft", "ehemaliger Bauernhof", "landwirtschaftlich geprägt", "mit Wirtschaftsgebäude", "mit Nebengebäuden", "großes Grundstück", "alte Hofstelle", "historisches Anwesen", "ursprünglich Landwirtschaft",
    "teilweise vermietet", "renovierungsbedürftig", "sanierungsbedürftig", "Handwerkerobjekt", "Entwicklungspotential", "Entwicklungspotenzial", "Nachverdichtung", "Teilung möglich", "mehrere Flurstücke", "Verkauf aus Altersgründen", "privat zu verkaufen", "von privat",
    "kein Makler", "provisionsfrei", "Chiffre", "Preis auf Anfrage", "VB",
)
HIDDEN_NAMES = {"von_privat": "privatverkauf", "privat_zu_verkaufen": "privatverkauf", "verkauf_aus_altersgruenden": "aus_altersgruenden", "entwicklungspotential": "entwicklungspotenzial"}
#: Most specific first.
TYPES = (
    "Vierseithof", "Dreiseithof", "Zweiseithof", "Einödhof", "Resthof", "Austragshaus", "Hofanwesen", "Bauernanwesen", "ehemaliger Bauernhof", "Bauernhof", "Bauernhaus", "Hof mit Nebengebäuden", "Hofstelle", "Landgut", "landwirtschaftliches Anwesen",
    "ehemalige Landwirtschaft", "Landwirtschaft", "Einöde", "Sacherl zu verkaufen", "Sacherl", "Anwesen",
)
AUCTION = r"zwangsversteigerung|zwangsvollstreckung|\bzvg\b|teilungsversteigerung"
SIGNALS = {
    "is_foreclosure": AUCTION + "|mindestgebot", "is_monument": "denkmal", "is_private_seller": "von privat|privat zu verkaufen|privatverkauf|kein makler|ohne makler",
    "is_off_market_signal": r"\bchiffre\b|off.?market|stille vermarktung|nicht oeffentlich (?:inseriert|vermarktet)",
}
RENTAL = r"\bzu vermieten\b|\bzur (?:miete|vermietung)\b|\b(?:kalt|warm|nettokalt|monats)miete\b|\bmietpreis\b|\bmietwohnung\b|\bmietobjekt\b|\bmietangebot\b|\bmietvertrag\b|\bkaution\b|\bwohnberechtigungsschein\b"
NO_TOWNS = ("euro", "quadratmeter", "zimmer", "hektar", "kaufpreis", "baujahr", "wohnflaeche", "wohnfläche")


def _plain(term: str) -> str:
    t = term.lower()
    for a, b in (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("-", " ")):
        t = t.replace(a, b)
    return t


def _stands(norm: Column, original: Column, term: str) -> Column:
    """Whole words; a single word of up to three letters must stand capitalised in the original.  Most texts lack most terms, which a plain search tells."""
    p = _plain(term)
    hit = F.contains(norm, F.lit(p)) & norm.rlike(rf"(?U)\b\Q{p}\E\b")
    if " " not in p and len(p) <= 3:
        hit = hit & original.rlike(rf"(?U)\b{p[0].upper()}(?i:\Q{p[1:]}\E)\b")
    return hit


def tags(norm: Column, original: Column, terms: tuple[str, ...]) -> Column:
    """Sorted slugs of the terms that stand in the text."""
    # Bound: so many terms in a projection would be more code than the JVM compiles.
    return bound(norm, lambda n: F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(_stands(n, original, t), F.lit(_plain(t).replace(" ", "_"))) for t in terms])))))


def features(original: Column, norm: Column | None = None) -> dict[str, Column]:
    """``norm`` is a column of the normalised text, where there is one: each feature reads it."""
    text = F.coalesce(original, F.lit(""))
    n = normalize_text(text) if norm is None else norm
    rental = n.rlike(RENTAL)
    hidden = F.transform(tags(n, text, HIDDEN), lambda t: F.coalesce(*[F.when(t == k, F.lit(v)) for k, v in HIDDEN_NAMES.items()], t))
    return {
        "outbuildings": tags(n, text, BUILDINGS), "building_features": tags(n, text, FEATURES), "special_features": tags(n, text, REGIONAL),
        "exclusion_flags": F.array_sort(F.concat(tags(n, text, NEGATIVE), F.when(rental, F.array(F.lit("mietobjekt"))).otherwise(F.array().cast("array<string>")))),
        "hidden_signals": F.array_sort(F.array_distinct(F.concat(hidden, F.when(n.rlike(AUCTION), F.array(F.lit("zwangsversteigerung"))).otherwise(F.array().cast("array<string>"))))),
        "is_rental": rental, **{k: n.rlike(p) for k, p in SIGNALS.items()},
    }


def property_type(title: Column, description: Column) -> Column:
    """The most specific type that the title names, else the description."""
    def first(c: Column) -> Column:
        text = F.coalesce(c, F.lit(""))
        return bound(normalize_text(text), lambda n: F.coalesce(*[F.when(_stands(n, text, t), F.lit(_plain(t).replace(" ", "_"))) for t in TYPES]))

    return F.coalesce(first(title), first(description))


def _some(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def parse_location(text: Column) -> Column:
    """street, postcode, town and district of a place line; what can't be told stays null.

    Each step is bound before the next reads it, so that the expression doesn't grow with every use.
    """
    county = r"\((?:landkreis|kreis|lkr\.?)"

    def parted(raw: Column) -> Column:
        district = _some(F.regexp_extract(raw, rf"(?i){county}\s+([^)]+)\)", 1))
        before, behind = (F.regexp_extract(raw, rf"(?is)^{x}$", 1) for x in (rf"(.*?){county}\s+[^)]+\).*", rf".*?{county}\s+[^)]+\)(.*)"))
        rest = F.when(district.isNotNull(), F.concat(before, behind)).otherwise(F.regexp_replace(raw, rf"(?i){county}\)", ""))
        return bound(F.struct(raw.alias("raw"), district.alias("district"), rest.alias("rest")), coded)

    def coded(x: Column) -> Column:
        rest = x["rest"]
        code = _some(F.regexp_extract(rest, r"\b(\d{5})\b", 1))
        left = F.when(code.isNotNull(), F.concat(F.regexp_extract(rest, r"(?s)^(.*?)\b\d{5}\b", 1), F.regexp_extract(rest, r"(?s)^.*?\b\d{5}\b(.*)$", 1))).otherwise(rest)
        return bound(F.struct(x["raw"].alias("raw"), x["district"].alias("district"), code.alias("postcode"), left.alias("rest")), named)

    def named(x: Column) -> Column:
        head = F.regexp_extract(x["rest"], r"(?s)^([^,]*),", 1)
        is_street = F.contains(x["rest"], F.lit(",")) & head.rlike(r"\d") & head.rlike("[A-Za-zÄÖÜäöüß]{3,}")
        tail = F.when(is_street, F.regexp_extract(x["rest"], r"(?s)^[^,]*,(.*)$", 1)).otherwise(x["rest"])
        near = F.regexp_extract(tail, r"(?i)\bbei\s+(.+)$", 1)
        town = _some(F.trim(F.regexp_extract(F.when(near != "", near).otherwise(tail), "^[^,]*", 0)))
        street = F.when(is_street, _some(head))
        return bound(F.struct(town.alias("town"), street.alias("street"), x["raw"].alias("raw"), x["district"].alias("district"), x["postcode"].alias("postcode")), whole)

    def whole(x: Column) -> Column:
        district = F.coalesce(x["district"], F.when(x["raw"].rlike(rf"(?i){county}\)"), x["town"]))
        return F.struct(x["street"].alias("street"), x["postcode"].alias("postcode"), x["town"].alias("town"), district.alias("district"))

    return bound(F.trim(text), lambda raw: F.when(F.coalesce(raw, F.lit("")) != "", parted(raw)))


# A postcode with a town behind it, and the county that may follow.
PLACE_IN_TEXT = r"\b(?!00)(\d{5})[ \t]+([A-ZÄÖÜ][a-zäöüß]+(?:[- ][A-ZÄÖÜ][a-zäöüß]+)*)"
COUNTY_BEHIND = r"(\s*[,(]?\s*(?:Landkreis|Lkr\.?|Kreis)[ \t]+[A-ZÄÖÜ][a-zäöüß]+\)?)?"


def find_location(text: Column) -> Column:
    """The first postcode and town in running text that can be one, with the county that may follow, as a place line."""
    def line(hit: Column) -> Column:
        place = F.regexp_replace(F.regexp_extract(hit, PLACE_IN_TEXT, 0), r"[ \t]+", " ")
        county = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(hit, PLACE_IN_TEXT + COUNTY_BEHIND, 3), r"[,()]", " "), r"\s+", " "))
        return F.when(county != "", F.concat(place, F.lit(", "), county)).otherwise(place)

    hits = F.regexp_extract_all(text, F.lit(PLACE_IN_TEXT + COUNTY_BEHIND), F.lit(0))
    real = F.filter(hits, lambda h: ~F.lower(F.regexp_extract(h, r"^\d{5}[ \t]+([^\s-]+)", 1)).isin(*NO_TOWNS))
    return bound(F.get(real, 0), line)


def slug(c: Column) -> Column:
    return slugify(c)
