"""Towns with a postcode and coordinates, and their lookup in free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import bound

# Name, postcode, latitude, longitude.
TOWNS = (
    ("Rosenheim", "83022", 47.8561, 12.1289),
    ("Bad Aibling", "83043", 47.8656, 12.0116),
    ("Bruckmuehl", "83052", 47.8425, 11.9536),
    ("Kolbermoor", "83059", 47.8508, 12.0631),
    ("Raubling", "83064", 47.7761, 12.1194),
    ("Stephanskirchen", "83071", 47.8386, 12.1519),
    ("Prien am Chiemsee", "83209", 47.8586, 12.3453),
    ("Bernau am Chiemsee", "83233", 47.7906, 12.3831),
    ("Rimsting", "83253", 47.9017, 12.3067),
    ("Vogtareuth", "83569", 47.9508, 12.1917),
    ("Amerang", "83123", 47.9481, 12.2919),
    ("Feldkirchen-Westerham", "83620", 47.9061, 11.8442),
    ("Rott am Inn", "83543", 47.9169, 11.9836),
    ("Riedering", "83134", 47.8814, 12.2372),
    ("Frasdorf", "83112", 47.7719, 12.3467),
    ("Neubeuern", "83115", 47.7717, 12.1811),
    ("Nussdorf am Inn", "83131", 47.7275, 12.1381),
    ("Brannenburg", "83098", 47.6989, 12.1122),
    ("Flintsbach am Inn", "83126", 47.6797, 12.0819),
    ("Oberaudorf", "83080", 47.6394, 12.1739),
    ("Kiefersfelden", "83088", 47.6072, 12.1867),
    ("Samerberg", "83122", 47.7583, 12.2119),
    ("Halfing", "83128", 47.9603, 12.2528),
    ("Rohrdorf", "83101", 47.7625, 12.1433),
    ("Soechtenau", "83139", 47.9236, 12.1181),
    ("Miesbach", "83714", 47.7897, 11.8317),
    ("Holzkirchen", "83607", 47.8747, 11.7108),
    ("Hausham", "83734", 47.7375, 11.8283),
    ("Schliersee", "83727", 47.7392, 11.8578),
    ("Bad Wiessee", "83707", 47.7028, 11.7161),
    ("Tegernsee", "83684", 47.7139, 11.7592),
    ("Gmund am Tegernsee", "83703", 47.7539, 11.7522),
    ("Otterfing", "83624", 47.9058, 11.7178),
    ("Waakirchen", "83666", 47.7861, 11.7378),
    ("Warngau", "83627", 47.8514, 11.7514),
    ("Valley", "83626", 47.8975, 11.7997),
    ("Weyarn", "83629", 47.8656, 11.8069),
    ("Irschenberg", "83737", 47.8067, 11.9019),
    ("Fischbachau", "83730", 47.7014, 11.9539),
    ("Bayrischzell", "83735", 47.6606, 12.0206),
    ("Hundham", "83734", 47.7217, 11.9186),
    ("Ebersberg", "85560", 48.0797, 11.9683),
    ("Grafing bei Muenchen", "85567", 48.0464, 11.9611),
    ("Kirchseeon", "85614", 48.0842, 11.9214),
    ("Glonn", "85652", 47.9975, 11.8681),
    ("Assling", "85617", 47.9942, 11.9744),
    ("Vaterstetten", "85591", 48.1058, 11.7511),
    ("Zorneding", "85604", 48.1136, 11.8517),
    ("Baldham", "85598", 48.1097, 11.8175),
    ("Steinhoering", "85643", 48.0011, 12.0356),
    ("Frauenneuharting", "83565", 48.0311, 12.0819),
    ("Bruck", "85567", 48.0261, 12.0106),
    ("Muehldorf am Inn", "84453", 48.2489, 12.5225),
    ("Waldkraiburg", "84478", 48.2081, 12.3986),
    ("Altoetting", "84503", 48.2278, 12.6767),
    ("Neumarkt-Sankt Veit", "84494", 48.3711, 12.5028),
    ("Ampfing", "84539", 48.2461, 12.4083),
    ("Kraiburg am Inn", "84410", 48.1994, 12.4058),
    ("Gars am Inn", "83536", 48.1428, 12.2708),
    ("Toeging am Inn", "84513", 48.2492, 12.5814),
    ("Polling", "84503", 48.2211, 12.5350),
    ("Mettenheim", "84562", 48.2417, 12.4419),
    ("Traunstein", "83278", 47.8697, 12.6417),
    ("Trostberg", "83308", 48.0272, 12.5606),
    ("Chieming", "83339", 47.8925, 12.5361),
    ("Grabenstaett", "83355", 47.8636, 12.5658),
    ("Uebersee", "83236", 47.8300, 12.4931),
    ("Grassau", "83224", 47.7717, 12.4633),
    ("Marquartstein", "83250", 47.7411, 12.4592),
    ("Reit im Winkl", "83242", 47.6706, 12.4589),
    ("Ruhpolding", "83324", 47.7642, 12.6425),
    ("Siegsdorf", "83313", 47.8286, 12.6250),
    ("Waging am See", "83329", 47.9436, 12.7275),
    ("Palling", "83349", 47.9736, 12.5967),
    ("Tacherting", "83342", 47.9714, 12.5361),
    ("Vachendorf", "83377", 47.8286, 12.5325),
    ("Wasserburg am Inn", "83512", 48.0561, 12.2331),
    ("Edling", "83533", 48.0006, 12.1728),
    ("Griesstaett", "83556", 47.9756, 12.2144),
    ("Soyen", "83564", 48.0219, 12.1381),
    ("Schonstett", "83125", 48.0186, 12.2917),
    ("Babensham", "83547", 48.0119, 12.2939),
    ("Rechtmehring", "83562", 48.1069, 12.1592),
)


def town_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TOWNS), "name string, postcode string, lat double, lon double")


def _folded(c):
    c = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    for a, b in (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _words(key):
    return F.concat(F.lit(" "), F.regexp_replace(key, "[^a-z0-9]", " "), F.lit(" "))


def lookup_towns(rows: DataFrame, text_col: str, towns: tuple = TOWNS) -> DataFrame:
    """Add ``town`` (struct of name, postcode, lat, lon, or null): the whole text is a name, else the name that stands first as
    whole words (of two at one place the longer), else the first known postcode.

    The table is a constant, so the lookup is one projection: no join, no shuffle.
    """
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("postcode"), F.lit(la).alias("lat"), F.lit(lo).alias("lon"), _folded(F.lit(n)).alias("key"), _words(_folded(F.lit(n))).alias("words")) for n, p, la, lo in towns])
    out = rows.withColumns({"_towns": entries, "_q": _folded(F.col(text_col))})
    spaced = F.concat(F.lit(" "), F.regexp_replace("_q", r"(?U)[^\w]", " "), F.lit(" "))
    out = out.withColumn("_s", spaced)
    # Patterns of the table's names are part of the constant; a row only searches its text for them.
    hits = F.expr("transform(filter(_towns, e -> contains(_s, e.words)), e -> struct(instr(_s, e.words) AS at, -length(e.key) AS n, e AS e))")
    exact = F.expr("filter(_towns, e -> e.key = _q)")
    codes = F.expr("filter(transform(regexp_extract_all(_q, '(?<![0-9])([0-9]{5})(?![0-9])', 1), p -> get(filter(_towns, e -> e.postcode = p), 0)), e -> e is not null)")
    found = F.coalesce(F.get(exact, 0), F.get(F.array_sort(hits), 0)["e"], F.get(codes, 0))
    slim = bound(found, lambda e: F.when(e.isNotNull(), F.struct(e["name"].alias("name"), e["postcode"].alias("postcode"), e["lat"].alias("lat"), e["lon"].alias("lon"))))
    return out.withColumn("town", slim).drop("_towns", "_q", "_s")
