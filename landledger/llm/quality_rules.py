"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Every document gets counts over its whole text.  Fixed base rules come first; documents that
pass them are held against a minimum-covariance-determinant (MCD) estimate of location and scatter of
their language and source, and those at a great Mahalanobis distance are rejected.

MCD by concentration steps: start from the medians and absolute deviations of each group, then
repeat: put the squared distances in bins, take the nearest bins until they hold ``SUBSET`` of the
group, and estimate from those rows alone.  A step never raises a covariance's determinant but for the bins' width;
a group's steps end when its determinant hardly falls any more, and its rows stay out of those of the others.  Bins carry their own sums, so one step is one aggregation
with map-side sums (groups x bins rows at most are shuffled, however hot a group is) and no group is
ever gathered.  Three components keep the inverse in closed form.

Odd inputs: a null text has no words and fails the base rules.  A null language or source is a
group of its own.  Repeated rows are judged alike, each on its own.  An empty table gives an empty table.  Very long texts are counted
whole, in the JVM, in memory in proportion to the text.  Other columns are ignored (in the pipeline form kept, whatever their names).

Small groups: the same steps estimate each language and the whole corpus.  A group of n passing documents
has its own estimate with weight n / ``FULL_GROUP`` (1 at most) and its language's with the rest; the
language's is shrunk towards the corpus in the same way.  So every passing document has a distance, and
no verdict jumps at a group size.  Only a corpus below ``FULL_GROUP`` stands on its own few rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, nested

SYMBOLS = "#*$%&|<>"
WINDOW = 5
SUBSET = 0.75
#: A group's steps end when its determinant falls by less than this part; more than ``MOST_STEPS`` are never made.
SETTLED, MOST_STEPS = 0.01, 10
#: Passing documents from which a group stands on its own estimate alone.
FULL_GROUP = 60
#: Share of the documents of a normal group that would be rejected.
TAIL = 1e-7
#: Least standard deviations of the three components, so that groups of equal documents reject no neighbours.
FLOORS = (0.05, 0.06, 1.0)
BINS_PER_E, MOST_BINS = 12, 160
PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


def _chi_square(x: float, degrees: int) -> float:
    """Probability of at most x, for 3 or 5 degrees of freedom."""
    three = math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    return three if degrees == 3 else three - math.sqrt(2 / math.pi) * x**1.5 * math.exp(-x / 2) / 3


def _quantile(share: float) -> float:
    """Of chi-square with 3 degrees, by halving."""
    low, high = 0.0, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square(mid, 3) < share else (low, mid)
    return high


#: Squared Mahalanobis distance beyond which a document is rejected.
CUTOFF = _quantile(1 - TAIL)
#: The covariance of the nearest SUBSET of a normal sample understates its own by this factor.
CONSISTENCY = SUBSET / _chi_square(_quantile(SUBSET), 5)


def _counts(df: DataFrame, text: str, prefix: str = "_q_") -> DataFrame:
    """Add the counts as columns that start with ``prefix``.  ``text`` is a column expression."""
    p = prefix
    t = F.coalesce(F.expr(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select("*", F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "").alias(f"{p}w"), lines.alias(f"{p}l"))
    df = df.select("*", F.array_join(f"{p}w", "").alias(f"{p}c"), F.transform(f"{p}w", lambda w: F.xxhash64(w)).alias(f"{p}h")).drop(f"{p}w")
    bare = F.col(f"{p}c")
    df = df.select("*", F.length(bare).cast("long").alias(f"{p}word_chars"), F.regexp_count(t, F.lit("[" + SYMBOLS + "]")).cast("long").alias(f"{p}n_symbols")).drop(f"{p}c")
    h = F.col(f"{p}h")
    grams = F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    df = df.select("*", grams.alias(f"{p}g"))
    g, ln = F.col(f"{p}g"), F.col(f"{p}l")
    # Only texts with a window that repeats are sorted; the rest have the answer 0.
    order = F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda v, i: F.struct(v.alias("v"), i.alias("i")))))
    df = df.select("*", order.alias(f"{p}s"), F.size(h).cast("long").alias(f"{p}n_words"), F.size(ln).cast("long").alias(f"{p}n_lines"), (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias(f"{p}n_dup_lines"))
    df = df.drop(f"{p}h", f"{p}l", f"{p}g")
    s = F.col(f"{p}s")
    starts = F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(x["v"] == F.get(s, k - 1)["v"], F.lit(False)) | F.coalesce(x["v"] == F.get(s, k + 1)["v"], F.lit(False))), lambda x: x["i"]))
    df = df.select("*", starts.alias(f"{p}r")).drop(f"{p}s")
    r = F.col(f"{p}r")
    # A word counts once, however many repeated windows it is in: each window adds up to the next one's start.
    covered = F.aggregate(F.transform(r, lambda a, k: F.coalesce(F.least(F.get(r, k + 1) - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return df.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias(f"{p}n_repeat_words")).drop(f"{p}r")


def _base_failed(p: str) -> Column:
    return (F.col(f"{p}n_words") < 10) | (100 * F.col(f"{p}n_repeat_words") > 20 * F.col(f"{p}n_words"))


def _vector(p: str) -> list[Column]:
    """Mean word length (shrunk where few words tell little), share of symbols, and number of words, each transformed to be near symmetric."""
    n, chars, sym = (F.greatest(F.col(f"{p}{c}"), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_symbols"))
    sym = F.col(f"{p}n_symbols").cast("double")
    return [(F.log(chars / n) - math.log(5.5)) * F.sqrt(n / (n + 100.0)), F.sqrt(sym / chars) * F.sqrt(n / (n + 20.0)), F.log(n)]


def _distance(x: list[Column], m: list[Column], s: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance with the inverse of a 3 x 3 matrix written out."""
    e = [a - b for a, b in zip(x, m, strict=True)]
    a, b, c, d, f, g = s[0, 0], s[0, 1], s[0, 2], s[1, 1], s[1, 2], s[2, 2]
    cof = {(0, 0): d * g - f * f, (0, 1): c * f - b * g, (0, 2): b * f - c * d, (1, 1): a * g - c * c, (1, 2): b * c - a * f, (2, 2): a * d - b * b}
    det = a * cof[0, 0] + b * cof[0, 1] + c * cof[0, 2]
    total = sum(((1 if i == j else 2) * e[i] * e[j] * cof[i, j] for i, j in PAIRS), F.lit(0.0))
    return F.when(det.isNotNull(), F.greatest(total / det, F.lit(0.0)))


def _determinant() -> Column:
    a, b, c, d, f, g = (F.col(f"_m_{i}{j}") for i, j in PAIRS)
    return a * (d * g - f * f) - b * (b * g - c * f) + c * (b * f - c * d)


def _with_estimate(rows: DataFrame, est: DataFrame, lang: Column, source: Column) -> DataFrame:
    """``est`` has a row for each group at most; a hot group's rows are split by the planner where it doesn't broadcast."""
    return rows.join(est, lang.eqNullSafe(est["_m_lang"]) & source.eqNullSafe(est["_m_source"]), "left")


def _estimate_distance(x: list[Column]) -> Column:
    return _distance(x, [F.col(f"_m_{i}") for i in range(3)], {(i, j): F.col(f"_m_{i}{j}") for i, j in PAIRS})


def _total(bins: str, name: str) -> Column:
    return F.aggregate(bins, F.lit(0.0), lambda acc, y: acc + y[name])


def _levels(points: DataFrame) -> DataFrame:
    """Each point for the corpus, for its language and for its group."""
    kinds = {c: points.schema[c].dataType for c in ("lang", "source")}
    at = lambda level, *named: F.struct(F.lit(level).alias("_k_level"), *[(F.col(c) if c in named else F.lit(None).cast(t)).alias(f"_k_{c}") for c, t in kinds.items()])
    return points.select(F.explode(F.array(at(0), at(1, "lang"), at(2, "lang", "source"))).alias("k"), "x0", "x1", "x2").select("k.*", "x0", "x1", "x2")


def _shrunk(est: DataFrame) -> DataFrame:
    """One estimate a group: its own, its language's and the corpus', each with the weight that the ones before leave."""
    cells = [f"_m_{i}" for i in range(3)] + [f"_m_{i}{j}" for i, j in PAIRS]
    level = lambda k: est.filter(F.col("_m_level") == k)
    lang = level(1).select(F.col("_m_lang").alias("_l_lang"), F.col("_n").alias("_l_n"), *[F.col(c).alias(f"_l{c}") for c in cells])
    corpus = level(0).select(*[F.col(c).alias(f"_c{c}") for c in cells])
    own, of_lang = (F.least(F.col(n) / FULL_GROUP, F.lit(1.0)) for n in ("_n", "_l_n"))
    both = level(2).join(lang, F.col("_m_lang").eqNullSafe(F.col("_l_lang"))).crossJoin(F.broadcast(corpus))
    return both.select("_m_lang", "_m_source", *[(own * F.col(c) + (1 - own) * (of_lang * F.col(f"_l{c}") + (1 - of_lang) * F.col(f"_c{c}"))).alias(c) for c in cells])


def fit_groups(points: DataFrame) -> DataFrame:
    """``points``: lang, source, x0, x1, x2.  One row per group: _m_lang, _m_source, centre and covariance."""
    xs = [F.col(f"x{i}") for i in range(3)]
    keys = ["_m_level", "_m_lang", "_m_source"]
    points = _levels(points)
    by = [F.col(k.replace("_m_", "_k_")).alias(k) for k in keys]
    of_group = (F.col("_k_level") == F.col("_m_level")) & F.col("_k_lang").eqNullSafe(F.col("_m_lang")) & F.col("_k_source").eqNullSafe(F.col("_m_source"))
    mid = points.groupBy(*by).agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"_m_{i}") for i, x in enumerate(xs)])
    mid = materialise(mid, "mcd-medians")
    near = points.join(mid, of_group)
    dev = near.groupBy(*keys).agg(*[F.percentile_approx(F.abs(x - F.col(f"_m_{i}")), 0.5, 1000).alias(f"_d{i}") for i, x in enumerate(xs)], *[F.first(f"_m_{i}").alias(f"_m_{i}") for i in range(3)])
    est = dev.select(*keys, *[f"_m_{i}" for i in range(3)], *[(F.pow(1.4826 * F.col(f"_d{i}"), 2) + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"_m_{i}{j}") for i, j in PAIRS])
    est = materialise(est, "mcd-start")
    settled: list[DataFrame] = []
    for step in range(MOST_STEPS):
        e = points.join(est, of_group)
        binned = e.select(*keys, *xs, F.least(F.floor(BINS_PER_E * F.log1p(_estimate_distance(xs))), F.lit(MOST_BINS)).cast("int").alias("bin"))
        sums = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)], *[F.sum(xs[i] * xs[j]).alias(f"s{i}{j}") for i, j in PAIRS])
        names = ["n", *[f"s{i}" for i in range(3)], *[f"s{i}{j}" for i, j in PAIRS]]
        # MOST_BINS + 1 entries a group at most
        group = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", *names))).alias("b"), F.sum("n").alias("all"))
        before = lambda b, k: F.aggregate(F.slice(b, F.lit(1), k), F.lit(0).cast("long"), lambda acc, y: acc + y["n"])
        kept = group.select(*keys, "all", F.filter("b", lambda y, k: before(F.col("b"), k) < F.ceil(SUBSET * F.col("all"))).alias("b"))
        tot = kept.select(*keys, "all", *[_total("b", c).alias(c) for c in names])
        m = [F.col(f"s{i}") / F.col("n") for i in range(3)]
        new = tot.select(*keys, F.col("all").alias("_n"), *[m[i].alias(f"_m_{i}") for i in range(3)], *[((F.col(f"s{i}{j}") / F.col("n") - m[i] * m[j]) * CONSISTENCY + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"_m_{i}{j}") for i, j in PAIRS])
        # The first estimate is no step, so nothing settles against it.
        old = est.select(*[F.col(k).alias(f"_o{k}") for k in keys], (F.lit(None).cast("double") if step == 0 else _determinant()).alias("_old"))
        new = new.join(old, [F.col(k).eqNullSafe(F.col(f"_o{k}")) for k in keys]).withColumn("_settled", F.coalesce(_determinant() >= (1 - SETTLED) * F.col("_old"), F.lit(False)))
        new = materialise(new.drop("_old", *[f"_o{k}" for k in keys]), f"mcd-step{step}")
        # Each group stops by itself, and its rows stay out of further steps.
        settled.append(new.filter("_settled"))
        est = new.filter("not _settled")
        if est.isEmpty():
            break
    else:
        settled.append(est)
    done = settled[0]
    for some in settled[1:]:
        done = done.union(some)
    # Written, so that the planner knows how small it is and leaves texts where they are.
    return materialise(_shrunk(done.drop("_settled")), "mcd-groups")


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Columns: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance (null where no document of the group passes the base rules)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_q_id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("_q_text"))
    rows = _counts(rows, "_q_text").drop("_q_text")
    # The counts are small (80 bytes a document); from here on no text is read.
    rows = materialise(rows.select("*", _base_failed("_q_").alias("_q_failed"), *[x.alias(f"x{i}") for i, x in enumerate(_vector("_q_"))]), "quality-counts")
    est = fit_groups(rows.filter(~F.col("_q_failed")).select("lang", "source", "x0", "x1", "x2"))
    out = _with_estimate(rows, est, rows["lang"], rows["source"]).select("*", _estimate_distance([F.col(f"x{i}") for i in range(3)]).alias("_q_d"))
    ok = ~F.col("_q_failed") & ~F.coalesce(F.col("_q_d") > CUTOFF, F.lit(False))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select(F.col("_q_id").alias(id_col), *[F.col(f"_q_{c}").alias(c) for c in names], F.col("_q_failed").alias("base_failed"), ok.alias("kept"), F.col("_q_d").alias("distance"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are.

    The estimates come from one pass, the verdicts from a second that reads the texts again: cheaper than
    shuffling the texts to join them with verdicts, and right for repeated and missing ids.
    """
    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("_q_text"))
    rows = _counts(rows, "_q_text")
    points = materialise(rows.select("lang", "source", _base_failed("_q_").alias("_failed"), *[x.alias(f"x{i}") for i, x in enumerate(_vector("_q_"))]), "quality-points")
    est = fit_groups(points.filter("not _failed").select("lang", "source", "x0", "x1", "x2"))
    again = _counts(nested(docs), f"_row.`{text_col}`")
    # A filter that reads a row number can't be moved below the counts, where it would write them out once for each use, inside lambdas.
    again = again.select("_row", _base_failed("_q_").alias("_failed"), *[x.alias(f"_x{i}") for i, x in enumerate(_vector("_q_"))], F.monotonically_increasing_id().alias("_barrier"))
    again = again.filter("not _failed and _barrier >= 0").drop("_barrier", "_failed")
    both = _with_estimate(again, est, F.col(f"_row.`{lang_col}`"), F.col(f"_row.`{source_col}`"))
    far = F.coalesce(_estimate_distance([F.col(f"_x{i}") for i in range(3)]) > CUTOFF, F.lit(False))
    return both.filter(~far).select("_row.*")
