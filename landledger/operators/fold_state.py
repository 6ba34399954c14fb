"""The fold of the log as a state that batches are merged into.

``ingest.snapshot`` folds a property's whole log.  Here the fold is kept: a row per property with what later sightings can still change (last
statement of a verifying source and first of any for each fact, last verifying place and the best since, who shows it, counters).  A batch is folded by
itself, its running values start from the state, and both are merged by one projection, so a batch costs its own rows and the states
of the buckets that it touches, however long the log is.

``order`` is a total order of a property's sightings.  A batch whose rows all come behind a property's last sighting is merged; where some don't (late
rows, or a batch that is applied again after a failure), that property alone is folded anew from its bucket of the log.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import materialise
from .ingest import FACTS, FLAGS, TAGS, precision_rank
from .lifecycle import DORMANT, LEAST_MOVE, _filled, decided, shown_before

BUCKETS = 64
#: Marks the rows of the batch where others of the log are folded with them.
OWN = "_of_batch"
_GEO = (("lat", "double"), ("lon", "double"), ("geo_precision", "string"), ("air_km", "double"), ("driving_km", "double"), ("driving_minutes", "double"), ("routed", "boolean"), ("source_date", "timestamp"), ("text_hash", "string"), ("price", "double"))


class Advanced(NamedTuple):
    """``state`` has the rows of the touched properties; ``journal`` and ``prices`` are the batch's own."""

    state: DataFrame
    journal: DataFrame
    prices: DataFrame


def _names(rows: DataFrame) -> tuple[list[str], list[str], list[str]]:
    there = set(rows.columns)
    return [f for f in FACTS if f in there], [t for t in TAGS if t in there], [f for f in FLAGS if f in there]


def _located() -> Column:
    return F.col("lat").isNotNull() & F.col("lon").isNotNull()


def _known(rows: DataFrame, name: str) -> Column:
    return _filled(F.col(name)) if dict(rows.dtypes)[name] == "string" else F.col(name)


def status(base: Column, revived: Column) -> Column:
    return F.when(base.isNull() | (base.isin(*DORMANT) & revived), "discovered").otherwise(base)


def _running(rows: DataFrame, order: str) -> DataFrame:
    """Each row with status and price after it, given the property's state ``old`` (null: none).

    Of the state a row carries a few values alone; rows are shuffled once, by property, and sorted twice.
    """
    src = Window.partitionBy("property_id", "source_id").orderBy(order)
    w = Window.partitionBy("property_id").orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    old = F.col("old")
    sources = F.coalesce(old["sources"], F.create_map().cast(rows.schema["old"].dataType["sources"].dataType))
    kept = {
        "_known": old.isNotNull(), "_mine": F.try_element_at(old["sources"], F.col("source_id")), "_already": F.size(F.filter(F.map_values(sources), lambda x: F.coalesce(x["shown"], F.lit(False)))),
        "_was": F.struct("old.base", "old.revived", "old.price_strong", "old.price_weak"), "_cuts": F.coalesce(F.col("old.price_reduction_count"), F.lit(0)),
    }
    mine, was, shown = F.col("_mine"), F.col("_was"), F.col("visible").cast("int")
    out = rows.withColumns(kept).drop("old").withColumn("_at", F.row_number().over(src))
    out = out.withColumns({
        "_d": F.when(F.col("verifies"), shown - F.coalesce(shown_before(shown, src), mine["shown"].cast("int"), F.lit(0))).otherwise(0), "_new_source": (F.col("_at") == 1) & mine.isNull(),
        "_old_hash": F.when(F.col("_at") == 1, mine["text_hash"]).otherwise(F.lag("text_hash").over(src)),
    }).drop("_at", "_mine")
    out = out.withColumns({
        "_rn": F.row_number().over(w), "_n": F.col("_already") + F.sum("_d").over(so_far), "_anchor": F.max(F.when(F.col("verifies") & _located(), F.col(order))).over(Window.partitionBy("property_id")),
        "_strong": F.coalesce(F.last(F.when(F.col("verifies"), F.col("price")), ignorenulls=True).over(so_far), was["price_strong"]),
        "_weak": F.coalesce(was["price_weak"], F.first(F.when(~F.col("verifies"), F.col("price")), ignorenulls=True).over(so_far)),
    })
    out = out.withColumn("_s", F.when(F.col("verifies") & F.col("visible"), "active").when(F.col("verifies") & (F.col("_n") == 0), "removed"))
    base, others = decided(so_far)
    out = out.withColumns({"base": base, "revived": others})
    out = out.withColumns({"base": F.coalesce("base", was["base"]), "revived": F.col("revived") | (F.col("base").isNull() & F.coalesce(was["revived"], F.lit(False)))})
    out = out.withColumns({"status": status(F.col("base"), F.col("revived")), "_price": F.coalesce("_strong", "_weak")})
    first = F.col("_rn") == 1
    before = F.when(F.col("_known"), status(was["base"], was["revived"]))
    out = out.withColumns({"old_status": F.when(first, before).otherwise(F.lag("status").over(w)), "old_price": F.when(first, F.coalesce(was["price_strong"], was["price_weak"])).otherwise(F.lag("_price").over(w)), "_first": first & ~F.col("_known")})
    return out.drop("_d", "_n", "_s", "_rn", "_known", "_already", "_was")


def _own(rows: DataFrame) -> list[str]:
    return [OWN] if OWN in rows.columns else []


def _journal(run: DataFrame, order: str) -> DataFrame:
    """As ``lifecycle.change_kinds``."""
    removed = (F.col("status") == "removed") & ~F.col("old_status").eqNullSafe("removed")
    priced = F.col("old_price").isNotNull() & (F.abs(F.col("_price") - F.col("old_price")) >= LEAST_MOVE)
    revived = F.col("old_status").isin(*DORMANT) & ~F.col("status").isin(*DORMANT)
    other_text = F.col("_old_hash").isNotNull() & F.col("text_hash").isNotNull() & (F.col("_old_hash") != F.col("text_hash"))
    main = (
        F.when(F.col("_first"), "first_seen").when(removed, "removed").when(priced, "price_change").when(revived, "reactivated").when(F.col("_new_source"), "source_change")
        .when(other_text, "description_change").when(F.col("status") != F.col("old_status"), "status_change")
    )
    kinds = F.array_compact(F.array(F.when(priced & revived & ~F.col("_first") & ~removed, "reactivated"), main))
    return run.select("property_id", order, "ts", *_own(run), "old_status", F.col("status").alias("new_status"), F.explode(kinds).alias("change_kind"))


def _price_journal(run: DataFrame, order: str) -> DataFrame:
    """As ``lifecycle.price_journal``."""
    delta = F.col("_price") - F.col("old_price")
    moved = run.filter(F.col("_price").isNotNull() & ~F.col("_price").eqNullSafe(F.col("old_price")) & (F.col("old_price").isNull() | (F.abs(delta) >= LEAST_MOVE)))
    out = moved.select("property_id", order, "ts", *_own(run), "old_price", F.col("_price").alias("new_price"), delta.alias("delta_abs"), F.round(100 * F.try_divide(delta, F.col("old_price")), 4).alias("delta_pct"), "_cuts")
    so_far = Window.partitionBy("property_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("reductions", F.col("_cuts") + F.count_if(F.col("delta_abs") < 0).over(so_far)).drop("_cuts")


def _part(run: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """The fold of the batch alone, in the state's columns."""
    facts, tags, flags = _names(rows)
    o, located, proof = F.col(order), _located(), F.col("verifies") & F.col("visible")
    at = lambda cond, value: F.struct(o.alias("o"), value.alias("v")) if cond is None else F.when(cond, F.struct(o.alias("o"), value.alias("v")))
    counts = located & (F.col("_anchor").isNull() | (o >= F.col("_anchor")))
    place = F.struct((-precision_rank(F.col("geo_precision"))).alias("r"), o.alias("o"), F.col("lat").alias("lat"), F.col("lon").alias("lon"), F.coalesce("geo_precision", F.lit("none")).alias("geo_precision"))
    route = F.struct(o.alias("o"), F.col("driving_km").alias("km"), F.col("driving_minutes").alias("minutes"))
    seen = lambda t: F.array_sort(F.collect_list(F.struct(o.alias("o"), F.coalesce(F.col(t), F.array().cast("array<string>")).alias("t"))))
    aggs = [F.max(at(F.col("verifies") & _known(rows, f).isNotNull(), _known(rows, f))).alias(f"strong_{f}") for f in facts]
    aggs += [F.min(at(~F.col("verifies") & _known(rows, f).isNotNull(), _known(rows, f))).alias(f"weak_{f}") for f in facts]
    aggs += [F.array_distinct(F.flatten(F.transform(seen(t), lambda x: x["t"]))).alias(t) for t in tags] + [F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags]
    end = F.max_by(F.struct("base", "revived", "_strong", "_weak"), o)
    main = run.groupBy("property_id").agg(
        *aggs, F.max(o).alias("last_order"), F.count(F.lit(1)).alias("n_sightings"), F.max("_anchor").alias("anchor"), F.min(F.when(counts, place)).alias("place"),
        F.max(at(located & F.col("air_km").isNotNull(), F.col("air_km"))).alias("air"), F.max(F.when(located & F.coalesce("routed", F.lit(False)), route)).alias("route"),
        F.min(at(None, F.col("ts"))).alias("seen_first"), F.max(at(None, F.col("ts"))).alias("seen_last"), F.max(at(proof, F.col("ts"))).alias("proved"),
        F.max(at(proof & F.col("source_date").isNotNull(), F.col("source_date"))).alias("dated"), F.bool_or(proof).alias("verified"), end.alias("_end"),
    )
    per = run.groupBy("property_id", "source_id").agg(F.max_by("visible", F.when(F.col("verifies"), o)).alias("shown"), F.max_by("text_hash", o).alias("text_hash"), F.min_by("ts", o).alias("first_seen"))
    sources = per.groupBy("property_id").agg(F.map_from_entries(F.collect_list(F.struct("source_id", F.struct("shown", "text_hash", "first_seen")))).alias("sources"))
    both = main.join(sources, "property_id")
    return both.select("*", F.col("_end.base").alias("base"), F.col("_end.revived").alias("revived"), F.col("_end._strong").alias("price_strong"), F.col("_end._weak").alias("price_weak")).drop("_end")


def _merged(part: DataFrame, old: DataFrame, moves: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per property of ``part``: the earlier state (if any) and the batch."""
    facts, tags, flags = _names(rows)
    a, b = (lambda n: F.col(f"old.{n}")), (lambda n: F.col(f"part.{n}"))
    some = part.select("property_id", F.struct(*part.columns).alias("part")).join(old, "property_id", "left").join(moves, "property_id", "left")
    latest, earliest = (lambda n: F.greatest(a(n), b(n)).alias(n)), (lambda n: F.least(a(n), b(n)).alias(n))
    sources = F.map_zip_with(F.coalesce(a("sources"), F.create_map().cast(part.schema["sources"].dataType)), b("sources"), lambda _, x, y: F.struct(F.coalesce(y["shown"], x["shown"]).alias("shown"), F.when(y.isNotNull(), y["text_hash"]).otherwise(x["text_hash"]).alias("text_hash"), F.coalesce(x["first_seen"], y["first_seen"]).alias("first_seen")))
    return some.select(
        "property_id", *[latest(f"strong_{f}") for f in facts], *[earliest(f"weak_{f}") for f in facts],
        *[F.array_union(F.coalesce(a(t), F.array().cast("array<string>")), b(t)).alias(t) for t in tags], *[(F.coalesce(a(f), F.lit(False)) | b(f)).alias(f) for f in flags],
        b("last_order").alias("last_order"), (F.coalesce(a("n_sightings"), F.lit(0)) + b("n_sightings")).alias("n_sightings"), latest("anchor"),
        F.when(b("anchor").isNotNull(), b("place")).otherwise(F.least(a("place"), b("place"))).alias("place"), latest("air"), latest("route"), earliest("seen_first"), latest("seen_last"), latest("proved"), latest("dated"),
        (F.coalesce(a("verified"), F.lit(False)) | b("verified")).alias("verified"), sources.alias("sources"), b("base").alias("base"), b("revived").alias("revived"), b("price_strong").alias("price_strong"), b("price_weak").alias("price_weak"),
        F.coalesce(a("price_first"), F.col("_first_price")).alias("price_first"), F.coalesce(F.col("_price_date"), a("price_date")).alias("price_date"), F.coalesce(F.col("_reductions"), a("price_reduction_count"), F.lit(0).cast("long")).alias("price_reduction_count"),
    )


def _with_columns(rows: DataFrame, order: str) -> DataFrame:
    """What the fold reads, and nothing else: these rows are shuffled and written."""
    facts, tags, flags = _names(rows)
    there = set(rows.columns)
    whole = rows.withColumns({n: F.lit(None).cast(t) for n, t in _GEO if n not in there})
    return whole.select(*dict.fromkeys(["property_id", "source_id", "verifies", "visible", "ts", order, *(n for n, _ in _GEO), *facts, *tags, *flags, *_own(rows)]))


def advance(state: DataFrame | None, batch: DataFrame, order: str = "seq") -> Advanced:
    """Fold ``batch`` into ``state`` (None: nothing is known).  All its rows must come behind the state's; ``Store.apply`` sees to that.

    Rows had best come in partitions by ``property_id``, as the windows then don't shuffle them twice.  With a column ``OWN`` journal and prices are those of its rows alone.
    """
    rows = _with_columns(batch, order)
    if state is None:
        shape = _part(_running(rows.withColumn("old", F.lit(None).cast(_old_type(rows))), order), rows, order)
        priced = shape.select("*", F.lit(None).cast("double").alias("price_first"), F.lit(None).cast(rows.schema["ts"].dataType).alias("price_date"), F.lit(0).cast("long").alias("price_reduction_count")).filter("false")
        state = rows.sparkSession.createDataFrame([], priced.schema)
    old = state.select("property_id", F.struct(*[c for c in state.columns if c != "property_id"]).alias("old"))
    of_rows = F.struct("sources", "price_strong", "price_weak", "base", "revived", "price_reduction_count").alias("old")
    # The batch with its running values, written once: three results read it.
    run = materialise(_running(rows.join(state.select("property_id", of_rows), "property_id", "left"), order), "batch")
    prices = _price_journal(run, order)
    moves = prices.groupBy("property_id").agg(F.min_by("new_price", order).alias("_first_price"), F.max_by("ts", order).alias("_price_date"), F.max("reductions").alias("_reductions"))
    said = (j.filter(OWN).drop(OWN) if _own(run) else j for j in (_journal(run, order), prices))
    return Advanced(_merged(_part(run, rows, order), old, moves, rows), *said)


def _old_type(rows: DataFrame) -> str:
    source, ts = (rows.schema[n].dataType.simpleString() for n in ("source_id", "ts"))
    return f"struct<sources: map<{source}, struct<shown: boolean, text_hash: string, first_seen: {ts}>>, price_strong: double, price_weak: double, base: string, revived: boolean, price_reduction_count: bigint>"


def snapshot_of(state: DataFrame) -> DataFrame:
    """The state as ``ingest.with_prices(ingest.snapshot(...))`` gives it."""
    facts = [c.removeprefix("strong_") for c in state.columns if c.startswith("strong_")]
    known = [F.coalesce(F.col(f"strong_{f}.v"), F.col(f"weak_{f}.v")).alias(f) for f in facts]
    more = [c for c in state.columns if c in (*TAGS, *FLAGS)]
    return state.select(
        "property_id", *known, F.col("air.v").alias("air_km"), F.col("route.km").alias("driving_km"), F.col("route.minutes").alias("driving_minutes"), F.col("seen_first.v").alias("first_seen"),
        F.col("seen_last.v").alias("last_seen"), F.col("proved.v").alias("last_verified"), F.col("dated.v").alias("source_date"), F.when(F.col("verified"), "verified").otherwise("unverified").alias("verification_status"),
        status(F.col("base"), F.col("revived")).alias("listing_status"), "n_sightings", *more, "place.lat", "place.lon", "place.geo_precision", "price_first", "price_date", F.col("price_reduction_count").cast("int").alias("price_reduction_count"),
    )


class Store:
    """State and log under one folder, both in buckets by a hash of the property: ``state/bucket=b``, ``log/batch_id=k/bucket=b``.

    A batch reads and replaces the state of its buckets alone.  Its log rows are written first and replaced if it comes again, so a failure at any point
    is mended by applying the batch again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, order: str = "seq"):
        self.spark, self.path, self.buckets, self.order = spark, path, buckets, order

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("property_id"), F.lit(self.buckets)).cast("int"))

    def _there(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _write(self, rows: DataFrame, name: str, *by: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{name}")

    def state(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The state of these buckets (None: all); the filter is one on folders, so others aren't read."""
        if not self._there("state"):
            return None
        out = self.spark.read.parquet(f"{self.path}/state")
        return (out if buckets is None else out.filter(F.col("bucket").isin(buckets))).drop("bucket")

    def log(self, buckets: list[int] | None = None, batch_id: int | None = None, mark: int | None = None) -> DataFrame:
        """The sightings of these buckets, or of one batch; ``mark`` adds whether a row is of that batch."""
        out = self.spark.read.parquet(f"{self.path}/log")
        out = out if batch_id is None else out.filter(F.col("batch_id") == batch_id)
        out = out if mark is None else out.withColumn(OWN, F.col("batch_id") == mark)
        return (out if buckets is None else out.filter(F.col("bucket").isin(buckets))).drop("bucket", "batch_id")

    def snapshot(self) -> DataFrame:
        return snapshot_of(self.state())

    def apply(self, batch: DataFrame, batch_id: int) -> Advanced:
        """Fold the batch in.  Returns the new states of its properties, its journal and its price moves, as tables."""
        rows = self._bucketed(batch)
        wide = rows.withColumn("batch_id", F.lit(batch_id))
        self._write(wide, "log", "batch_id", "bucket")
        # With its schema, as a log of empty batches has no file to tell it.
        rows = self.spark.read.schema(wide.schema).parquet(f"{self.path}/log").filter(F.col("batch_id") == batch_id).drop("batch_id")
        touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # as many numbers as there are buckets
        if not touched:
            return advance(None, rows.drop("bucket"), self.order)
        by_property = lambda df: df.repartition("property_id")
        state, rows = self.state(touched), rows.drop("bucket")
        if state is None:
            done = advance(None, by_property(rows), self.order)
        else:
            begins = rows.groupBy("property_id").agg(F.min(self.order).alias("_from"))
            late = materialise(state.select("property_id", "last_order").join(begins, "property_id").filter(F.col("_from") <= F.col("last_order")).select("property_id"), "late")
            on_time = advance(state, by_property(rows).join(late, "property_id", "left_anti"), self.order)
            done = on_time
            if not late.isEmpty():
                again = advance(None, self.log(touched, mark=batch_id).join(late, "property_id", "left_semi"), self.order)
                done = Advanced(*(x.unionByName(y) for x, y in zip(on_time, again, strict=True)))
        done = Advanced(*(materialise(x, f"advance-{k}") for k, x in zip(Advanced._fields, done, strict=True)))
        whole = done.state if state is None else done.state.unionByName(state.join(done.state.select("property_id"), "property_id", "left_anti"))
        # Written elsewhere first: a folder can't be read and replaced in one job.
        self._write(materialise(self._bucketed(whole), "states"), "state", "bucket")
        return done
