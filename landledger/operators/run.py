"""One run from sources to the report: read, normalise, resolve, fold, prove absences, score, report.

Tables under one base folder carry over from run to run: ``fold`` (state and log, ``fold_state.Store``), ``links`` (which listing of which source stands for
which property), ``journal``, ``prices``, ``score`` and ``cost`` (``ScoreStore``), ``report`` and ``stages``.  A run is a batch for each of them, so it costs what it
brings, and the buckets and candidates that this touches.  Every stage's counters come with the table it writes (``Observation``), not from passes of their
own.  A run that failed is started again under its number: batches are replaced, not doubled.

Ids are made from a listing's own key (source and URL), so they don't depend on the order in which listings are met; new listings that are
duplicates of each other take the smallest id among them.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..functions.text import fold
from ..search_profile import Profile
from ..sources.portals import Reading
from ..workspace import materialise, small_broadcasts
from . import blocking, digest, fold_state, ingest, lifecycle, links, report, resolve, score, score_store
from .normalize import normalize_listings

#: What scoring reads of a property and a fold doesn't keep: unknown until somebody says it.
UNSAID = {"condition": "string", "user_state": "string", "user_tier": "string", "user_title": "string", "shortlisted_at": "timestamp", "n_images": "int", "driving_km": "double", "air_km": "double", "evidence_keys": "array<string>"}


class RunResult(NamedTuple):
    """``counters``: stage to name to number."""

    counters: dict[str, dict[str, int]]
    digest: digest.Digest


class Run:
    def __init__(self, spark: SparkSession, base: str, sources: DataFrame, profile: Profile, run_id: int, now: datetime, buckets: int = fold_state.BUCKETS):
        """``sources``: source_id (long), source_key, role, reliability, ttl_days.  ``now`` must rise from run to run."""
        self.spark, self.base, self.sources, self.profile, self.run_id, self.now = spark, base, sources, profile, run_id, now
        self.store = fold_state.Store(spark, f"{base}/fold", buckets)
        self.scores, self.costs = score_store.ScoreStore(spark, f"{base}/score", buckets), score_store.ScoreStore(spark, f"{base}/cost", buckets, by=None)
        self.counters: dict[str, dict[str, int]] = {}

    def _stage(self, name: str, rows: DataFrame, **counts: Column) -> DataFrame:
        """Write the stage's rows and take its counters on the way."""
        seen = Observation(name)
        out = materialise(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()]), f"run-{name}")
        self._note(name, seen.get)
        return out

    def _note(self, name: str, counts: dict) -> None:
        self.counters[name] = {k: int(v) for k, v in counts.items()}

    def _keep(self, rows: DataFrame, name: str) -> None:
        """A table with a folder for each run; the run again replaces its own."""
        out = rows.withColumn("run_id", F.lit(self.run_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{self.base}/{name}")

    def _kept(self, name: str) -> DataFrame | None:
        """What earlier runs kept."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.parquet(f"{self.base}/{name}").filter(F.col("run_id") < self.run_id)

    def read(self, readings: dict[str, Reading], places: DataFrame | None = None) -> DataFrame:
        """Typed listings of all sources, one for each source and URL.  ``places``: town, lat, lon."""
        raw = None
        for key, reading in sorted(readings.items()):
            some = reading.listings.withColumn("source_key", F.lit(key))
            raw = some if raw is None else raw.unionByName(some, allowMissingColumns=True)
        if "page_kind" not in raw.columns:
            raw = raw.withColumn("page_kind", F.lit("listing"))
        typed = normalize_listings(raw.filter(F.trim("url") != "").dropDuplicates(["source_key", "url"]), F.lit(self.now.date()))
        typed = typed.join(self.sources.select("source_id", "source_key", F.col("role").isin("primary", "local").alias("verifies")), "source_key")
        if places is not None:
            lat, lon = self.profile.centre
            at = places.groupBy(fold(F.col("town")).alias("_town")).agg(F.min(F.struct("lat", "lon")).alias("_at"))
            typed = typed.join(at, fold(F.col("town")) == F.col("_town"), "left").withColumns({"lat": F.col("_at.lat"), "lon": F.col("_at.lon"), "geo_precision": F.when(F.col("_at").isNotNull(), "town")}).drop("_town", "_at")
            typed = typed.withColumn("air_km", haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")))
        else:
            typed = typed.withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double"), "geo_precision": F.lit(None).cast("string"), "air_km": F.lit(None).cast("double")})
        key = F.xxhash64("source_key", "url").bitwiseAND(F.lit(2**63 - 1))
        return self._stage("read", typed.withColumn("listing_id", key), listings=F.col("page_kind") == "listing", warned=F.size("warnings") > 0)

    def resolve(self, typed: DataFrame) -> DataFrame:
        """The listings with ``property_id``: known by their source's own key, found as a duplicate, or new."""
        kept = self._kept("links")
        own = typed.withColumn("known_id", F.lit(None).cast("long")) if kept is None else ingest.known_ids(typed, kept)
        own = self._stage("known", self._judged(own), known=F.col("known_id").isNotNull(), refused=F.col("refused").isNotNull())
        own = own.filter("refused is null")
        new = own.filter("known_id is null")
        f = resolve.listing_facts(new)
        known_state = self.store.state()
        if kept is not None and known_state is not None:
            # Where the run comes again, what it made new the first time isn't there yet.
            before = fold_state.snapshot_of(known_state).join(new.select(F.col("listing_id").alias("property_id")), "property_id", "left_anti")
            verdicts = resolve.find_duplicates(f, resolve.property_facts(before, kept))
            verdicts = self._stage("duplicates", verdicts, duplicates=F.col("is_duplicate"), to_review=F.col("needs_review"))
        else:
            verdicts = f.select(F.col("id").alias("listing"), F.lit(None).cast("long").alias("candidate"), F.lit(False).alias("is_duplicate"))
        found = verdicts.filter("is_duplicate").select(F.col("listing").alias("listing_id"), F.col("candidate").alias("found_id"))
        # New ones among themselves.
        rest = materialise(f.join(found.withColumnRenamed("listing_id", "id"), "id", "left_anti"), "run-new")
        pairs = blocking.candidate_pairs(rest, agreeing=True)
        sides = pairs.join(rest.select(F.struct("*").alias("fa")), F.col("a") == F.col("fa.id")).join(rest.select(F.struct("*").alias("fb")), F.col("b") == F.col("fb.id"))
        edges = resolve.evidence(sides.select(F.col("fa").alias("a"), F.col("fb").alias("b"))).filter("is_duplicate").select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))
        edges = materialise(edges, "run-edges")
        one = links.components(edges).select(F.col("node").alias("listing_id"), F.col("component").alias("group_id")) if not edges.isEmpty() else edges.select(F.col("u").alias("listing_id"), F.col("v").alias("group_id"))
        out = own.join(found, "listing_id", "left").join(one, "listing_id", "left")
        out = out.withColumn("property_id", F.coalesce("known_id", "found_id", "group_id", "listing_id"))
        return self._stage("resolve", out, new=F.col("known_id").isNull() & F.col("found_id").isNull() & (F.coalesce("group_id", "listing_id") == F.col("listing_id")), merged=F.coalesce(F.col("group_id") != F.col("listing_id"), F.lit(False)))

    def _judged(self, rows: DataFrame) -> DataFrame:
        """Why a listing is dropped before it is remembered; what is known stays."""
        reason = report.reject_reason(self.profile.radius.air_km_max)
        return rows.withColumns({"known": F.col("known_id").isNotNull(), "triage_rejects": F.lit(False)}).withColumn("refused", reason).drop("known", "triage_rejects")

    def fold(self, resolved: DataFrame) -> fold_state.Advanced:
        """Append the sightings and fold them in; keep journal, prices and links."""
        facts = [c for c in (*ingest.FACTS, *ingest.TAGS, *ingest.FLAGS, "lat", "lon", "geo_precision", "air_km", "source_date", "text_hash", "url") if c in resolved.columns]
        rows = resolved.select("property_id", "source_id", "verifies", F.lit(True).alias("visible"), F.lit(self.now).alias("ts"), self._order(0, F.col("source_id"), F.col("url")).alias("seq"), *[F.col(c).cast("timestamp") if c == "source_date" else F.col(c) for c in facts])
        done = self.store.apply(rows, 2 * self.run_id)
        self._keep(resolved.select("property_id", "source_id", "source_key", "url", "external_id", "contact_kind", "contact_detail", F.col("source_date").cast("timestamp").alias("source_date"), F.lit(self.now).alias("seen")), "links")
        self._note("fold", {"sightings": self.counters["resolve"]["rows"]})
        return done

    def _order(self, phase: int, source: Column, url: Column) -> Column:
        return F.struct(F.lit(self.run_id).cast("long").alias("run"), F.lit(phase).alias("phase"), source.cast("long").alias("source"), F.coalesce(url, F.lit("")).alias("url"))

    def absences(self, readings: dict[str, Reading], resolved: DataFrame) -> fold_state.Advanced | None:
        """What the run proves gone, as sightings that show it isn't there."""
        whole = [k for k, r in readings.items() if r.enumerated is not None and r.incomplete is None]
        if not whole:
            return None
        runs = self.sources.filter(F.col("source_key").isin(whole)).select("source_id", F.col("role").isin("primary", "local").alias("can_verify"), F.lit(True).alias("complete"), F.col("ttl_days").cast("int").alias("ttl_days"))
        state = self.store.state()
        rows = state.select("property_id", F.explode("sources").alias("source_id", "s"), "base", "revived").select("property_id", "source_id", F.coalesce("s.shown", F.lit(False)).alias("visible"), F.col("s.first_seen").alias("first_seen"), fold_state.status(F.col("base"), F.col("revived")).alias("status"))
        # What was enumerated and left out still stands, if its URL is known.
        listed = None
        for key in whole:
            some = readings[key].enumerated.select("url").withColumn("source_key", F.lit(key))
            listed = some if listed is None else listed.union(some)
        listed = listed.join(self.sources.select("source_key", "source_id"), "source_key")
        links_now = self.spark.read.parquet(f"{self.base}/links").filter(F.col("run_id") <= self.run_id)
        seen = ingest.credited(resolved, listed, links_now)
        moved, refused = lifecycle.mark_missing(rows, seen, runs, F.lit(self.now))
        gone = self._stage("absent", moved, expired=F.col("expired"), removed=F.col("new_status") == "removed")
        self._stage("refusals", refused)
        gone = gone.select("property_id", "source_id", F.lit(True).alias("verifies"), F.lit(False).alias("visible"), F.lit(self.now).alias("ts"), self._order(1, F.col("source_id"), F.lit("")).alias("seq"))
        # The log's other columns are unknown to an absence.
        names = {f.name: f.dataType for f in self.store.log().schema.fields}
        gone = gone.select(*[F.col(n) if n in gone.columns else F.lit(None).cast(t).alias(n) for n, t in names.items()])
        # Where the run comes again, the state knows its absences already: they are stated again, so that the journal is whole.
        batch = 2 * self.run_id + 1
        gone = materialise(gone.unionByName(self.store.log(batch_id=batch)).dropDuplicates(["property_id", "source_id"]), "run-gone")
        return None if gone.isEmpty() else self.store.apply(gone, batch)

    def properties(self) -> DataFrame:
        """The snapshot with all columns that scoring reads."""
        snap = self.store.snapshot()
        out = snap.withColumns({n: F.lit(None).cast(t) for n, t in UNSAID.items() if n not in snap.columns})
        empty = F.array().cast("array<string>")
        return out.withColumns({**{t: F.coalesce(F.col(t), empty) if t in out.columns else empty for t in (*ingest.TAGS, "evidence_keys")}, **{f: F.coalesce(F.col(f), F.lit(False)) if f in out.columns else F.lit(False) for f in ingest.FLAGS}, "updated_at": F.col("last_seen")})

    def source_rows(self) -> DataFrame:
        """What stands for each property now, one row a source and URL."""
        kept = self.spark.read.parquet(f"{self.base}/links").filter(F.col("run_id") <= self.run_id)
        names = [c for c in kept.columns if c not in ("property_id", "source_id", "url")]
        rows = kept.groupBy("property_id", "source_id", "url").agg(F.max_by(F.struct(*names), "run_id").alias("r"), F.min("seen").alias("first_seen")).select("property_id", "source_id", "url", "r.*", "first_seen")
        return lifecycle.assign_best(rows.join(self.sources.select("source_id", "role", "reliability"), "source_id").withColumn("last_seen", F.col("seen")))

    def score(self, props: DataFrame, rows: DataFrame) -> DataFrame:
        """Score what changed; gives all properties with their kept scores and costs."""
        facts = score.source_facts(rows.drop("role", "reliability"), self.sources)
        done = score_store.rescore_dirty(props, facts, self.profile, F.lit(self.now), self.scores, self.costs, self.run_id)
        self._stage("score", done.select("property_id", "rejected"), rejected=F.col("rejected"))
        return score_store.with_kept(props, self.profile, self.scores, self.costs)

    def report(self, scored: DataFrame, rows: DataFrame, towns: list[str], days: int = 7) -> digest.Digest:
        since = F.lit(self.now - timedelta(days=days))
        until = F.col("run_id") <= self.run_id
        journal = self.spark.read.parquet(f"{self.base}/journal").filter(until)
        early = rows.groupBy("property_id").agg(F.min("first_seen").alias("earliest"))
        categories = report.categorise(scored.select("property_id").join(early, "property_id", "left"), journal, since)
        seen = self.spark.read.parquet(f"{self.base}/links").filter(until).select("property_id", "source_id", F.col("seen").alias("ts"))
        yields = report.source_yield(seen, scored, self.sources, since, self.profile.radius.air_km_max)
        expected = self.spark.createDataFrame(list(enumerate(towns)), "ord int, town string")
        urls = report.best_url(rows.withColumns({"verifies": F.col("role").isin("primary", "local"), "visible": F.lit(True)}))
        d = digest.build(scored, categories, early, urls, yields, report.coverage(scored, expected), self.profile, since, F.lit(self.now))
        digest.save_report(self.spark, d, f"{self.base}/report")
        self._note("report", {"entries": len(d.entries)})
        return d

    def whole(self, readings: dict[str, Reading], places: DataFrame | None = None, towns: list[str] | None = None) -> RunResult:
        """All stages in order.  Their counters are logged as far as they came, also where one fails."""
        with small_broadcasts(self.spark):
            return self._whole(readings, places, towns)

    def _whole(self, readings: dict[str, Reading], places: DataFrame | None, towns: list[str] | None) -> RunResult:
        try:
            resolved = self.resolve(self.read(readings, places))
            steps = [self.fold(resolved), self.absences(readings, resolved)]
            for name in ("journal", "prices"):
                made = [getattr(s, name) for s in steps if s is not None]
                self._keep(made[0] if len(made) == 1 else made[0].unionByName(made[1]), name)
            rows = materialise(self.source_rows(), "run-sources")
            props = materialise(self.properties(), "run-properties")
            quiet = [r[0] for r in self.sources.filter("role = 'discovery'").select("source_id").collect()]  # the registry is small
            self._stage("stale", lifecycle.stale(props, rows, quiet, F.lit(self.now)))
            return RunResult(self.counters, self.report(materialise(self.score(props, rows), "run-scored"), rows, towns or []))
        finally:
            log = [(n, stage, {k: str(v) for k, v in c.items()}) for n, (stage, c) in enumerate(self.counters.items())]
            self._keep(self.spark.createDataFrame(log, "n int, stage string, detail map<string,string>").coalesce(1), "stages")


def stage_log(spark: SparkSession, base: str) -> DataFrame:
    """run_id, n, stage and its counters, newest run first, stages in order."""
    return spark.read.parquet(f"{base}/stages").orderBy(F.col("run_id").desc(), "n")
