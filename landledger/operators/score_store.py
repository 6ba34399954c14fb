"""Kept scores and costs: an appended table in folders of profile and bucket, of which each property's latest row counts.

A rescoring of the dirty rows alone appends those rows; clean ones stay as they were.  A reader takes the last row of each property, by
``updated_at`` and then by the append's number; the folders of the profile (and of the buckets asked for) are all it reads.
``compact`` replaces the folders of buckets with many superseded rows by their latest rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import materialise, small_methods

BUCKETS = 64


class ScoreStore:
    """``key`` names the rows, ``by`` the column whose values are kept apart (None: all rows are of one kind, as costs are)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, key: str = "property_id", by: str | None = "profile_hash"):
        self.spark, self.path, self.buckets, self.key, self.by = spark, path, buckets, key, by

    @property
    def _folders(self) -> list[str]:
        return [*([self.by] if self.by else []), "bucket"]

    def append(self, rows: DataFrame, version: int) -> None:
        """``rows`` have ``updated_at``.  ``version`` is the run's number; the same run again replaces nothing and changes no result."""
        out = rows.withColumns({"bucket": F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"), "version": F.lit(version).cast("long")})
        out.write.mode("append").partitionBy(*self._folders).parquet(self.path)

    def exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _rows(self, value: str | None, buckets: list[int] | None = None) -> DataFrame:
        out = self.spark.read.parquet(self.path)
        if value is not None:
            out = out.filter(F.col(self.by) == value)
        return out if buckets is None else out.filter(F.col("bucket").isin(buckets))

    def _latest(self, rows: DataFrame, *by: str) -> DataFrame:
        """One aggregation with map-side parts.  It carries all of ``rows``' columns: leave out what isn't wanted before."""
        names = [c for c in rows.columns if c not in by]
        return rows.groupBy(*by).agg(F.max_by(F.struct(*names), F.struct("updated_at", "version")).alias("_r")).select(*by, "_r.*")

    def _keys(self) -> list[str]:
        return [self.key, *([self.by] if self.by else [])]

    def read(self, value: str | None = None, buckets: list[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """The latest row of each key of the profile ``value``.  With ``columns`` no others are read (but the key's) nor carried along."""
        rows = self._rows(value, buckets)
        if columns is None:
            return self._latest(rows, *self._keys()).drop("bucket", "version")
        read = dict.fromkeys([*self._keys(), *columns, "updated_at", "version"])
        return self._latest(rows.select(*read), *self._keys()).select(*dict.fromkeys([*self._keys(), *columns]))

    def updates(self, value: str | None = None) -> DataFrame:
        """When each key was last appended: an aggregation of fixed-width columns, of which no rows are sorted."""
        return self._rows(value).groupBy(*self._keys()).agg(F.max("updated_at").alias("updated_at"))

    def compact(self, most: float = 2.0, value: str | None = None) -> list[tuple]:
        """Keep only latest rows in the folders that hold over ``most`` rows a key; gives these folders.

        One folder is one bucket of one profile, so the counts that reach the driver are as many as there are folders.
        """
        rows = self._rows(value)
        keys = rows.groupBy(*self._folders, self.key).agg(F.count(F.lit(1)).alias("n"))
        per = keys.groupBy(*self._folders).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).filter(F.col("n") > most * F.col("k"))
        full = [tuple(r)[:-2] for r in per.collect()]
        if not full:
            return []
        chosen = rows.filter(F.struct(*self._folders).isin(*[F.struct(*map(F.lit, f)) for f in full]))
        latest = self._latest(chosen, *self._folders, self.key)
        # Written elsewhere first: a folder can't be read and replaced in one job.
        out = materialise(latest, "compacted").select(*rows.columns)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self._folders).parquet(self.path)
        return full


def rescore_dirty(props: DataFrame, facts: DataFrame, profile, now, scores: ScoreStore, costs: ScoreStore, version: int) -> DataFrame:
    """Score what has no score or cost, or was updated since, and append both.  Returns the rows that were scored.

    Give ``facts`` as a table where more than one scoring reads it.  Properties go to their partitions by id first: all cores score, however few files
    they come from, and joins on the id find them in place.
    """
    from .score import rescore_all

    kept = scores.updates(profile.profile_hash) if scores.exists() else None
    known = costs.updates().select("property_id") if costs.exists() else None
    with small_methods(scores.spark):
        placed = props.repartition(int(scores.spark.conf.get("spark.sql.shuffle.partitions")), "property_id")
        done = materialise(rescore_all(placed, facts, profile, now, kept, known), "rescored")
    scores.append(done.select("property_id", "profile_hash", *SCORES, "updated_at"), version)
    costs.append(done.select("property_id", *COSTS, "updated_at"), version)
    return done


def with_kept(props: DataFrame, profile, scores: ScoreStore, costs: ScoreStore) -> DataFrame:
    """All properties with what is kept of them; those that were never scored have nulls."""
    own = scores.read(profile.profile_hash).drop("updated_at")
    names = {*own.columns, *COSTS} - {"property_id"}
    return props.drop(*names).join(own, "property_id", "left").join(costs.read().drop("updated_at"), "property_id", "left")


#: What a score row and a cost row keep.
SCORES = ("fit_score", "deal_score", "hidden_score", "freshness_score", "confidence_score", "final_score", "rejected", "shortlist_blocked", "reject_reasons", "flags", "capital_risk")
COSTS = ("renovation_tier", "renovation_evidence", "purchase_price", "acquisition_costs", "renovation_low", "renovation_mid", "renovation_high", "immediate_capex", "total_low", "total_mid", "total_high")
