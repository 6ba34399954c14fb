"""WARC archives: writing with payload deduplication, and reading with boundary-chain verification.

Writing is the text writer with the records' terminator as its line separator: one archive per
task, on any file system that Spark writes to.  Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the
one with the largest id is the response, the others are revisits that refer to it.

Reading cuts the files at the record magic, split by split, so every place where the magic stands is a
*candidate*, also inside payloads.  A task parses each candidate's header where it reads it and emits only numbers: the
candidate's length and the length its header claims.  Running sums per file turn those into offsets and
successor offsets.  Candidates whose successor is the next candidate form runs; pointer jumping
over the runs (their number is a file's plus the jumps over false candidates) from each file's start keeps what the
chain reaches, in a logarithmic number of rounds, and rejects magic inside payloads.  Payloads that hold the magic are then
put together from the pieces between a record and its successor, from the files concerned only.

Odd inputs: a null payload is written as an empty one, a null id or URL as an absent header (and read as
null).  Rows that repeat the largest id of equal payloads are all responses.  Line breaks in a URL are
percent-encoded.  Records whose header ends early or claims no length end the chain.  Other columns are
ignored.  An empty table makes no archive and reads as no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, new_path

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
URN = "urn:landledger:page:"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One ``record`` (all but its terminator) per row."""
    raw = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), raw.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n"))
    # Only digests that occur again are joined; partial counts make a hot payload one row per task.
    again = rows.filter(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    # Written first, so that the planner knows its size: where it is small, no payload is shuffled.
    rows = rows.join(materialise(again, "warc-repeated"), "digest", "left")
    old = (F.col("n") >= LEAST_REVISIT) & F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.col(c).cast("string"), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(old, F.lit("revisit")).otherwise("response")),
        _line("WARC-Record-ID", urn("id")),
        _line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "%0A")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("X-Payload-Length", F.col("n").cast("string")),
        _line("WARC-Refers-To", F.when(old, urn("keeper"))),
        _line("WARC-Profile", F.when(old, F.lit(PROFILE))),
        _line("Content-Length", F.when(old, F.lit(0)).otherwise(F.col("n")).cast("string")),
        F.lit("\r\n"),
    )
    # Casts between binary and string leave the bytes as they are.
    return rows.select(F.concat(head, F.when(old, F.lit("")).otherwise(F.col("payload").cast("string"))).alias("record"))


def write_archives(recs: DataFrame, path: str) -> None:
    recs.select("record").write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """What stands between two magics, in reading order within a split."""
    raw = spark.read.schema("value string").option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value", (F.octet_length("value") + len(MAGIC)).cast("long").alias("size"))


def _in_file(df: DataFrame) -> DataFrame:
    """Add ``offset``: where the piece's magic starts.  The piece before a file's first magic has a negative one."""
    w = Window.partitionBy("file").orderBy("block", "pos")
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.select("*", (before - len(MAGIC)).alias("offset")).drop("block", "pos")


def _header(name: str) -> Column:
    found = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per place where the magic stands: file, offset, successor, the header's fields, and the payload's digest if the piece holds it all."""
    p = _pieces(spark, path).select("*", F.locate(END, F.col("value")).alias("stop"))
    p = p.select("*", F.expr("substring(value, 1, stop - 1)").alias("head"))
    p = p.select("*", F.when(F.col("stop") > 0, F.octet_length("head") + len(END)).alias("head_bytes"), _header("Content-Length").try_cast("long").alias("length"))
    whole = F.col("size") - len(MAGIC) >= F.col("head_bytes") + F.col("length")
    body = F.expr("substring(cast(value as binary), cast(head_bytes + 1 as int), cast(length as int))")
    p = p.select(
        "file", "block", "pos", "size", "head_bytes", "length", whole.alias("whole"), F.when(whole, F.sha1(body)).alias("digest"),
        _header("WARC-Type").alias("record_type"), F.regexp_extract("head", rf"(?im)^WARC-Record-ID:[ \t]*<{URN}(-?[0-9]+)>", 1).try_cast("long").alias("id"),
        F.regexp_extract("head", rf"(?im)^WARC-Refers-To:[ \t]*<{URN}(-?[0-9]+)>", 1).try_cast("long").alias("refers_to"),
        F.regexp_extract("head", r"(?im)^WARC-Payload-Digest:[ \t]*sha1:([0-9a-f]{40})", 1).alias("claimed_digest"), _header("X-Payload-Length").try_cast("long").alias("claimed_length"),
    )
    p = _in_file(p).filter(F.col("offset") >= 0)
    return p.select("*", (F.col("offset") + len(MAGIC) + F.col("head_bytes") + F.col("length") + len(END)).alias("successor"))


def reached(found: DataFrame) -> DataFrame:
    """The candidates that the chain from their file's start reaches."""
    w = Window.partitionBy("file").orderBy("offset")
    step = found.select("*", F.lead("offset").over(w).alias("_next"))
    jumps = step.filter(F.col("successor").isNotNull() & F.col("_next").isNotNull() & (F.col("successor") > F.col("_next"))).select("file", F.col("successor").alias("offset"), F.lit(True).alias("_hit")).distinct()
    step = step.join(jumps, ["file", "offset"], "left")
    follows = F.coalesce(F.lag("successor").over(w) == F.col("offset"), F.lit(False))
    step = step.select("*", (F.col("_hit").isNotNull() | ~follows).alias("_first"))
    step = materialise(step.select("*", F.max(F.when(F.col("_first"), F.col("offset"))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_run")).drop("_first", "_hit", "_next"), "warc-runs")
    runs = step.groupBy("file", "_run").agg(F.max_by("successor", "offset").alias("to"))
    if step.filter(F.col("_run") > 0).isEmpty():
        return step.drop("_run")
    jump = materialise(runs.select("file", F.col("_run").alias("at"), "to").filter(F.col("to").isNotNull()), "warc-jumps")
    reach = materialise(runs.filter("_run = 0").select("file", F.col("_run").alias("at")), "warc-reach")
    n = reach.count()
    while True:
        more = reach.union(reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct()
        reach = materialise(more, "warc-reach")
        far = jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.at"))).select("a.file", "a.at", "b.to")
        jump = materialise(far, "warc-jumps")
        n, before = reach.count(), n
        # Chains end at offsets where no run starts, once each; when nothing is added, everything is reached.
        if n == before:
            break
    return step.join(reach.select("file", F.col("at").alias("_run")), ["file", "_run"], "left_semi").drop("_run")


def _assembled(spark: SparkSession, path: str, good: DataFrame) -> DataFrame:
    """file, offset, digest of the payloads that hold the magic."""
    open_records = good.filter(~F.col("whole"))
    files = open_records.select("file").distinct()
    pieces = _in_file(_pieces(spark, path).join(files, "file", "left_semi")).filter(F.col("offset") >= 0)
    marks = good.join(files, "file", "left_semi").select("file", "offset", F.col("offset").alias("owner"), "head_bytes", "length", "whole")
    both = pieces.join(marks, ["file", "offset"], "left")
    w = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    both = both.select("file", "offset", "value", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in ("owner", "head_bytes", "length", "whole")]).filter(~F.col("whole"))
    # The pieces of one record: no more than the record itself.
    grouped = both.groupBy("file", "owner", "head_bytes", "length").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC).alias("text"))
    body = F.expr("substring(cast(text as binary), cast(head_bytes + 1 as int), cast(length as int))")
    return grouped.select("file", F.col("owner").alias("offset"), F.sha1(body).alias("put_together"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record that the chain reaches: file, offset, id, record_type, refers_to, payload_bytes, payload_digest, intact (the digest is the one its header claims)."""
    good = reached(candidates(spark, path))
    if not good.filter(~F.col("whole")).isEmpty():
        good = good.join(_assembled(spark, path, good), ["file", "offset"], "left")
    else:
        good = good.withColumn("put_together", F.lit(None).cast("string"))
    own = F.coalesce("digest", "put_together")
    old = F.col("record_type") == "revisit"
    return good.select(
        "file", "offset", "id", "record_type", F.when(old, F.col("refers_to")).alias("refers_to"), F.when(old, F.col("claimed_length")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(old, F.col("claimed_digest")).otherwise(own).alias("payload_digest"), (old | own.eqNullSafe(F.col("claimed_digest"))).alias("intact"),
    )


def through_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back.  Columns: the id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(records(pages, id_col, url_col, payload_col), path)
    out = read_archives(spark, path)
    return out.select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""
