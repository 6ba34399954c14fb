"""Command line of the library; ``python -m landledger.cli --help`` lists the commands.  Tables are Parquet folders under one base folder."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from .search_profile import PROFILES


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="landledger")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the registered queries")
    sub.add_parser("config", help="the named profiles").add_argument("--name", default="shipped", choices=sorted(PROFILES))

    def command(name: str, text: str, *args: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for a in args:
            c.add_argument(a)
        return c

    command("query", "run a query over a folder of tables and write Parquet", "name", "tables", "out")
    command("import", "read a delimited file, normalise it and write Parquet", "file", "out")
    c = command("read", "read a source by the name of its reader and write its raw listings", "kind", "out")
    c.add_argument("--source", default="manual")
    c.add_argument("--option", action="append", default=[], help="name=value")
    c = command("rescore", "score the properties (tables property, property_source, source) under a profile, and keep the scores (score)", "base")
    c.add_argument("--name", default="shipped", choices=sorted(PROFILES))
    command("repair-removals", "write the removals (tables property, status_history) that no reporting source stands behind", "base", "out").add_argument("--non-reporting", action="append", default=[])
    command("delete-property", "write the tables without a property", "base", "property_id", "out")
    command("documents", "document to open for each property (table document)", "base", "out")
    c = command("run", "read the sources of a JSON registry (list of source_id, source_key, role, reliability, ttl_days, kind, options), fold, score and report", "base", "registry", "run_id")
    c.add_argument("--name", default="shipped", choices=sorted(PROFILES))
    c.add_argument("--town", action="append", default=[], help="a town that should have listings")
    command("report", "write the last reports of a base folder as Markdown, one row each", "base", "out")
    command("stages", "print the counters of the last runs' stages", "base")
    command("backup", "copy all tables into a new folder", "base", "out")
    return parser


def _tables(spark, base: str) -> dict[str, str]:
    there = spark._jvm.org.apache.hadoop.fs.Path(base)
    found = there.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(there)
    return {s.getPath().getName(): s.getPath().toString() for s in found if s.isDirectory()}


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "config":
        p = PROFILES[a.name]
        print(json.dumps({**asdict(p), "profile_hash": p.profile_hash}, indent=2, default=str))
        return 0
    from .plans import history_queries, queries, run_queries

    known = {**queries.QUERIES, **history_queries.QUERIES, **run_queries.QUERIES}
    if a.command == "list":
        print("\n".join(known))
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import digest, lifecycle, report, score

    spark = SparkSession.builder.appName("landledger").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    table = lambda name: spark.read.parquet(f"{a.base}/{name}")
    if a.command == "query":
        known[a.name](spark, a.tables).write.mode("overwrite").parquet(a.out)
    elif a.command == "import":
        from .operators.normalize import normalize_listings
        from .sources.files import read_delimited

        normalize_listings(read_delimited(spark, a.file), F.current_date()).write.mode("overwrite").parquet(a.out)
    elif a.command == "read":
        from .sources.portals import read_source

        got = read_source(spark, a.source, a.kind, dict(o.split("=", 1) for o in a.option))
        got.listings.write.mode("overwrite").parquet(a.out)
        print(json.dumps({"enumerates": got.enumerated is not None, "incomplete": got.incomplete}))
    elif a.command == "run":
        from datetime import UTC, datetime

        from .operators.run import Run
        from .sources.portals import read_source

        with open(a.registry, encoding="utf-8") as f:
            registry = json.load(f)
        names = ("source_id", "source_key", "role", "reliability", "ttl_days")
        known_sources = spark.createDataFrame([tuple(r.get(n) for n in names) for r in registry], "source_id long, source_key string, role string, reliability double, ttl_days int")
        readings = {r["source_key"]: read_source(spark, r["source_key"], r["kind"], r.get("options", {})) for r in registry}
        done = Run(spark, a.base, known_sources, PROFILES[a.name], int(a.run_id), datetime.now(UTC).replace(tzinfo=None)).whole(readings, towns=a.town)
        print(json.dumps(done.counters))
    elif a.command == "report":
        spark.read.parquet(f"{a.base}/report").select("week_label", "profile_hash", "markdown").write.mode("overwrite").parquet(a.out)
    elif a.command == "stages":
        from .operators.run import stage_log

        for r in stage_log(spark, a.base).limit(100).collect():
            print(json.dumps(r.asDict()))
    elif a.command == "rescore":
        facts = score.source_facts(table("property_source"), table("source"))
        report.write_scores(score.rescore_all(table("property"), facts, PROFILES[a.name], F.current_timestamp()), f"{a.base}/score")
    elif a.command == "repair-removals":
        lifecycle.repair_removals(table("property"), table("status_history"), a.non_reporting).write.mode("overwrite").parquet(a.out)
    elif a.command == "delete-property":
        kept = lifecycle.delete_property({n: spark.read.parquet(p) for n, p in _tables(spark, a.base).items() if "property_id" in spark.read.parquet(p).columns}, int(a.property_id))
        for name, df in kept.items():
            df.write.mode("overwrite").parquet(f"{a.out}/{name}")
    elif a.command == "documents":
        digest.pick_document(table("document")).write.mode("overwrite").parquet(a.out)
    else:
        print(json.dumps(digest.backup(spark, _tables(spark, a.base), a.out)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
