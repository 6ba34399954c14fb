import hashlib

from landledger.llm import warc


def brute(rows):
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, b in raw:
        twins = [j for j, c in raw if c == b and j is not None]
        keeper = max(twins, default=None) if len(b) >= 1000 else None
        old = keeper is not None and i != keeper
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if old else "response", keeper if old else None))
    return sorted(out, key=repr)


def fake(n, body="x", claim=None):
    return f"{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <{warc.URN}{n}>\r\nContent-Length: {len(body) if claim is None else claim}\r\n\r\n{body}{warc.END}"


ROWS = [
    (1, "http://a/", "short"), (2, "http://a/", "short"), (3, None, None), (4, "http://é\r\nWARC-Type: x", ""), (None, "u", "n" * 1200), (5, "u", "n" * 1200), (6, "u", "n" * 1200), (6, "u", "n" * 1200),
    (7, "u", "pre " + fake(900) + " post"), (8, "u", fake(901) * 5), (9, "u", "a" * 500 + fake(902, claim=700) + "é漢𝄞" * 300), (10, "u", warc.MAGIC * 40), (11, "u", "ends with " + warc.MAGIC), (12, "u", "\r\n\r\n" * 20), (13, "u", fake(903, "y" * 5000)), (14, "u", fake(903, "y" * 5000)),
]


def test_round_trip_with_magic_in_payloads(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, digest string")
    for parts in (1, 3):
        out = warc.through_archives(df.repartition(parts)).collect()
        assert sorted(map(tuple, out), key=repr) == brute(ROWS)


def test_splits_inside_records(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        path = warc.new_path(spark, "warc-test")
        df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
        warc.write_archives(warc.records(df).coalesce(1), path)
        out = warc.read_archives(spark, path)
        assert sorted([(r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out.collect()], key=repr) == brute(ROWS)
        assert out.filter("not intact").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty(spark):
    assert warc.through_archives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
