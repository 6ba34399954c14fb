import re

from landledger.llm import url_filters as u


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h + p), v, h + p) for v, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, "allow", None))
    return host, path, best[2], best[1]


URLS = [None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y=/en/", "https://example.com/en", "https://example.com/en/#a", "http://a.net/es/q", "http://net/fr/", "http://xnet/fr/",
        "http://badexample.com/en/1", "http://É.example.com/en/", "http://a.b.c.d.www.example.com/en/é", "http://x.com?u=http://example.com/en/", "http://x.net#/es/", "http://u:p@example.com:80/en/", "a://b://example.com/en/", "http://.com/", "http://example.com./en/", "http://" + "a." * 2000 + "net/es/" + "y" * 5000]


def test_equals_brute_force_with_repeats_and_clashes(spark):
    rows = [(i % 5 if i else None, x, "h", "r") for i, x in enumerate(URLS + URLS[:4])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = sorted(map(tuple, u.judge_urls(df, u.rule_table(spark)).collect()), key=repr)
    assert got == sorted([(i, *brute(x)) for i, x, *_ in rows], key=repr)


def test_empty_tables_and_equal_rules(spark):
    df = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert u.judge_urls(df.limit(0), u.rule_table(spark)).count() == 0
    assert u.judge_urls(df, u.rule_table(spark).limit(0)).collect()[0]["verdict"] == "allow"
    twice = u.rule_table(spark, [("allow", "a.com", "/"), ("block", "a.com", "/"), ("allow", "com", "/x")])
    r = u.judge_urls(df, twice).collect()[0]
    assert (r["rule"], r["verdict"]) == ("a.com/", "block")


def test_rule_tables_that_are_shuffled_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(u, "BROADCAST_RULES", 0)
    test_equals_brute_force_with_repeats_and_clashes(spark)
    test_empty_tables_and_equal_rules(spark)
