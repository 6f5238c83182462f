import math

from inkstone.llm import url_filter
from tests.llm.conftest import rows

URLS = [
    (1, "https://a.example.com/en/7x?q=1", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
    (2, "http://Example.COM/en/81#x", "example.com", "/en/81", "com/en/", "block"),
    (3, "http://b.example.net/de/812", "b.example.net", "/de/812", "example.net/de/8", "block"),
    (4, "http://c.net/de/812", "c.net", "/de/812", "net/de/", "allow"),
    (5, "https://org/es/", "org", "/es/", "org/es/", "block"),
    (6, "https://xorg/es/", "xorg", "/es/", None, None),
    (7, "https://a.org/ES/", "a.org", "/ES/", None, None),
    (8, None, "", "", None, None),
    (9, "a.com/en/1", "", "", None, None),
    (10, "http://a.com", "a.com", "", None, None),
    (11, "http://a.com?x=/en/", "a.com", "", None, None),
    (12, "x://y://a.com/en/", "y:", "//a.com/en/", None, None),
    (None, "", "", "", None, None),
    (1, "http://a.com/en/#/x", "a.com", "/en/", "com/en/", "block"),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([r[:2] for r in URLS], "page_id long, url string").selectExpr("*", "'h' as host", "'r' as rule", "1 as id")
    out = url_filter.judge_urls(df)
    got = [(r["page_id"], r["host"], r["path"], r["rule"]) for r in out.collect()]
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(got, key=key) == sorted([(a, h, p, r) for a, _, h, p, r, _ in URLS], key=key)
    verdicts = {(r["page_id"], r["path"]): r["verdict"] for r in out.collect()}
    assert all(verdicts[(a, p)] == v for a, _, _, p, _, v in URLS if v)
    assert set(verdicts.values()) <= {"allow", "block"}


def test_the_models_tell_unruled_urls_apart(spark):
    rules = (("allow", "good.com/"), ("block", "bad.com/"))
    urls = [(i, f"http://good.com/news/world/{i}") for i in range(200)] + [(1000 + i, f"http://bad.com/casino/win-{i}") for i in range(200)]
    urls += [(5000 + i, f"http://else.org/news/world/{7 * i}") for i in range(30)] + [(6000 + i, f"http://else.org/casino/win-{7 * i}") for i in range(30)]
    out = url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rules=rules)
    v = {r["page_id"]: r["verdict"] for r in out.collect()}
    assert all(v[5000 + i] == "allow" for i in range(30)) and all(v[6000 + i] == "block" for i in range(30))


def test_rules_of_one_kind_and_an_empty_table_allow(spark):
    df = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.com/y")], "page_id long, url string")
    assert {r["verdict"] for r in url_filter.judge_urls(df, rules=()).collect()} == {"allow"}
    assert rows(url_filter.judge_urls(df, rules=(("block", "a.com/"),)), "page_id", "verdict") == [(1, "block"), (2, "allow")]
    assert url_filter.judge_urls(df.limit(0)).collect() == []


def test_the_counts_are_exact(spark):
    """Differences by brute force over strings."""
    rules = (("allow", "good.com/"), ("block", "bad.com/"))
    urls = [(i, f"http://good.com/né{i % 7}/w{i}") for i in range(40)] + [(100 + i, f"http://bad.com/c{i % 3}/{i}") for i in range(40)] + [(200, "http://x.org/né1/w3"), (201, None)]
    df = spark.createDataFrame(urls, "page_id long, url string").repartition(3)
    aside = {r["page_id"] for r in url_filter.with_rules(df, "url", rules).filter("pmod(xxhash64(host, path), 5) = 0").collect()}
    got = {r["page_id"]: r for r in url_filter.judge_urls(df, rules=rules).collect()}
    counts = {"allow": {}, "block": {}}
    for i, r in got.items():
        if r["rule"] and i not in aside:
            s = b" " * 5 + (r["host"] + r["path"]).encode() + b" "
            for at in range(5, len(s)):
                for k in range(6):
                    for gram in (("c", s[at - k : at]), ("p", s[at - k : at + 1])):
                        counts[r["verdict"]][gram] = counts[r["verdict"]].get(gram, 0) + 1

    def likelihood(s, n):
        total = 0
        for at in range(5, len(s)):
            p = 1 / 256
            for k in range(6):
                p = (n.get(("p", s[at - k : at + 1]), 0) + (1 + k) * p) / (n.get(("c", s[at - k : at]), 0) + 1 + k)
            total += math.log(p)
        return total / (len(s) - 5)

    for r in got.values():
        s = b" " * 5 + (r["host"] + r["path"]).encode() + b" "
        assert math.isclose(r["difference"], likelihood(s, counts["allow"]) - likelihood(s, counts["block"]), abs_tol=1e-9)
