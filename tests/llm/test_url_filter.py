from qualitylens.llm import url_filter as U


def brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
    tail = rest[k:]
    k = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return host, tail[:k]


def rule_of(host, path):
    fits = [(len(r), r, v) for v, r in U.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else None


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.ORG/ES/x", "https://example.org/es/1?x=/fr/", "http://x.example.org/en/12#a?b", "http://org", "http://org/",
    "http://notorg/", "http://b.COM/de/", "http://com/fr/a?b=c&d=e", "http://e.com/de", "http://\u00c9.org/\u00e9", "a://b://c.org/d", "http://h?x=/org/", "http://net.net/" + "p/" * 3000, "http://e.org\n/es/",
]


def test_rules_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(URLS)] + [(None, "http://a.org/", "y", 2.0)] * 2, "page_id long, url string, host string, label double")
    rows = U.judge(df, trees=2).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        url = URLS[r.page_id] if r.page_id is not None else "http://a.org/"
        host, path = brute(url)
        assert (r.host, r.path) == (host, path)
        want = rule_of(host, path)
        assert r.rule == (want and want[0])
        assert r.verdict == want[1] if want else r.verdict in ("allow", "block")


def test_entropy_and_odd_tables(spark):
    got = spark.createDataFrame([("aabb",), ("",), ("a(.b",)], "t string").select(U.entropy(U.F.col("t")).alias("e")).collect()
    assert [round(r.e, 6) for r in got] == [1.0, 0.0, 2.0]
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(none).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert [r.verdict for r in U.judge(one).collect()] == ["allow"]


def test_trees_agree_with_held_out_rules(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    rows = U.judge(pages, teach=U.F.col("page_id") % 4 != 0).where("rule is not null and page_id % 4 = 0").collect()
    right = [(r.p_block > 0.5) == (r.verdict == "block") for r in rows]
    assert sum(right) >= 0.85 * len(right) > 10
