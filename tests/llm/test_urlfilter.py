import numpy as np
from data import empty, with_clashes

from quillspark.llm import urlfilter

URLS = [
    "http://example.com/en/1", "https://WWW.Example.com/en/x?q#f", "http://a.www.example.com/en/", "http://example.com", "http://x.net/es/1", "http://net/es/", "http://x.net/fr", "http://example.net/de/", "notcom/en",
    "ftp://com/", "http://xcom/", "http://a.com?x=/en/", "://a.com/b://c", "", None, "http://example.com:80/en/", "http://.com/", "http://x.org/\nmore",
]


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = ""
    for c in rest:
        if c in "/?#":
            break
        host += c
    path = rest[len(host) :]
    for stop in "?#":
        path = path.split(stop, 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def judged(spark, urls, rules):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    return [tuple(r)[1:] for r in urlfilter.judge(df, listed).select("page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()]


def test_rules(spark):
    assert judged(spark, URLS, list(urlfilter.RULES)) == [plain(u, urlfilter.RULES) for u in URLS]


def test_without_filter(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_FILTER_BYTES", 0)
    monkeypatch.setattr(urlfilter, "MAX_RULES_BROADCAST", 0)
    assert judged(spark, URLS, list(urlfilter.RULES)) == [plain(u, urlfilter.RULES) for u in URLS]


def test_many_rules_and_no_rules(spark):
    rules = [(f"h{i}.com", f"/p{i % 7}/", "block") for i in range(3000)] + [("h5.com", "", "allow")]
    urls = [f"http://a.h{i}.com/p{i % 7}/x" for i in range(0, 4000, 9)] + ["http://h5.com/zz"]
    assert judged(spark, urls, rules) == [plain(u, rules) for u in urls]
    assert {r[3] for r in judged(spark, URLS, [("none.invalid", "/", "block")])} == {"allow"}
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert urlfilter.judge(df, empty(spark, "host string, path string, verdict string")).first()["verdict"] == "allow"


def test_bloom_has_no_false_negatives_and_few_positives():
    rng = np.random.default_rng(1)
    keys, others = rng.integers(0, 2**64, 5000, dtype=np.uint64), rng.integers(0, 2**64, 50_000, dtype=np.uint64)
    bloom = urlfilter.BlockedBloom(keys)
    assert bloom.might_hold(keys).all() and bloom.might_hold(others).mean() < 0.01 and int(keys[0]) in bloom


def test_clashes_repeats_and_empty(spark):
    rules = spark.createDataFrame(list(urlfilter.RULES), "host string, path string, verdict string")
    df = with_clashes(spark.createDataFrame([(1, URLS[0]), (1, URLS[0]), (None, None)], "page_id long, url string"), "host", "path", "rule", "verdict")
    rows = urlfilter.judge(df, rules).collect()
    assert len(rows) == 3 and sorted(r["verdict"] for r in rows) == ["allow", "block", "block"]
    assert urlfilter.judge(empty(spark, "page_id long, url string"), rules).count() == 0


def test_a_host_of_very_many_labels_is_no_slower(spark):
    import time

    host = ".".join(["a"] * 16_000) + ".example.com"
    urls = [f"http://{host}/en/", "http://example.com/en/"]
    judged(spark, urls[1:], list(urlfilter.RULES))
    began = time.time()
    got = judged(spark, urls, list(urlfilter.RULES))
    assert [g[2:] for g in got] == [("example.com/en/", "block")] * 2 and got[0][0] == host
    assert time.time() - began < 20


def test_a_million_rules(spark):
    from pyspark.sql import functions as F

    rules = spark.range(1_000_000).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("host"), F.concat(F.lit("/p"), F.col("id") % 7, F.lit("/")).alias("path"), F.lit("block").alias("verdict"))
    urls = spark.range(0, 2_000_000, 997).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), "id", F.lit(".com/p"), F.col("id") % 7, F.lit("/x")).alias("url"))
    rows = urlfilter.judge(urls, rules).collect()
    assert all((r["verdict"] == "block") == (r["page_id"] < 1_000_000) for r in rows) and len(rows) == 2_007


def test_slices_make_the_same_filter(spark, monkeypatch):
    from pyspark.sql import functions as F

    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    keys = np.array([r["h"] for r in hashes.collect()], dtype=np.int64).view(np.uint64)
    for limit in (64 << 20, 4096, 0):
        monkeypatch.setattr(urlfilter, "MAX_FILTER_BYTES", limit)
        built, plain_ = urlfilter.built_bloom(hashes, 5000), urlfilter.BlockedBloom(keys)
        assert (built.words == plain_.words).all() and built.might_hold(keys).all()


def test_listed_hosts_are_put_in_the_form_of_urls(spark):
    assert [g[2:] for g in judged(spark, ["http://x.example.org/a", "http://b.net/"], [("https://EXAMPLE.org", "/a", "block"), (".b.net", "/", "block")])] == [("example.org/a", "block"), ("b.net/", "block")]
