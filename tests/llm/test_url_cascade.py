from pyspark.sql import functions as F

from panelforge.llm import url_cascade

from .helpers import duck, same

URLS = [None, "", "no scheme", "http://", "https://Example.COM/en/x", "https://www.example.com/en/", "http://a.b.net/es/1?q#f", "http://net/fr/", "http://notnet/fr/", "x://m.site.org?x=/y", "x://M.site.org/a://b/c", "http://site.com/#", "http://h.org/" + "p" * 100000, "http://line\nfeed.org/a\nb?c"]


def table(spark, urls):
    """Titles are stuffed where the host begins with m."""
    title = lambda u: " | ".join("abcde") if u and "://m." in u.lower() else None if u and "line" in u else "a | b"
    page = lambda t: None if t is None else f"<html><title>{t}</title><p>a | b | c | d | e</p></html>"
    return spark.createDataFrame([(i, u, page(title(u)), "h", "p", "r", "k") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, path string, rule string, key string")


def judged(df, **options):
    return url_cascade.judge(df, listed=url_cascade.stuffed_hosts(df), **options)


def test_matches_sql(spark):
    df = table(spark, URLS + URLS + [f"http://m.h{i % 300}.org/" for i in range(900)] + [f"http://h{i}.org/p" for i in range(900)])
    same(judged(df), duck(url_cascade.SQL, pages=df))


def test_a_list_as_a_table(spark):
    df = table(spark, URLS + [f"http://h{i}.org/p" for i in range(500)] + ["http://h7.org/x"] * 3)
    keys = [(f"h{i}.org", 1) for i in range(0, 500, 7)] + [("h7.org", 2), (None, 3), ("not.there", 4), ("m.site.org", 5)]
    got = url_cascade.judge(df, listed=spark.createDataFrame(keys, "domain string, rank int")).collect()
    names = {k for k, _ in keys if k}
    assert len(got) == df.count() and all(r.listed == (r.host in names) for r in got)
    assert all(r.verdict == ("block" if r.listed else "allow") for r in got if r.rule is None)


def test_a_host_is_listed_for_its_titles(spark):
    pages = [("http://a.org/", "x | y | z | u"), ("http://a.org/2", "fine"), ("http://b.org/", "x|y|z|u"), ("http://c.org/", "x | y | z"), ("http://c.org/2", None)]
    pages += [("http://d.org/", "x | y | z | u")] + [("http://d.org/", "fine")] * 49 + [("http://e.org/", "x | y | z | u")] + [("http://e.org/", "fine")] * 50
    df = spark.createDataFrame([(u, None if t is None else f"<title>{t}</title>") for u, t in pages], "url string, html string")
    assert sorted(r.host for r in url_cascade.stuffed_hosts(df).collect()) == ["a.org", "d.org"]


def test_of_equally_long_rules_the_last_wins(spark):
    rules = (("a.org", "/x", "allow"), ("org", "/x/y", "block"), ("a.org", "/x", "block"))
    assert [(r.rule, r.verdict) for r in url_cascade.judge(table(spark, ["http://a.org/x/y"]), rules).collect()] == [("a.org/x", "block")]


def test_cascade_is_exact_even_with_few_bits(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = F.xxhash64("key") % 7 == 0
    found = url_cascade.cascade(keys, listed, bits_per_key=2.0, hashes=1)
    assert len(found.levels) > 2
    assert keys.where(found.contains(F.col("key")) != listed).count() == 0


def test_joins_where_filters_would_be_too_large(spark):
    df = table(spark, URLS + [f"http://m.h{i % 30}.org/" for i in range(90)])
    assert sorted(map(str, judged(df, max_bits=8).collect())) == sorted(map(str, judged(df).collect()))


def test_no_listed_key_and_empty(spark):
    assert judged(table(spark, ["http://a.org/"])).first().verdict == "allow"
    assert url_cascade.judge(table(spark, ['http://m.a.org/'])).first().verdict == 'allow'
    assert judged(table(spark, [])).count() == 0
