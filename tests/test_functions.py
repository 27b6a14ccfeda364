"""URL, text and hash functions against known values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import hashing, text, urls
from larkspur.operators import crawl
from larkspur.plans import query

URLS = {
    "HTTPS://SITE.EXAMPLE": "https://site.example/",
    "https://site.example:443/": "https://site.example/",
    "https://site.example/#section": "https://site.example/",
    "https://site.example/a/b/../c/./d": "https://site.example/a/c/d",
    "https://site.example/?utm_source=x&b=2&a=1": "https://site.example/?a=1&b=2",
    "https://site.example/?utm_medium=y": "https://site.example/",
    " http://user:pw@site.example:8080/x?#f\n": "http://site.example:8080/x",
    "mailto:a@site.example": None,
    "javascript:void(0)": None,
    "tel:123": None,
    "/relative": None,
    "": None,
    "   ": None,
}
TOKENS = {
    "The Swift Programming Language": "swift programming language",
    "NavigationStack": "navigationstack navigation stack",
    "検索エンジン": "検索 索エ エン ンジ ジン",
    "Swiftで検索": "swift で検 検索",
    "ＳＷＩＦＴ　６": "swift 6",
    "snake_case it's": "snake case s",
    "HTTPServer2": "httpserver2 http server",
    "ｶﾞﾗｽ・窓": "ガラ ラス 窓",
    "": "",
}


def one(spark, value, f, kind="string"):
    return [r.y for r in spark.createDataFrame([(v,) for v in value], f"x {kind}").select(f(F.col("x")).alias("y")).collect()]


def test_normalize_url(spark):
    assert one(spark, [*URLS, None], urls.normalize_url) == [*URLS.values(), None]


def test_normalize_url_twice_is_once(spark):
    once = [u for u in one(spark, ["http://a.example/x/..//y/./z?b=%20&a", "https://b.example/%7e?&&", "http://c.example/a/../../.."], urls.normalize_url)]
    assert one(spark, once, urls.normalize_url) == once


def test_url_predicates(spark):
    assert one(spark, ["https://a.example/image.PNG", "https://a.example/page.html", "https://a.example/blog/"], urls.is_non_html) == [True, False, False]
    deep = "https://a.example/" + "/".join(f"s{i}" for i in range(21))
    many = "https://a.example/?" + "&".join(f"k{i}=1" for i in range(11))
    assert one(spark, ["https://a.example/x/y/x/y/x/y/x/y", "https://a.example/blog/2026/10/post", deep, many], urls.looks_like_trap) == [True, False, True, True]
    hosts = ["example.com", "blog.example.com", "notexample.com"]
    assert one(spark, hosts, lambda c: urls.host_within(c, "example.com")) == [True, True, False]
    assert one(spark, ["https://www.site.example/blog/a-b_c.html"], urls.url_text) == ["www site example blog a b c html"]
    assert one(spark, ["https://a.example/", "https://a.example/x//y/"], urls.path_depth) == [0, 2]
    spelled = ["A.Example.", "a.example:443", "A.EXAMPLE:80", " a.example ", None]
    assert one(spark, spelled, urls.host_key) == ["a.example"] * 4 + [None]


def test_scope(spark):
    rows = spark.createDataFrame([("https://a.example/x", 1), ("https://a.example/x", 99), ("https://b.example/", 0), ("https://sub.a.example/", 0), (None, 0)], "u string, d int")
    got = rows.select(crawl.in_scope(F.col("u"), F.col("d"), allow=["a.example"]).alias("y"), crawl.in_scope(F.col("u"), F.col("d"), allow=["a.example"], block=["sub.a.example"]).alias("z")).collect()
    assert [r.y for r in got] == [True, False, False, True, False]
    assert [r.z for r in got] == [True, False, False, False, False]


def test_tokenize(spark):
    got = one(spark, [*TOKENS, None], lambda c: F.array_join(text.tokenize(c), " "))
    assert got == [*TOKENS.values(), None]
    assert [" ".join(query.tokenize(t)) for t in TOKENS] == list(TOKENS.values())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aB1 é検索で・ーＡ_-½ﬁ", max_size=12), min_size=1, max_size=30))
def test_driver_and_column_tokens_agree(spark, texts):
    assert one(spark, texts, text.tokenize) == [query.tokenize(t) for t in texts]


def test_shingles_and_bigrams(spark):
    rows = spark.createDataFrame([(["a", "b", "c", "d"],), (["a"],), ([],)], "t array<string>")
    assert [r.y for r in rows.select(text.shingles(F.col("t")).alias("y")).collect()] == [["a b c", "b c d"], ["a"], []]
    assert one(spark, ["abc", "a", ""], text.bigrams) == [["ab", "bc"], ["a"], [""]]


def test_snippet(spark):
    long = "x" * 300 + " needle " + "y" * 300
    rows = spark.createDataFrame([(long, "d"), ("short needle", "d"), ("none", "fallback"), ("n" * 200, ""), ("", "d"), (None, "d")], "c string, d string")
    got = [r.y for r in rows.select(text.snippet(F.col("c"), F.col("d"), ["needle"]).alias("y")).collect()]
    assert "needle" in got[0] and got[0].startswith("…") and got[0].endswith("…")
    assert got[1:] == ["short needle", "fallback", "n" * 160 + "…", "d", "d"]


def test_hashes(spark):
    values = ["https://a.example/", "https://b.example/", "", None]
    got = one(spark, values, hashing.url_hash)
    assert got == [-1415602849838866880, -4586925053096914924, -4359066618775142608, None]
    assert one(spark, got, hashing.bucket, "long") == [576, 20, 816, None]
    positions = one(spark, values[:1], hashing.bloom_positions(1 << 20))
    assert positions == [[187968, 351755, 515542, 679329, 843116, 1006903, 122114]]


def test_simhash(spark):
    base = [f"word{i}" for i in range(60)]
    rows = spark.createDataFrame([(base,), ([*base[:-1], "other"],), ([f"else{i}" for i in range(60)],), ([],)], "t array<string>")
    a, b, c, empty = [r.y for r in rows.select(hashing.simhash_of("t").alias("y")).collect()]
    apart = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert empty == 0 and apart(a, b) < apart(a, c)
    got = spark.createDataFrame([(a, b)], "a long, b long").select(hashing.hamming(F.col("a"), F.col("b")).alias("y"), hashing.bands(F.col("a")).alias("z")).first()
    assert got.y == apart(a, b) and sum(v << (16 * i) for i, v in enumerate(got.z)) == a & (2**64 - 1)


def test_query_language():
    q = query.parse('Swift "server side" -python site:X lang:ja')
    assert (q.terms, q.phrases, q.excluded, q.site, q.language) == (["swift", "server", "side"], ["server side"], ["python"], "x", "ja")
    assert query.parse("JS tutorial").synonyms == {"js": ["javascript"]}
    assert query.parse("Swift -SwiftUI").excluded == ["swiftui"]
    assert query.parse("Swift -入門書").excluded == ["入門", "門書"]
    assert query.parse('open "quote here').terms == ["open", "quote", "here"] and not query.parse('open "quote here').phrases
    assert query.parse("-a site:b").terms == [] and query.parse("").terms == []
    assert query.Synonyms.parse("a,b;c, d") == [["a", "b"], ["c", "d"]]
    assert query.parse("b a").cache_key != query.parse("a b").cache_key


@pytest.mark.parametrize(("previous", "changed", "days"), [(None, True, 7), (8, True, 4), (4, False, 6), (1, True, 1), (80, False, 90)])
def test_revisit(spark, previous, changed, days):
    row = spark.createDataFrame([(previous * 86400.0 if previous else None,)], "p double").select(crawl.next_interval(F.col("p"), F.lit(changed)).alias("y")).first()
    assert row.y == days * 86400.0
