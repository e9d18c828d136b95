import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.functions import hashing, html, scoring, text, urls
from lodestack.plans.patterns import checked, prefix_of

# Terms of texts, and references as they are resolved, that the tokenizer and the crawler must give.
GOLDEN = {
    "": [],
    "!!!@@@###": [],
    "One": ["one"],
    "Hello World": ["hello", "world"],
    "Hello123World456": ["hello", "123", "world", "456"],
    "Hello 123 World 456": ["hello", "123", "world", "456"],
    "café naïve": ["café", "naïve"],
    "helloWorld": ["hello", "helloworld", "world"],
    "HelloWorld": ["hello", "helloworld", "world"],
    "HTMLParser": ["htmlparser"],
}


def test_terms_of_goldens(spark):
    df = spark.createDataFrame([(k,) for k in GOLDEN] + [(None,)], "s string").select("s", text.tokens(F.col("s")).alias("t"))
    got = {r.s: r.t for r in df.collect()}
    assert got == {**GOLDEN, None: []}
    assert {k: text.tokenize(k) for k in GOLDEN} == GOLDEN
    assert text.tokenize(None) == []


def test_both_tokenizers_agree(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(alphabet="aZ 9éЖß漢-_.xQ", max_size=30), min_size=20, max_size=20))
    def check(texts):
        df = spark.createDataFrame([(t,) for t in texts], "s string").select("s", text.tokens(F.col("s")).alias("t"))
        assert all(r.t == text.tokenize(r.s) for r in df.collect())

    check()


def test_spelling_terms_and_names(spark):
    assert text.spelling_terms("  Foo\tbar-BAZ ") == ["foo", "bar-baz"]
    df = spark.createDataFrame([("a-1",), ("ä",), ("a b",), ("",)], "n string")
    assert [r[0] for r in df.select(text.valid_collection(F.col("n"))).collect()] == [True, True, False, True]


# See GOLDEN.
RESOLVED = [
    (None, "http://lambda-the-ultimate.org", "node/user", "http://lambda-the-ultimate.org/node/user"),
    ("http://lambda-the-ultimate.org/", "http://lambda-the-ultimate.org/node/user", "archive/2020/05/04", "http://lambda-the-ultimate.org/archive/2020/05/04"),
    (None, "https://a.example/x/y", "/z?q=1#f", "https://a.example/z?q=1"),
    (None, "https://a.example/x/", "http://b.example/#top", "http://b.example/"),
    ("http://other.example/base/", "https://a.example/x", "y", "https://a.example/base/y"),
    (None, "no url", "y", None),
]


def test_references_are_resolved(spark):
    df = spark.createDataFrame([r[:3] for r in RESOLVED], "base string, page string, ref string")
    got = [r[0] for r in df.select(urls.resolved(F.col("ref"), F.col("page"), F.col("base"))).collect()]
    assert got == [r[3] for r in RESOLVED]
    assert [urls.resolve(ref, page, base) for base, page, ref, _ in RESOLVED] == [r[3] for r in RESOLVED]


def test_hosts(spark):
    df = spark.createDataFrame([("HTTP://u:p@Ex.example:80/a",), ("x",), (None,)], "u string")
    assert [r[0] for r in df.select(urls.host(F.col("u"))).collect()] == ["ex.example", None, None]


@pytest.mark.parametrize("seed,url,ok", [
    ("https://example.org", "https://a.example.org/x", True), ("https://example.org", "https://example.org", True),
    ("https://example.org", "http://example.org", False), ("https://www.example.org", "https://example.org/", False),
    ("https://www.example.org", "https://www.example.org/", True), ("example.org", "http://example.org/", True),
    ("https://example.org", "https://exampleXorg/", False), ("https://example.org", "https://a.b.example.org/", False),
    ("https://www.example.org", "https://a.b.example.org/", False), ("https://example.org", "https://evil/x.example.org", False),
])
def test_allowed_patterns(seed, url, ok):
    import re

    assert bool(re.search(urls.allowed_pattern(seed), url)) is ok


def test_html_fields(spark):
    page = '<html><head><title> A b </title><meta name="description" content="one"><meta content="x" name="k"><meta name="description" content="two"><base href="/r"></head><body><a href="p?q">p</a><a class=z href=\'/s#t\'>s</a></body>'
    rows = [("http://h.example/d/", page), ("file:///d/name.txt", "plain"), ("http://h.example", None)]
    df = spark.createDataFrame(rows, "url string, html string")
    got = df.select(html.title(F.col("html"), F.col("url")).alias("t"), html.metadata(F.col("html"), F.col("url")).alias("m"), html.links(F.col("html")).alias("l"), html.base_href(F.col("html")).alias("b")).collect()
    assert got[0].t == "A b" and got[0].l == ["p?q", "/s#t"] and got[0].b == "/r"
    assert got[0].m == {"uri": "http://h.example/d/", "title": "A b", "description": "two", "k": "x"}
    assert got[1].t == "name.txt" and got[2].t is None


def test_html_of_real_pages(spark):
    page = "<HEAD><title>\n A &amp; B &#8211; &#x43;&nope; &lt;i&gt; </title><meta name=key content=bare><meta content='it&apos;s' name=\"q\"></HEAD><title>no</title><a data-href='no'>n</a><a\nhref=x/y?a=1&amp;b=2 class=z>t</a><abbr href='no'>"
    rows = [("http://h", page), ("http://h", "<title>no head</title>"), ("file:///d/f", "<title>no head</title>"), ("http://h", "& alone &; &#0; &#99999999; &amp")]
    df = spark.createDataFrame(rows, "url string, html string")
    got = df.select(html.title(F.col("html"), F.col("url")).alias("t"), html.meta_pairs(F.col("html")).alias("m"), html.links(F.col("html")).alias("l"), html.unescaped(F.col("html")).alias("u")).collect()
    assert got[0].t == "A & B – C&nope; <i>" and got[0].m == {"key": "bare", "q": "it's"} and got[0].l == ["x/y?a=1&b=2"]
    assert got[1].t is None and got[2].t == "f" and got[3].u == rows[3][1]


def test_escapes(spark):
    texts = ["", "a\nb\r\\n", "\\\\", "plain ä", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", text.escaped(F.col("t")))
    rows = df.select("t", "e", text.unescaped(F.col("e")).alias("u")).collect()
    assert [r.u for r in rows] == texts and rows[1].e == "a\\nb\\r\\\\n" and not any(c in (r.e or "") for r in rows for c in "\n\r")
    assert spark.createDataFrame([("a\\x",), ("a\\",)], "e string").select(text.unescaped(F.col("e"))).collect() == [(None,), (None,)]


def test_scores_and_hashes(spark):
    one = spark.range(1)
    idf, sat = one.select(scoring.idf(F.lit(10), F.lit(8)), scoring.saturation(F.lit(2), F.lit(10), F.lit(10))).first()
    assert round(idf, 6) == -1.223775 and round(sat, 6) == round(4.4 / 3.2, 6)
    waits = spark.sql("SELECT timestamp'2024-01-01 00:00:00' n, explode(array(timestamp'2023-12-31 23:59:59', timestamp'2024-01-01 00:00:01', timestamp'2024-01-01 00:00:00')) t")
    assert [r[0] for r in waits.select(scoring.wait_micros(F.col("n"), F.col("t"))).collect()] == [None, 1_000_000, None]
    import xxhash

    got = spark.createDataFrame([(bytearray(b"abc"),), (None,)], "b binary").select(hashing.file_hash("b")).collect()
    want = xxhash.xxh32_intdigest(b"abc", 0xDEADBEEF)
    assert got[0][0] % (1 << 32) == want and got[1][0] is None


def test_patterns():
    assert prefix_of("^abc.*") == "abc" and prefix_of("^abc*") == "ab" and prefix_of("abc") == "" and prefix_of("^a|b") == ""
    assert checked("(?P<n>x)") == "(?<n>x)"
    for bad in ("(?=x)", r"(a)\1", "("):
        with pytest.raises(ValueError):
            checked(bad)


def test_links_of_compressed_pages(spark, tmp_path):
    import base64
    import zlib

    from lodestack import queries

    page = '<a href="/a">x</a> <a href="b">y</a>'
    packed = base64.b64encode(zlib.compress(page.encode())).decode()
    rows = [("http://h/1", page, None), ("http://h/2", packed, " ZLIB"), ("http://h/3", page, "zlib"), ("http://h/4", None, "zlib"), ("http://h/5", packed, "none")]
    spark.createDataFrame(rows, "url string, content string, compression string").write.parquet(str(tmp_path / "input_docs.parquet"))
    got = {r.page: r.n for r in queries.queries()["page_links"](spark, str(tmp_path)).collect()}
    assert got == {"http://h/1": 2, "http://h/2": 2, "http://h/3": 2}
