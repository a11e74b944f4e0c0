"""Golden values of URL, HTML and text functions."""

from pyspark.sql import functions as F

from seekwell.functions import html as H
from seekwell.functions import text as X
from seekwell.functions import url as U

#: url -> secure, host, port, path, query, anchor, full
URLS = {
    "http://google.com/path/to/here?param1=val1&param2=val2#place": (False, "google.com", 80, "/path/to/here", "?param1=val1&param2=val2", "#place", "http://google.com:80/path/to/here?param1=val1&param2=val2#place"),
    "http://google.com/path/to/here?param1=val1&param2=val2": (False, "google.com", 80, "/path/to/here", "?param1=val1&param2=val2", "", "http://google.com:80/path/to/here?param1=val1&param2=val2"),
    "http://google.com/path/to/here#place": (False, "google.com", 80, "/path/to/here", "", "#place", "http://google.com:80/path/to/here#place"),
    "http://google.com?param1=val1&param2=val2#place": (False, "google.com", 80, "", "?param1=val1&param2=val2", "#place", "http://google.com:80?param1=val1&param2=val2#place"),
    "http://google.com#place": (False, "google.com", 80, "", "", "#place", "http://google.com:80#place"),
    "https://cur8able.com/": (True, "cur8able.com", 443, "/", "", "", "https://cur8able.com:443/"),
    "http://h:8080/x": (False, "h", 8080, "/x", "", "", "http://h:8080/x"),
    "http://h:ab/x": (False, "h", 80, "/x", "", "", "http://h:80/x"),
    "ftp://h": None,
    "": None,
    None: None,
}


def test_url_parts_and_normal_form(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "url string").select("url", U.url_parts(F.col("url")).alias("p"), U.normalize(F.col("url")).alias("n")).collect()
    for r in rows:
        want = URLS[r.url]
        assert (tuple(r.p) if r.p else None) == want
        assert r.n == (want[6].removesuffix(want[5]) if want else None)


def test_resolve(spark):
    base = "http://a.org/x/y.html?q=1"
    cases = {"z": "http://a.org/x/z", "/z": "http://a.org/z", "//b.org/z": "http://b.org/z", "http://c/d": "http://c/d", "#t": base + "#t", "": base, "mailto:x@y": None}
    df = spark.createDataFrame([(k,) for k in cases], "link string").select("link", U.resolve(F.lit(base), F.col("link")).alias("to"))
    assert {r.link: r.to for r in df.collect()} == cases


def test_seed_scheme_and_worker(spark):
    df = spark.createDataFrame([("a.org",), ("http://a.org",)], "url string")
    assert [r[0] for r in df.select(U.with_scheme(F.col("url"))).collect()] == ["https://a.org", "http://a.org"]
    assert df.select(U.worker_of(F.lit("http://google.com/x"), 4)).first()[0] in range(4)


def java(text):
    units = text.encode("utf-16-be")
    h = 0
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def test_java_hash_and_shards(spark):
    words = ["search", "spark", "Data", "the", "", "été", "日本", "😀x", "a" * 500]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.java_hash(F.col("w")).alias("h"), X.shard_of(F.col("w"), 12).alias("s"))
    got = {r.w: (r.h, r.s) for r in df.collect()}
    assert got == {w: (java(w), java(w) % 12) for w in words}
    assert [got[w][1] for w in ("search", "spark", "Data", "the")] == [8, 5, 6, 9]


def test_context_window(spark):
    line = "x" * 500
    df = spark.createDataFrame([(0, 10), (10, 500), (120, 500), (480, 500)], "at int, n int")
    got = df.select("at", X.context(F.substring(F.lit(line), F.lit(1), F.col("n")), F.col("at")).alias("c")).collect()
    want = {0: "x" * 10, 10: "x" * 200 + "... ", 120: " ..." + "x" * 200 + "... ", 480: " ..." + "x" * 70}
    assert {r.at: r.c for r in got} == want


def test_tokens_and_variants(spark):
    df = spark.createDataFrame([("Été, don't  x1!",)], "t string")
    spans = df.select(X.token_spans(F.col("t"))).first()[0]
    assert [(s.w, s.at) for s in spans] == [("Été", 0), (",", 3), ("don", 5), ("'", 8), ("t", 9), ("x1", 12), ("!", 14)]
    assert df.select(X.case_variants(F.lit("heLLo"))).first()[0] == ["heLLo", "HeLLo", "hello", "HELLO"]
    assert df.select(X.case_variants(F.lit("A"))).first()[0] == ["A", "a"]


def test_http_date(spark):
    got = spark.range(1).select(X.http_date(F.lit("Wed, 21 Oct 2015 07:28:00 GMT")).cast("string").alias("a"), X.http_date(F.lit("soon")).alias("b")).first()
    assert (got.a, got.b) == ("2015-10-21 07:28:00", None)


PAGE = (
    '<html lang="EN-gb"><head><title> A &amp; B </title><script>var x="</p><p>no";</script></head><body><h2>One</h2><p>First<br><p class="x"> </p><p>Third <b>bold</b></p>'
    '<h1>Two</h1><a class="l" href="/a">link <i>text</i></a><a name="n">none</a></body></html>'
)


def test_html(spark):
    df = spark.createDataFrame([(PAGE,), ("",)], "html string")
    h = F.col("html")
    got = df.select(H.title(h).alias("t"), H.headings(h).alias("h"), H.paragraphs(h).alias("p"), H.summary(h).alias("s"), H.anchors(h).alias("a"), H.page_text(h).alias("x"), H.language(h).alias("l")).collect()
    assert got[0].t == "A & B" and got[0].l == "EN-gb" and got[0].s == "First"
    assert [tuple(x) for x in got[0].h] == [("2", "One"), ("1", "Two")]
    assert got[0].p == ["First", "", "Third bold" ]
    assert [tuple(x) for x in got[0].a] == [("/a", "link text")]
    assert got[0].x.startswith("A & B One First") and "var" not in got[0].x
    assert (got[1].t, got[1].h, got[1].p, got[1].s, got[1].x) == ("", [], [], "", "")


def test_page_lines_udtf():
    parser = H.PageLines()
    parser.feed(PAGE)
    assert parser.lines == [("h2", "One"), ("p", "First"), ("p", ""), ("p", "Third bold"), ("h1", "Two"), ("a", "link text")]
