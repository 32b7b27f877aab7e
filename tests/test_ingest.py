import gzip
import hashlib
import json
import urllib.error
import urllib.parse

from pyspark.sql import functions as F

from lexispark.functions import web
from lexispark.operators import analysis, ingest
from lexispark.sources import readers, sinks
from lexispark.streaming import recrawl


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c"))).collect()[0][0]


def test_urls(spark):
    cases = {" HTTP://User@Host.COM:80 ": "http://user@host.com:80/", "mailto:a@b": None, "https://a/b?q=1#f": "https://a/b?q=1", "//host/x": None, "": None, "ftp://a/": None}
    for u, want in cases.items():
        assert one(spark, u, web.normalize_url) == want, u
    assert one(spark, "http://a/b?q#f", web.strip_query) == "http://a/b"
    allowed = lambda c: web.is_allowed_domain(c, ["Example.com", "", " "])
    assert [one(spark, u, allowed) for u in ("http://example.com/", "http://a.example.com:8/", "http://x@example.com/", "http://notexample.com/", "nothing")] == [True, True, True, False, False]
    assert [one(spark, u, web.looks_like_html) for u in ("http://a/b.PDF", "http://a/b.pdf?x", "http://a/b.html", "http://a/")] == [False, False, True, True]


def test_html(spark):
    page = '<html><head><title> A &amp; B\n</title><style>x</style></head><!-- <p>no</p> --><script>var t="</p>";</script><noscript>n</noscript><p>One&nbsp;two [ 12 ] &#233;<b>x</b></p>'
    assert one(spark, page, web.html_text) == "A & B One two é x"
    assert one(spark, page, web.html_title) == "A & B"
    assert one(spark, "<p>x</p>", web.html_title) is None
    links = '<a href="/a">1</a><a href=\'b?x=1#f\'>2</a><a href=c>3</a><a href="#t">4</a><a href="javascript:x">5</a><a href="mailto:a">6</a><a href="/a">7</a><a href="../d">8</a>'
    got = spark.createDataFrame([(links, "http://h/x/y")], "h string, u string").select(web.extract_links(F.col("h"), F.col("u"))).collect()[0][0]
    assert got == ["http://h/a", "http://h/x/b?x=1", "http://h/x/c", "http://h/a", "http://h/d"]


def test_classify_upsert_touch_insert(spark):
    stored = spark.createDataFrame([("a", "1", 100, 0, "t"), ("b", "2", 10, 0, "t"), ("c", "3", 10, 0, None)], "url string, raw_sha256 string, fetched_at long, checked_at long, title string")
    new = spark.createDataFrame([("a", "9", "x"), ("b", "2", "x"), ("c", "9", None), ("d", "4", "x")], "url string, raw_sha256 string, note string")
    seen = ingest.classify(new, stored, 110, 50)
    assert {r.url: r.outcome for r in seen.collect()} == {"a": "fresh", "b": "unchanged", "c": "changed", "d": "new"}
    up = {r.url: (r.raw_sha256, r.title, r.note) for r in ingest.upsert(stored, new.where("url in ('c', 'd')")).collect()}
    assert up == {"a": ("1", "t", None), "b": ("2", "t", None), "c": ("9", None, None), "d": ("4", None, "x")}
    assert {r.url: r.checked_at for r in ingest.touch(stored, seen.where("outcome = 'unchanged'"), 110).collect()} == {"a": 0, "b": 110, "c": 0}
    assert {r.url: r.raw_sha256 for r in ingest.insert_if_absent(stored, new).collect()} == {"a": "1", "b": "2", "c": "3", "d": "4"}
    assert {r.outcome: r.n for r in ingest.outcomes(seen).collect()} == {"fresh": 1, "unchanged": 1, "changed": 1, "new": 1}


def test_crawl_rounds(spark):
    link = lambda *us: "".join(f'<a href="{u}">x</a>' for u in us)
    pages = {
        "http://h.org/": link("/doc/1", "/doc/2", "http://other.net/doc/9", "/pic.png"), "http://h.org/doc/1": "<title>One</title>" + link("/", "/doc/3"),
        "http://h.org/doc/2": "two", "http://h.org/doc/3": "three" + link("/doc/1", "/list"), "http://h.org/list": link("/doc/4"), "http://h.org/doc/4": "four", "http://other.net/doc/9": "no",
    }
    table = spark.createDataFrame(list(pages.items()), "url string, html string")
    sha = lambda u: hashlib.sha256(pages[u].encode()).hexdigest()
    stored = spark.createDataFrame([("http://h.org/doc/1", sha("http://h.org/doc/1"), 0), ("http://h.org/doc/2", "old", 0), ("http://h.org/doc/3", "old", 990)], "url string, raw_sha256 string, fetched_at long")
    seeds = spark.createDataFrame([("HTTP://h.org",), ("bad",)], "url string")
    got = ingest.crawl(seeds, readers.fetch_from_table(table), stored, ["h.org"], r"/doc/\d+", None, 1000, fresh_seconds=100)
    assert {r.url.rsplit("/", 1)[1]: r.outcome for r in got.collect()} == {"1": "unchanged", "2": "changed", "3": "fresh", "4": "new"}
    assert {r.url[-1]: r.title for r in got.collect()} == {"1": "One", "2": "http://h.org/doc/2", "3": "http://h.org/doc/3", "4": "http://h.org/doc/4"}
    few = ingest.crawl(seeds, readers.fetch_from_table(table), stored, ["h.org"], r"/doc/\d+", None, 1000, max_pages=2)
    assert few.count() == 1
    # Two new documents beside three stored ones, of which one is marked only; then no room at all.
    capped = ingest.crawl(seeds, readers.fetch_from_table(table), stored, ["h.org"], r"/doc/\d+", None, 1000, max_docs=4)
    assert {r.url[-1]: r.outcome for r in capped.collect()} == {"1": "unchanged", "2": "changed"}
    assert ingest.crawl(seeds, readers.fetch_from_table(table), stored, ["h.org"], r"/doc/\d+", None, 1000, max_docs=3).count() == 0
    narrow = ingest.crawl(seeds, readers.fetch_from_table(table), stored, ["h.org"], r"/doc/\d+", r"org/$", 1000)
    assert {r.url[-1] for r in narrow.collect()} == {"1", "2", "3"}


def test_crawl_to_the_end_and_keys_without_query(spark):
    pages = [(f"http://h.org/doc/{i}", f'<a href="/doc/{i + 1}"></a><a href="/gone"></a>') for i in range(12)]
    pages += [("http://h.org/doc/1?a=1", "first"), ("http://h.org/doc/1?a=2", "second"), ("http://h.org/s", '<a href="/doc/1?a=1"></a><a href="/doc/1?a=2"></a>')]
    table = spark.createDataFrame(pages, "url string, html string")
    empty = spark.createDataFrame([], "url string, raw_sha256 string, fetched_at long")
    asked = []

    def fetch(urls):
        asked.extend(r.url for r in urls.collect())
        return readers.fetch_from_table(table)(urls)

    chain = ingest.crawl(spark.createDataFrame([("http://h.org/doc/0",)], "url string"), fetch, empty, ["h.org"], r"/doc/\d+", None, 1000)
    assert chain.count() == 12 and len(asked) == len(set(asked)) == 14
    one = ingest.crawl(spark.createDataFrame([("http://h.org/s",)], "url string"), readers.fetch_from_table(table), empty, ["h.org"], r"/doc/\d+", None, 1000)
    assert [(r.url, r.title, r.parsed_text) for r in one.collect()] == [("http://h.org/doc/1", "http://h.org/doc/1", "second")]


class Answer:
    def __init__(self, body, headers, status=200):
        self.body, self.headers, self.status = body, headers, status

    def read(self):
        return self.body

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def test_fetching():
    def get(body, **headers):
        return readers.http_get("http://x/", opener=lambda request, timeout: Answer(body, {k.replace("_", "-"): v for k, v in headers.items()}))

    assert get(gzip.compress("é".encode()), Content_Encoding="gzip").text == "é"
    assert get(b"plain", Content_Encoding="gzip").text == "plain"
    assert get("é".encode("latin-1"), Content_Type="text/html; charset=ISO-8859-1").text == "é"
    assert get('<meta charset="cp1251">ж'.encode("cp1251")).text.endswith("ж")
    assert get("é".encode(), Content_Type="text/html; charset=no-such").text == "é"
    assert get(b"\xff").text == "\ufffd"
    calls = []

    def not_modified(request, timeout):
        calls.append(request.headers)
        raise urllib.error.HTTPError("http://x/", 304, "", {"ETag": "1"}, None)

    got = readers.http_get("http://x/", opener=not_modified)
    assert (got.status, got.headers, got.text, len(calls)) == (304, {"ETag": "1"}, "", 1) and "User-agent" in calls[0]

    def broken(request, timeout):
        calls.append(1)
        raise urllib.error.HTTPError("http://x/", 500, "", {}, None)

    assert readers.http_get("http://x/", pause=0, opener=broken) is None and len(calls) == 4


def test_text_with_json_by_stem(spark):
    texts = spark.createDataFrame([("d/text/A_cat.txt", "miaow"), ("d/text/Dog.txt", "wuff"), ("d/text/no.md", "x")], "path string, content string")
    raws = spark.createDataFrame([("d/raw/A_cat.json", "{}")], "path string, content string")
    got = {r.title: (r.url, r.parsed_text, r.raw_content) for r in ingest.text_files(texts, raws, 5).collect()}
    assert got == {"A cat": ("https://en.wikipedia.org/wiki/A_cat", "miaow", "{}"), "Dog": ("https://en.wikipedia.org/wiki/Dog", "wuff", "wuff")}


def test_sources(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("u\tt\tx\ty\n\nno tabs\nu2\tt2\t\n")
    assert sorted(map(tuple, readers.tsv(spark, str(tmp_path / "a.tsv")).collect())) == [("u", "t", "x\ty"), ("u2", "t2", "")]
    lines = ['{"source": "pmc", "raw_path": "raw/a.html", "id": "7", "fetched_at": 5}', "", "{broken", '{"raw_path": "raw/b.html", "url": "http://x/b?q=1"}', '{"source": "s", "url": "http://x"}', '{"source": "s", "raw_path": "raw/gone.html", "url": "http://x/g"}']
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    meta = readers.jsonl(spark, str(tmp_path / "m.jsonl"))
    assert meta.count() == 4
    raw = spark.createDataFrame([("raw/a.html", "<p>A</p>"), ("raw/b.html", "<p>B</p>")], "path string, content string")
    texts = spark.createDataFrame([("text/b.txt", " parsed ")], "path string, content string")
    got = {r.raw_path: (r.url, r.source, r.parsed_text, r.fetched_at, r.outcome) for r in ingest.migrate(meta, raw, texts, 9).collect()}
    assert got["raw/a.html"] == ("https://pmc.ncbi.nlm.nih.gov/articles/PMC7/", "pmc", "A", 5, "upserted")
    assert got["raw/b.html"] == ("http://x/b", "unknown", "parsed", 9, "upserted")
    assert got["raw/gone.html"][-1] == "missing" and got[None][-1] == "skipped"
    d = tmp_path / "bio"
    d.mkdir()
    (d / "10_1.json").write_text(json.dumps({"abstract": "text", "title": "T"}))
    (d / "x.json").write_bytes(b'{"doi": "10/2", "abstract": "\xff"}')
    assert {(r.doi, r.title, r.parsed_text) for r in readers.json_files(spark, str(d)).collect()} == {("10/1", "T", "text"), ("10/2", "10/2", "�")}


def test_articles_through_a_fake_network(spark):
    def extract(url):
        title = urllib.parse.parse_qs(urllib.parse.urlsplit(url).query)["titles"][0]
        pages = {"Cat & dog": {"7": {"extract": "Text", "fullurl": "http://w/C"}}, "None": {"-1": {}}, "No url": {"8": {"extract": "x"}}}
        return json.dumps({"query": {"pages": pages[title]}})

    titles = spark.createDataFrame([("Cat & dog",), ("None",), ("No url",)], "title string")
    assert sorted((r.title, r.url, r.text) for r in readers.wikipedia_articles(titles, extract).collect()) == [("Cat & dog", "http://w/C", "Text"), ("No url", "https://en.wikipedia.org/wiki/No_url", "x")]

    def failing(url, timeout):
        raise OSError

    assert readers.http_get("x", pause=0, opener=failing) is None


def test_articles_and_quota(spark):
    rows = spark.createDataFrame([("A b!", "u", "c", "w " * 500), ("a B", "u2", "c", "w " * 500), ("C", "u3", "c", "short")], "title string, url string, category string, text string")
    got = sinks.articles(rows).collect()
    assert len(got) == 1 and got[0].name.lower() == "a_b" and got[0].body.startswith("Title: ") and json.loads(got[0].metadata)["word_count"] == 500
    many = spark.createDataFrame([("s" if i % 3 else "t", f"u{i:02d}") for i in range(30)], "source string, url string")
    assert {r.source: r["count"] for r in ingest.within_quota(many, 4).groupBy("source").count().collect()} == {"s": 4, "t": 4}


def test_zipf_orders_ties_by_term(spark):
    counts = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("abcd", 1), ("abce", 1), ("zz", 1)], "term string, freq long")
    got = [(r["rank"], r.term, r.zipf) for r in analysis.zipf(counts).orderBy("rank").collect()]
    assert got == [(1, "c", 9.0), (2, "a", 4.5), (3, "b", 3.0), (4, "abcd", 9 / 4), (5, "abce", 9 / 5), (6, "zz", 1.5)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "Cats sat"), (2, None)], "doc_id long, text string").write.parquet(str(src))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(src))
    q = recrawl.stem_stream(stream).writeStream.format("memory").queryName("stemmed").start()
    q.processAllAvailable()
    q.stop()
    assert {r.doc_id: r.terms for r in spark.table("stemmed").collect()} == {1: ["cat", "sat"], 2: []}
    state = {"df": spark.createDataFrame([("a", "x", "1", "x", 5, 5)], "url string, raw_content string, raw_sha256 string, parsed_text string, fetched_at long, checked_at long")}
    merge = recrawl.merge_batch(lambda: state["df"], lambda df: state.update(df=spark.createDataFrame(df.collect(), df.schema)), lambda: 50)
    merge(spark.createDataFrame([("a", "x", "1", "x"), ("b", "y", "2", "y")], "url string, raw_content string, raw_sha256 string, parsed_text string"), 0)
    assert sorted((r.url, r.fetched_at, r.checked_at) for r in state["df"].collect()) == [("a", 5, 50), ("b", 50, 50)]
