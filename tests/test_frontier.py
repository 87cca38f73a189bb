"""Canonical links, and crawls against a breadth-first walk in Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from fernspark.sources import frontier

BASE = "http://a/b/c/d;p?q"
#: The examples of RFC 3986, 5.4, as canonical URLs.
EXAMPLES = {
    "g:h": None, "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g/", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": BASE,
    "g#s": "http://a/b/c/g", "g?y#s": "http://a/b/c/g?y", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "": BASE, ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/",
    "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g",
    "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y",
    "g?y/../x": "http://a/b/c/g?y/../x",
}
ODD = {
    "HTTP://User:pw@EXAMPLE.com:80": "http://example.com/", "https://h:443/x#y": "https://h/x", "https://h:80/": "https://h:80/", "http://h:/": "http://h/", "mailto:x@y": None, "javascript:void(0)": None,
    " /x\n": "http://a/x", "http://": None, "//h?x": "http://h/?x", "http://h/a//b/../c": "http://h/a//c", "http:g": None, None: None,
}


def test_links_as_the_standard_has_them(spark):
    cases = EXAMPLES | ODD
    rows = spark.createDataFrame([(k, BASE) for k in cases], "link string, base string").select("link", frontier.canonical("link", "base").alias("to")).collect()
    assert {r.link: r.to for r in rows} == cases


def test_without_a_base_only_absolute_urls_lead_anywhere(spark):
    rows = spark.createDataFrame([("http://H/x", None), ("/x", None)], "link string, base string")
    assert [r[0] for r in rows.select(frontier.canonical("link", "base")).collect()] == ["http://h/x", None]
    assert [r[0] for r in rows.select(frontier.canonical("link")).collect()] == ["http://h/x", None]


def test_links_of_a_page(spark):
    html = """<A title="x" HREF = '/one'>1</a><a href=two>2</a><a data-href="/no">n</a><area href="/no"><!-- <a href="/no">x</a> --><script>'<a href="/no">'</script>
    <a href="/one">again</a><a\nhref="?a=1&amp;b=2">3</a><a name="x">none</a><a href="mailto:q@r">m</a><a href="#part">p</a><!-- <a href="/no">never closed"""
    pages = spark.createDataFrame([("http://H/d/p#top", html, 1), ("http://h/e", None, 2), (None, html, 3), ("http://h/f", "", 4)], "url string, html string, link int")
    got = sorted(map(tuple, frontier.links(pages).collect()))
    assert got == [("http://h/d/p", f"http://h{x}") for x in ("/d/p", "/d/p?a=1&b=2", "/d/two", "/one")]


def test_links_in_time_that_grows_with_the_text(spark):
    texts = ["<a " * 300_000, "<!--" * 300_000, "<script" * 200_000, '<a href="' * 200_000, "<a " + " x=1" * 300_000, "<script>" * 200_000]
    df = spark.createDataFrame([(f"http://h/{i}", t) for i, t in enumerate(texts)], "url string, html string")
    assert frontier.links(df).count() < 10


def graph(spark, edges):
    """Pages of a graph of numbers, on three hosts, with links in several spellings."""
    at = lambda n: f"http://h{n % 3}.net/{n}"
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(at(b) if b % 2 else at(b).replace("http://h", "HTTP://H") + "#x")
    return at, spark.createDataFrame([(at(a), "".join(f'<a href="{x}">' for x in to), n) for n, (a, to) in enumerate(out.items())], "url string, html string, depth int")


def walked(edges, seeds, most=None):
    depth, last = dict.fromkeys(seeds, 0), set(seeds)
    for d in range(1, 100):
        last = {b for a, b in edges if a in last} - set(depth) if most is None or d <= most else set()
        depth |= dict.fromkeys(last, d)
    return depth


EDGES = [(n, (n * 7 + k * k + 1) % 60) for n in range(60) for k in range(2) if n % 5] + [(3, 100), (4, 4)]


@pytest.mark.parametrize("most", [None, 0, 2])
def test_depths_as_walked(spark, most):
    at, pages = graph(spark, EDGES)
    seeds = spark.createDataFrame([(at(1),), (at(1) + "#again",), (at(2),), (None,), ("ftp://x/",)], "url string")
    got = frontier.depths(pages.union(pages), seeds, most=most, buckets=3).collect()
    assert {r.url: r.depth for r in got} == {at(n): d for n, d in walked(EDGES, [1, 2], most).items()} and len(got) == len({r.url for r in got})
    has = {r.url for r in pages.collect()}
    assert all(r.known == (r.url in has) and r.host == r.url.split("/")[2] for r in got)


def test_depths_of_nothing(spark):
    _, pages = graph(spark, EDGES)
    none = pages.limit(0)
    assert frontier.depths(pages, none, buckets=2).count() == 0
    assert [tuple(r) for r in frontier.depths(none, spark.createDataFrame([("http://x",)], "url string"), buckets=2).collect()] == [("http://x/", "x", 0, False)]


def test_rounds_shuffle_neither_table(spark):
    df = spark.createDataFrame([("a", "b")], "url string, link string")
    edges, seen = frontier._Bucketed(df, 3, "plan_links"), frontier._Bucketed(df.select("url", F.lit(0).alias("depth")), 3, "plan_seen")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for t in (edges, seen):
            plan = df.repartition(5).join(t.read(), "url", "left_anti")._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1  # what is looked up goes to the buckets
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        edges.delete(), seen.delete()


def test_batches_bound_each_host_and_lose_nothing(spark):
    urls = spark.range(2000).select(F.concat(F.lit("http://"), F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("h"), (F.col("id") % 50).cast("string"))), F.lit("/"), F.col("id").cast("string")).alias("url"))
    got = frontier.batches(urls, 90).collect()
    assert len({r.url for r in got}) == len(got) == 2000
    sizes = Counter((r.host, r.batch) for r in got)
    assert max(sizes.values()) == 90 and max(b for _, b in sizes) == (1400 - 1) // 90
    with pytest.raises(ValueError):
        frontier.batches(urls, 0)


def test_crawl_fetches_each_page_once_in_batches(spark):
    at, pages = graph(spark, EDGES)
    pages = pages.select("url", "html").checkpoint() if spark.sparkContext.getCheckpointDir() else pages.select("url", "html").persist()
    asked = []

    def fetch(df):
        asked.append(sorted(map(tuple, df.collect())))
        return df.join(pages, "url").select("url", "html")

    got = frontier.crawl(spark.createDataFrame([(at(1),), (at(2),)], "url string"), fetch, per_host=2, only=F.col("host") != "h2.net", buckets=2).collect()
    inside = [(a, b) for a, b in EDGES if b % 3 != 2]
    has = {a for a, _ in EDGES}
    want = walked(inside, [1])  # the other seed's host isn't allowed
    assert {r.url: r.depth for r in got} == {at(n): d for n, d in want.items() if n in has} and len(got) == len({r.url for r in got})
    every = [u for batch in asked for u, _ in batch]
    assert len(every) == len(set(every)) == len(want)
    assert max(n for batch in asked for n in Counter(h for _, h in batch).values()) <= 2


def test_crawl_of_nothing(spark):
    assert frontier.crawl(spark.createDataFrame([], "url string"), lambda df: df, buckets=2).count() == 0


def test_crawl_over_http(spark):
    import http.server
    import threading

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            text = {"/": '<a href="/x">x</a><a href="gone">g</a>', "/x": '<a href="/">back</a><a href="http://elsewhere.invalid/">e</a>'}.get(self.path)
            self.send_response(200 if text else 404)
            self.end_headers()
            self.wfile.write((text or "").encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        host = f"127.0.0.1:{server.server_address[1]}"
        got = frontier.crawl(spark.createDataFrame([(f"http://{host}",)], "url string"), frontier.over_http(5), only=F.col("host") == host, buckets=2).collect()
        assert sorted((r.url.removeprefix(f"http://{host}"), r.depth, r.html is None) for r in got) == [("/", 0, False), ("/gone", 1, True), ("/x", 1, False)]
    finally:
        server.shutdown()
