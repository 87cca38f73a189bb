"""Crawls as rounds of a frontier: links of the last round's pages, without those found before, are the next round.

:func:`depths` walks a table of stored pages, whose links are taken once; :func:`crawl` fetches as it goes. Both write every round, so a lost executor repeats at most one.
Which URLs were found lies in a table with buckets by URL, as do a stored table's links: a round shuffles its own links and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernspark.operators import sinks
from fernspark.session import fresh_path

#: Scheme, authority, path and query of a URL or of a reference.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"
#: What holds no links: comments, scripts and styles, up to the end where they aren't closed.
HIDDEN = r"(?is)<!--(?:.*?-->|.*)|<(script|style)\b[^<>]*>(?:.*?</\1\s*>|.*)"
#: The target of a link, with its quotes.
LINK = r"""(?i)<a(?=[\s/])[^<>]*?[\s"'/]href\s*=\s*("[^"]*"|'[^']*'|[^\s<>"']+)"""
#: Pages for which a stored table's walk takes another bucket, and the least number of buckets.
BUCKET_PAGES, LEAST_BUCKETS = 131_072, 8
#: Into how many parts a host's URLs go while they are numbered.
SALTS = 64


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, without its segments ``.`` and ``..``."""
    parts = F.split(path, "/")
    walked = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    folder = F.element_at(parts, -1).isin(".", "..")
    whole = F.concat(F.lit("/"), F.array_join(F.when(folder, F.concat(walked, F.array(F.lit("")))).otherwise(walked), "/"))
    return F.when(path.contains("/."), whole).otherwise(path)


def canonical(link: str | Column, base: str | Column | None = None) -> Column:
    """A link as one spelling of the URL that it leads to from ``base``; null for what isn't http or https or has no host.

    References are resolved as RFC 3986 has it. Scheme and host are in lower case, without user and default port; there is always a path; dots are taken out of it and the fragment is
    cut off. Percent codes stay as they are. Without a base only absolute URLs lead anywhere.
    """
    clean = lambda c: F.trim(F.regexp_replace(c, r"[\t\n\r]", ""))
    u, b = clean(F.col(link) if isinstance(link, str) else link), clean(F.lit("") if base is None else F.col(base) if isinstance(base, str) else base)
    scheme, authority, path, query = (F.regexp_extract(u, PARTS, i) for i in range(1, 5))
    base_scheme, base_authority, base_path, base_query = (F.coalesce(F.regexp_extract(b, PARTS, i), F.lit("")) for i in range(1, 5))
    absolute = scheme != ""
    elsewhere = absolute | u.startswith("//")
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    scheme = F.lower(F.when(absolute, scheme).otherwise(base_scheme))
    host = F.lower(F.regexp_replace(F.when(elsewhere, authority).otherwise(base_authority), "^.*@", ""))
    host = F.when(scheme == "http", F.regexp_replace(host, ":(80)?$", "")).otherwise(F.regexp_replace(host, ":(443)?$", ""))
    query = F.when(~elsewhere & (path == "") & (query == ""), base_query).otherwise(query)
    path = F.when(elsewhere | path.startswith("/"), path).when(path == "", base_path).otherwise(F.concat(folder, path))
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, _without_dots(path), query))


def host_of(url: str | Column) -> Column:
    """The host of a canonical URL, with its port if it has one."""
    return F.regexp_extract(F.col(url) if isinstance(url, str) else url, "://([^/?#]*)", 1)


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``url, link`` of all pages, canonical, each pair once. Pages without a URL or a text have none, nor have links of other schemes. An attribute that holds ``<`` or ``>`` before the target hides a link."""
    text = F.regexp_replace(html, HIDDEN, " ")
    found = pages.select(F.col(url).alias("_base"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(LINK), 1))).alias("_link"))
    target = F.regexp_replace("_link", """^["']|["']$""", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        target = F.replace(target, F.lit(entity), F.lit(sign))
    return found.select(canonical("_base").alias("url"), canonical(target, "_base").alias("link")).where("url is not null and link is not null").distinct()


class _Bucketed:
    """An external table with buckets by ``url``, added to round by round."""

    def __init__(self, df: DataFrame, buckets: int, name: str):
        self.spark, self.buckets = df.sparkSession, buckets
        self.path, self.table, self.schema = fresh_path(self.spark, name), f"fernspark_{name}_{uuid.uuid4().hex}", df.schema
        df.repartition(buckets, "url").write.format("parquet").bucketBy(buckets, "url").option("path", self.path).saveAsTable(self.table)

    def add(self, df: DataFrame) -> None:
        df.select(self.schema.names).repartition(self.buckets, "url").write.insertInto(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def files(self) -> DataFrame:
        """The rows by their files, when the catalog needn't know of the table any more."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        return self.spark.read.schema(self.schema).parquet(self.path)

    def delete(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        sinks.delete(self.spark, self.path)


def _started(seeds: DataFrame, url: str, only: Column | None) -> DataFrame:
    first = seeds.select(canonical(url).alias("url")).where("url is not null").distinct()
    return _allowed(first, only).select("url", F.lit(0).alias("depth"))


def _allowed(urls: DataFrame, only: Column | None) -> DataFrame:
    return urls if only is None else urls.withColumn("host", host_of("url")).where(only).select("url")


def _next(found: DataFrame, seen: _Bucketed, depth: int, only: Column | None) -> DataFrame:
    """The ``url`` of what is new among ``link``, after it was written to what was found. Each file has one depth, so a later round reads of the others their footers only."""
    new = _allowed(found.select(F.col("link").alias("url")).distinct(), only).join(seen.read().select("url"), "url", "left_anti")
    seen.add(new.select("url", F.lit(depth).alias("depth")))
    return seen.read().where(F.col("depth") == depth).select("url")


def depths(pages: DataFrame, seeds: DataFrame, *, url: str = "url", html: str = "html", most: int | None = None, only: Column | None = None, buckets: int | None = None) -> DataFrame:
    """``url, host, depth, known`` of all that links lead to from the seeds' ``url``: how many links away it is at least (seeds: 0), and whether it is one of the pages.

    ``most``: the greatest depth; ``only``: a condition on ``url`` and ``host`` that links must meet to be followed. Several pages of one URL are captures of it, whose links count together.
    There are as many rounds as the greatest depth. ``buckets``: by default they grow with the number of pages. URLs that aren't http, or null, lead nowhere; without seeds there are no rows. Other columns of either table aren't read.
    """
    buckets = buckets or max(LEAST_BUCKETS, -(-pages.count() // BUCKET_PAGES))
    edges = _Bucketed(links(pages, url, html), buckets, "frontier_links")
    seen = _Bucketed(_started(seeds, url, only), buckets, "frontier_seen")
    last, depth = seen.read(), 0
    while (most is None or depth < most) and not last.isEmpty():
        depth += 1
        last = _next(edges.read().join(last.select("url"), "url", "left_semi"), seen, depth, only)
    edges.delete()
    known = pages.select(canonical(url).alias("url")).where("url is not null").distinct().withColumn("_known", F.lit(True))
    return seen.files().join(known, "url", "left").select("url", host_of("url").alias("host"), "depth", F.coalesce("_known", F.lit(False)).alias("known"))


def batches(urls: DataFrame, per_host: int) -> DataFrame:
    """Distinct URLs (``url``) with ``host`` and ``batch`` from 0, none of which has more than ``per_host`` of a host. A host's URLs are numbered in ``SALTS`` parts, so a host that has most of them isn't one task."""
    if per_host < 1:
        raise ValueError("a batch takes at least one URL of a host")
    dealt = urls.withColumn("host", host_of("url")).withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)))
    sizes = dealt.groupBy("host", "_salt").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("host").orderBy("_salt")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("host", "_salt").orderBy("url"))
    numbered = dealt.withColumn("_place", place).join(before, ["host", "_salt"])
    return numbered.select(*urls.columns, "host", F.floor((F.col("_before") + F.col("_place") - 1) / per_host).cast("int").alias("batch"))


def over_http(timeout: float = 30.0) -> Callable[[DataFrame], DataFrame]:
    """Fetches URLs; those of a host one after another in one task. The text is null where a page can't be had."""

    def read(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import urllib.request

        for part in rows:
            for url in part["url"]:  # a page at a time, as a page may be large
                try:
                    with urllib.request.urlopen(url, timeout=timeout) as r:
                        html = r.read().decode("utf-8", "replace")
                except (OSError, ValueError):
                    html = None
                yield pd.DataFrame({"url": [url], "html": [html]}, dtype="object")

    return lambda df: df.repartition("host").mapInPandas(read, "url string, html string")


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], *, url: str = "url", most: int | None = None, per_host: int = 1000, only: Column | None = None, buckets: int = 64) -> DataFrame:
    """``url, host, depth, html`` of all pages from the seeds on, breadth first, each fetched once (again if an executor is lost meanwhile).

    ``fetch`` takes rows of ``url, host`` and returns ``url, html``, such as :func:`over_http`. A depth's URLs go to it in batches of at most ``per_host`` of a host; those of a larger host wait for the
    next batch and none is left out. URLs that ``fetch`` doesn't return have no row. ``only``, ``most`` and null URLs: as in :func:`depths`; a crawl of the open web needs one of the two to end.
    """
    spark = seeds.sparkSession
    kept, fields = fresh_path(spark, "crawled"), "url string, html string"
    seen = _Bucketed(_started(seeds, url, only), buckets, "frontier_seen")
    last, depth = seen.read(), 0
    while not last.isEmpty():
        path = fresh_path(spark, "frontier-batches")
        batches(last.select("url"), per_host).write.parquet(path)
        waiting = spark.read.schema("url string, host string, batch int").parquet(path)
        for n in range(waiting.agg(F.max("batch")).first()[0] + 1):
            fetch(waiting.where(F.col("batch") == n).select("url", "host")).select("url", "html").write.parquet(f"{kept}/depth={depth}/batch={n}")
        if most is not None and depth >= most:
            break
        pages = spark.read.schema(fields).parquet(f"{kept}/depth={depth}/*")
        depth += 1
        last = _next(links(pages), seen, depth, only)
    seen.delete()
    if not sinks.exists(spark, kept):
        return spark.createDataFrame([], "url string, host string, depth int, html string")
    return spark.read.schema(f"{fields}, depth int, batch int").parquet(kept).select("url", host_of("url").alias("host"), "depth", "html")


def linked(pages: DataFrame, parent: Column, *, number: str = "page_id", url: str = "url") -> DataFrame:
    """Captures ``url, html`` of pages that lead to the pages whose ``parent`` is their number, and back; for tables whose pages don't link to each other."""
    at = pages.select(F.col(number).alias("_n"), F.col(url).alias("_url"), parent.alias("_parent"))
    pairs = at.join(at.select(F.col("_n").alias("_parent"), F.col("_url").alias("_above")), "_parent")
    link = lambda c: F.concat(F.lit('<p><a class="next" href="'), F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit('">on</a>'))
    return pairs.select(F.explode(F.array(F.struct(F.col("_above").alias("url"), link("_url").alias("html")), F.struct(F.col("_url").alias("url"), link("_above").alias("html")))).alias("c")).select("c.*")
