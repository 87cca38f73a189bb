"""Loaders: tables, files, pages, queues as DataFrames of nodes."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from fernspark import schema
from fernspark.functions import scalar
from fernspark.operators.nodes import nodes
from fernspark.sources.permits import Ledger, Permits


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schema.NODE)


def from_rows(spark: SparkSession, rows: Iterable[tuple[str, str] | Exception]) -> DataFrame:
    """Nodes of (path, chunk) pairs; an exception is a row with an error."""
    flat = [(None, None, str(r)) if isinstance(r, Exception) else (r[0], r[1], None) for r in rows]
    df = spark.createDataFrame(flat, "path string, chunk string, err string")
    return nodes(df, path="path", chunk="chunk", error=F.col("err"))


def from_error(spark: SparkSession, message: str) -> DataFrame:
    return from_rows(spark, [ValueError(message)])


def parquet_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One string column of a Parquet table; nulls are skipped and only this column is read. Another type, or no such column, is an error."""
    df = spark.read.parquet(path)
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    if df.schema[column].dataType.typeName() != "string":
        return from_error(spark, f"{column} isn't a string column")
    return nodes(df.select(F.col(column).alias("chunk")).where("chunk is not null"), path=F.lit(""), chunk="chunk")


class IgnoreRules:
    """The rules of ignore files from a root down: the last rule that fits decides, ``!`` takes back, a trailing slash is for folders."""

    def __init__(self, rules: tuple[tuple[str, str], ...] = ()):
        self.rules = rules  # folder relative to the root, pattern

    def with_file(self, folder: str, text: str) -> IgnoreRules:
        new = [(folder, x.rstrip()) for x in text.splitlines() if x.strip() and not x.startswith("#")]
        return IgnoreRules((*self.rules, *new))

    def ignores(self, path: str, is_folder: bool) -> bool:
        out = False
        for folder, rule in self.rules:
            pattern, keep = (rule[1:], True) if rule.startswith("!") else (rule, False)
            if pattern.endswith("/"):
                if not is_folder:
                    continue
                pattern = pattern.rstrip("/")
            inner = os.path.relpath(path, folder) if folder else path
            if inner.startswith(".."):
                continue
            if pattern.startswith("**/"):
                pattern = pattern[3:]
            fits = fnmatch.fnmatchcase(inner, pattern.lstrip("/")) if "/" in pattern.rstrip("/") else fnmatch.fnmatchcase(os.path.basename(inner), pattern)
            if fits:
                out = not keep
        return out


def listed_files(root: str, extensions: tuple[str, ...] | None = None) -> list[str]:
    """Files below ``root`` on the driver, sorted: hidden ones and those that ignore files name are left out; extensions are exact, without a dot."""
    found = []

    def walk(folder: str, rules: IgnoreRules) -> None:
        for name in (".gitignore", ".ignore"):
            p = os.path.join(root, folder, name)
            if os.path.isfile(p):
                with open(p, errors="replace") as f:
                    rules = rules.with_file(folder, f.read())
        for entry in sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name):
            path = os.path.join(folder, entry.name) if folder else entry.name
            folder_like = entry.is_dir(follow_symlinks=False)
            if entry.name.startswith(".") or rules.ignores(path, folder_like):
                continue
            if folder_like:
                walk(path, rules)
            elif entry.is_file() and (extensions is None or os.path.splitext(entry.name)[1][1:] in extensions):
                found.append(os.path.join(root, path))

    if os.path.isfile(root):
        return [root]
    walk("", IgnoreRules())
    return found


def files(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = None, *, ignore_rules: bool | None = None) -> DataFrame:
    """Files as nodes: path, text (malformed UTF-8 replaced), size of the text in bytes.

    With ``ignore_rules`` (by default for local folders) the driver lists them, hidden files and ignore files minded; without, Spark lists and reads
    any store, and hidden names are left out.
    """
    local = root.removeprefix("file://") if root.startswith(("/", "file:///")) else None
    if ignore_rules if ignore_rules is not None else local is not None and os.path.exists(local):
        paths = listed_files(local or root, extensions)
        if not paths:
            return empty(spark)
        raw = spark.read.format("binaryFile").load(["file://" + os.path.abspath(p) for p in paths])
    else:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        if extensions is not None:
            raw = raw.where(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*extensions))
        raw = raw.where(~F.col("path").substr(len(root) + 1, 1 << 20).rlike(r"(^|/)\."))
    text = raw.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), scalar.lossy_text("content").alias("chunk"))
    return nodes(text, path="path", chunk="chunk")


def pages(df: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Crawled pages as nodes: path is the url, chunk the HTML."""
    return nodes(df, path=url, chunk=html)


def queue_metadata(df: DataFrame, prefix: str = "kafka") -> DataFrame:
    """Queue records (``topic, partition, offset, timestamp, key, value``) as nodes: values that are valid UTF-8, all metadata as strings, the time in milliseconds."""
    text = F.try_validate_utf8(F.col("value").cast("string")) if df.schema["value"].dataType.typeName() == "string" else F.when(F.is_valid_utf8(F.col("value").cast("string")), F.col("value").cast("string"))
    pairs = {
        f"{prefix}_topic": F.col("topic"), f"{prefix}_partition": F.col("partition").cast("string"), f"{prefix}_offset": F.col("offset").cast("string"),
        f"{prefix}_timestamp": F.unix_millis(F.col("timestamp").cast("timestamp")).cast("string"), f"{prefix}_key": F.col("key").cast("string"),
    }
    about = F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    rows = df.withColumn("_text", text).withColumn("_about", about).where("_text is not null")
    return nodes(rows, path=F.lit(""), chunk="_text", metadata=F.col("_about"))


def kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """An endless stream of a topic's records as nodes; needs Spark's Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    for k, v in options.items():
        raw = raw.option(k, v)
    return queue_metadata(raw.load())


class RecordLog(DataSource):
    """A stream of records from any client with offsets: ``client`` names ``module:function``, which returns an object with
    ``end() -> int`` and ``read(start, stop) -> iterable of (key, value)``.

    With ``rows_per_second`` (and perhaps ``burst``) a micro-batch takes no more rows than a bucket of permits has. The bucket is kept in the file ``ledger``, one for each
    checkpoint, which the driver writes before it gives out an offset; so a restart neither fills the bucket nor goes back. A ledger for a checkpoint that had no rate starts
    where the option ``start`` says.
    """

    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self) -> str:
        return "key string, value string, offset bigint"

    def streamReader(self, schema: Any) -> DataSourceStreamReader:  # noqa: N802
        return _RecordReader(self.options)


class _Span(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__(None)
        self.start, self.stop = start, stop


class _RecordReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        if "rows_per_second" in self.options and "ledger" not in self.options:
            raise ValueError("a rate needs a ledger")

    def _named(self, option: str) -> Any:
        import importlib

        module, _, function = self.options[option].partition(":")
        return getattr(importlib.import_module(module), function)

    def _client(self) -> Any:
        return self._named("client")(self.options)

    def _clock(self) -> float:
        """Seconds; ``clock`` names another function of the options, for tests."""
        import time

        return self._named("clock")(self.options) if "clock" in self.options else time.time()

    def initialOffset(self) -> dict:  # noqa: N802
        return {"offset": int(self.options.get("start", 0))}

    def latestOffset(self) -> dict:  # noqa: N802
        """All that is there or, with a rate, what the bucket admits of it."""
        end = self._client().end()
        if "rows_per_second" not in self.options:
            return {"offset": end}
        rate, burst = float(self.options["rows_per_second"]), self.options.get("burst")
        burst, ledger, now = float(burst) if burst is not None else None, Ledger(self.options["ledger"]), self._clock()
        kept = ledger.load()
        permits = Permits.start(rate, burst, self.initialOffset()["offset"], now) if kept is None else kept.with_rate(rate, burst)
        admitted = permits.admit(end, now)
        ledger.save(permits)
        return {"offset": admitted}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["offset"] < start["offset"]:
            raise ValueError(f"the log or its ledger ends at {end['offset']}, before the checkpoint's {start['offset']}")
        size = int(self.options.get("span", 10_000))
        return [_Span(a, min(a + size, end["offset"])) for a in range(start["offset"], end["offset"], size)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        for i, (k, v) in enumerate(self._client().read(partition.start, partition.stop)):
            yield (k, v, partition.start + i)

    def commit(self, end: dict) -> None:
        pass


def records(spark: SparkSession, client: str, *, rows_per_second: float | None = None, burst: float | None = None, ledger: str | None = None, **options: str) -> DataFrame:
    """A :class:`RecordLog` as a stream of ``key, value, offset``, at most so many rows a second if a rate is given. A run over what is there now (``availableNow``) looks once and so takes one bucket at most."""
    spark.dataSource.register(RecordLog)
    given = {"rows_per_second": rows_per_second, "burst": burst, "ledger": ledger}
    r = spark.readStream.format("record_log").option("client", client)
    for k, v in (options | {k: str(v) for k, v in given.items() if v is not None}).items():
        r = r.option(k, v)
    return r.load()


def record_nodes(df: DataFrame, prefix: str = "fluvio") -> DataFrame:
    """Records of ``key, value`` as nodes; the key is metadata, the JSON null where it lacks."""
    return nodes(df, path=F.lit(""), chunk="value", metadata=F.create_map(F.lit(f"{prefix}_key"), F.coalesce("key", F.lit("null"))))


class Crawl(DataSource):
    """Pages of a site, breadth first from ``url`` up to ``limit`` pages, on one host; live HTTP, so one task."""

    @classmethod
    def name(cls) -> str:
        return "crawl"

    def schema(self) -> str:
        return "url string, html string"

    def reader(self, schema: Any) -> DataSourceReader:
        return _CrawlReader(dict(self.options))


class _CrawlReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def read(self, partition: Any) -> Iterator[tuple]:
        import re
        import urllib.parse
        import urllib.request

        first = self.options["url"]
        host, seen, todo = urllib.parse.urlsplit(first).netloc, {first}, [first]
        for _ in range(int(self.options.get("limit", 1000))):
            if not todo:
                return
            url = todo.pop(0)
            try:
                with urllib.request.urlopen(url, timeout=30) as r:
                    html = r.read().decode("utf-8", "replace")
            except OSError:
                continue
            yield (url, html)
            for link in re.findall(r"""href=["']([^"'#]+)""", html):
                to = urllib.parse.urljoin(url, link)
                if urllib.parse.urlsplit(to).netloc == host and to not in seen:
                    seen.add(to)
                    todo.append(to)


def crawl(spark: SparkSession, url: str, limit: int = 1000) -> DataFrame:
    spark.dataSource.register(Crawl)
    return pages(spark.read.format("crawl").option("url", url).option("limit", str(limit)).load())


def list_nodes(df: DataFrame) -> list[dict]:
    """All nodes without an error, on the driver; for small loads."""
    return [r.asDict(recursive=True) for r in df.where("error is null").collect()]


def iterate(df: DataFrame) -> Iterator[dict]:
    """Nodes one after another, a partition at a time on the driver."""
    return (r.asDict(recursive=True) for r in df.toLocalIterator())
