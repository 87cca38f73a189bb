"""Queries of sources, the node model, pipeline steps, chunkers, sinks and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernspark import schema
from fernspark.functions import scalar
from fernspark.operators import mergetable, models, nodecache, sinks
from fernspark.operators import nodes as N
from fernspark.operators.indexing import IndexingPipeline
from fernspark.plans.registry import query
from fernspark.session import fresh_path
from fernspark.sources import frontier, loaders
from fernspark.streaming import stateful, streams
from fernspark.tables import table

ID = """lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12))"""


def hash_of(path: str, chunk: str) -> str:
    return f"md5(unhex('{scalar.OID_NAMESPACE}') || encode({path}) || encode({chunk}))"


#: The documents as nodes, in SQL: id, path, chunk and the three metadata entries.
NODES = f"""WITH n AS (SELECT doc_id, source AS path, text AS chunk, lang, source, n_chars::VARCHAR AS n_chars, {hash_of("source", "text")} AS h FROM documents),
nodes AS (SELECT *, {ID} AS id FROM n)
"""


def document_nodes(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    """Documents as nodes with lang, source and n_chars as metadata; ``keyed``: with doc_id beside."""
    docs = table(spark, sf_dir, "documents")
    about = F.create_map(F.lit("lang"), F.col("lang"), F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("source"), F.col("source"))
    return N.nodes(docs, path="source", chunk="text", metadata=about, beside=("doc_id",) if keyed else ())


def keyed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with doc_id beside."""
    docs = table(spark, sf_dir, "documents")
    about = F.create_map(F.lit("lang"), F.col("lang"), F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("source"), F.col("source"))
    return docs.select("doc_id", F.col("source").alias("path"), F.col("text").alias("chunk"), about.alias("metadata"))


@query("SELECT text AS chunk, strlen(text)::BIGINT AS original_size FROM documents WHERE text IS NOT NULL")
def parquet_column_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaders.parquet_column(spark, f"{sf_dir}/documents.parquet", "text").select("chunk", "original_size")


@query(f"WITH n AS (SELECT *, {hash_of('url', 'html')} AS h FROM pages) SELECT {ID} AS id, url AS path, strlen(html)::BIGINT AS original_size, 0::BIGINT AS \"offset\" FROM n")
def page_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaders.pages(table(spark, sf_dir, "pages")).select("id", "path", "original_size", "offset")


@query(
    """SELECT props AS chunk, 'events' AS kafka_topic, (user_id % 4)::VARCHAR AS kafka_partition, event_id::VARCHAR AS kafka_offset,
    (epoch_us(ts) // 1000)::VARCHAR AS kafka_timestamp, event_type AS kafka_key FROM events"""
)
def kafka_shaped_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the shape of queue records, as nodes."""
    e = table(spark, sf_dir, "events").select(
        F.lit("events").alias("topic"), (F.col("user_id") % 4).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"), F.col("event_type").alias("key"), F.col("props").alias("value")
    )
    n = loaders.queue_metadata(e)
    return n.select("chunk", *[F.element_at("metadata", F.lit(k)).alias(k) for k in ("kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp", "kafka_key")])


@query("SELECT props AS chunk, event_type AS fluvio_key FROM events")
def record_shaped_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("props").alias("value"))
    return loaders.record_nodes(e).select("chunk", F.element_at("metadata", F.lit("fluvio_key")).alias("fluvio_key"))


@query(
    """WITH RECURSIVE p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) AS origin, url, html FROM pages),
    c AS (SELECT page_id, origin, html, origin || CASE WHEN rest[1] = '/' THEN rest ELSE '/' || rest END AS url FROM (SELECT *, regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '#.*$', '') AS rest FROM p)),
    edges AS (SELECT DISTINCT url, origin || regexp_replace(l, '#.*$', '') AS link FROM (SELECT url, origin, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS l FROM c)
        UNION SELECT a.url, b.url FROM c a JOIN c b ON b.page_id <> 0 AND a.page_id = (b.page_id - 1) // 3 UNION SELECT b.url, a.url FROM c a JOIN c b ON b.page_id <> 0 AND a.page_id = (b.page_id - 1) // 3),
    r AS (SELECT url, 0 AS depth FROM c WHERE page_id % 100 = 0 UNION SELECT e.link, r.depth + 1 FROM r JOIN edges e ON e.url = r.url WHERE r.depth < 16)
    SELECT url, regexp_extract(url, '://([^/?#]*)', 1) AS host, min(depth)::INT AS depth, url IN (SELECT url FROM c) AS known FROM r GROUP BY url"""
)
def page_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that links lead to from every hundredth page, with its depth. Few pages link to each other, so a second capture of each leads to three more, and back."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    parent = F.when(F.col("page_id") != 0, F.floor((F.col("page_id") - 1) / 3))
    captures = p.select("url", "html").unionByName(frontier.linked(p, parent))
    return frontier.depths(captures, p.where("page_id % 100 = 0"))


@query("SELECT page_id, 'remote' AS kind FROM pages UNION ALL SELECT -1 - page_id, 'local' FROM pages")
def url_host_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, and the same path on this machine."""
    p = table(spark, sf_dir, "pages")
    here = p.select((-1 - F.col("page_id")).alias("page_id"), F.regexp_replace("url", "://[^/]+", "://localhost:8080").alias("url"))
    return p.select("page_id", "url").unionByName(here).select("page_id", scalar.host_kind("url").alias("kind"))


@query(NODES + "SELECT doc_id, id, strlen(chunk)::BIGINT AS original_size FROM nodes")
def node_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_nodes(spark, sf_dir).select("doc_id", scalar.node_id("path", "chunk").alias("id"), F.octet_length("chunk").cast("bigint").alias("original_size"))


COMBINED = "'lang: ' || lang || chr(10) || 'n_chars: ' || n_chars || chr(10) || 'source: ' || source || chr(10) || chunk"
FIELDS = "SELECT doc_id, 'Chunk' AS field, chunk AS text FROM nodes UNION ALL SELECT doc_id, 'Metadata: lang', lang FROM nodes UNION ALL SELECT doc_id, 'Metadata: n_chars', n_chars FROM nodes UNION ALL SELECT doc_id, 'Metadata: source', source FROM nodes"


def _embeddable(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return keyed_nodes(spark, sf_dir).select("doc_id", F.explode(scalar.embeddables("chunk", "metadata", mode)).alias("e")).select("doc_id", "e.field", "e.text")


@query(NODES + f"SELECT doc_id, 'Combined' AS field, {COMBINED} AS text FROM nodes")
def node_embeddable_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddable(spark, sf_dir, schema.SINGLE)


@query(NODES + FIELDS)
def node_embeddable_per_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddable(spark, sf_dir, schema.PER_FIELD)


@query(NODES + f"SELECT doc_id, 'Combined' AS field, {COMBINED} AS text FROM nodes UNION ALL {FIELDS}")
def node_embeddable_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddable(spark, sf_dir, schema.BOTH)


@query("SELECT doc_id, (length(text) // 4)::BIGINT AS tokens FROM documents")
def token_estimate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalar.token_estimate("text").alias("tokens"))


# --- pipeline steps ---------------------------------------------------------------------------------------------------


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document nodes; toxic ones carry an error."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    about = F.create_map(F.lit("lang"), F.col("lang"), F.lit("doc_id"), F.col("doc_id").cast("string"))
    return N.nodes(docs, path="source", chunk="text", metadata=about, error=F.when(F.col("toxic") == 1, "toxic"))


def _doc_id() -> Column:
    return F.element_at("metadata", F.lit("doc_id")).cast("bigint").alias("doc_id")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) <> 1")
def filter_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IndexingPipeline(_flagged(spark, sf_dir)).filter_errors().df.select(_doc_id())


@query("SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'toxic' END AS error FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic = 1 OR strlen(d.text) >= 1000")
def filter_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IndexingPipeline(_flagged(spark, sf_dir)).filter("error is not null or original_size >= 1000").df.select(_doc_id(), "error")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'left' ELSE 'right' END AS side FROM documents")
def split_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = IndexingPipeline(_flagged(spark, sf_dir)).split_by(F.element_at("metadata", F.lit("lang")) == "en")
    return left.df.select(_doc_id(), F.lit("left").alias("side")).unionByName(right.df.select(_doc_id(), F.lit("right").alias("side")))


@query("SELECT text AS chunk, source AS path FROM documents UNION ALL SELECT html, url FROM pages")
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = IndexingPipeline(loaders.pages(table(spark, sf_dir, "pages")))
    return IndexingPipeline(document_nodes(spark, sf_dir)).merge(other).df.select("chunk", "path")


@query("SELECT count(*) AS nodes, count(*) FILTER (toxic = 1) AS errors FROM documents LEFT JOIN labels USING (doc_id)")
def pipeline_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an observation counts while rows pass."""
    p, seen = IndexingPipeline(_flagged(spark, sf_dir)).log()
    p.df.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["nodes"], got["errors"])], "nodes bigint, errors bigint")


@query(
    NODES + """, f AS (SELECT id, any_value(l.toxic) AS t FROM nodes LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) <> 1 GROUP BY id)
SELECT (SELECT count(*) FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) <> 1) AS processed, 0::BIGINT AS failed, (SELECT count(*) FROM f) AS stored"""
)
def pipeline_run_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run into a sink that inserts by id."""
    sink = sinks.ParquetSink(fresh_path(spark, "sink"))
    stats = IndexingPipeline(_flagged(spark, sf_dir)).filter_errors().then_store_with(sink).run()
    return spark.createDataFrame([(stats.processed, stats.failed, stats.stored)], "processed bigint, failed bigint, stored bigint")


@query(NODES + "SELECT id, 'PerField' AS embed_mode, substr(chunk, 1, 5) || '!' AS head FROM nodes")
def then_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of DataFrames as a step, and the embed mode."""
    p = IndexingPipeline(document_nodes(spark, sf_dir)).with_embed_mode(schema.PER_FIELD).then(lambda df: df.withColumn("head", F.concat(F.substring("chunk", 1, 5), F.lit("!"))))
    return p.df.select("id", "embed_mode", "head")


@query("SELECT doc_id, length(text)::VARCHAR AS chars FROM documents")
def then_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of pandas batches as a step."""

    def measured(b):
        b = b.copy()
        b["path"] = b["chunk"].str.len().astype(str)
        return b

    df = IndexingPipeline(_flagged(spark, sf_dir).withColumn("error", F.lit(None).cast("string"))).then_in_batch(measured, 100).df
    return df.select(_doc_id(), F.col("path").alias("chars"))


# --- caches and sinks -------------------------------------------------------------------------------------------------


@query(NODES + "SELECT DISTINCT id FROM nodes WHERE id NOT IN (SELECT id FROM nodes WHERE lang = 'fr')")
def filter_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that aren't among the cached French ones, once each."""
    df = document_nodes(spark, sf_dir)
    cached = df.where(F.element_at("metadata", F.lit("lang")) == "fr").select("id").distinct()
    return sinks.absent(df.select("id", "path", "chunk"), cached).select("id")


@query(NODES + "SELECT (SELECT count(DISTINCT id) FROM nodes) AS first_run, 0::BIGINT AS second_run")
def cache_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache lets a node through once, over runs."""
    cache, df = sinks.NodeCache(fresh_path(spark, "cache")), document_nodes(spark, sf_dir)
    counts = [IndexingPipeline(df).filter_cached(cache).df.count() for _ in range(2)]
    return spark.createDataFrame([tuple(counts)], "first_run bigint, second_run bigint")


@query(
    NODES + """, french AS (SELECT DISTINCT id FROM nodes WHERE lang = 'fr')
    SELECT id, 1 AS run FROM french UNION ALL SELECT DISTINCT id, 2 FROM nodes WHERE id NOT IN (SELECT id FROM french)"""
)
def cache_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache in hash buckets lets through in three runs: of French documents, of all, and of all once more."""
    df = document_nodes(spark, sf_dir)
    cache = nodecache.BucketedCache(fresh_path(spark, "buckets"), expected=max(1, df.count()), buckets=16)
    french = F.element_at("metadata", F.lit("lang")) == "fr"
    runs = [IndexingPipeline(d).filter_cached(cache).df.select("id", F.lit(n).alias("run")) for n, d in enumerate((df.where(french), df, df), 1)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2])


@query("WITH t AS (SELECT text, min(doc_id) AS doc_id FROM documents WHERE lang <> 'en' GROUP BY text) SELECT text AS id, doc_id FROM t WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of other languages that the table of English ones lacks."""
    d = table(spark, sf_dir, "documents").select(F.col("text").alias("id"), "doc_id", "lang")
    return sinks.insert_if_absent(d.where("lang = 'en'").select("id", "doc_id"), d.where("lang <> 'en'").select("id", "doc_id"))


@query(
    """SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events WHERE event_type <> 'view' GROUP BY user_id
UNION ALL SELECT user_id, arg_max(event_type, event_id), max(event_id) FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type <> 'view') GROUP BY user_id"""
)
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view of each user, replaced by the last other event where there is one."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    views = sinks.upsert(None, e.where("event_type = 'view'"), "user_id", "event_id")
    return sinks.upsert(views, e.where("event_type <> 'view'"), "user_id", "event_id")


@query(NODES + "SELECT path || ':' || id AS key, chunk AS value_chunk, lang AS value_lang FROM nodes")
def key_value_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a key-value store gets; the JSON is read again."""
    kv = sinks.key_values(document_nodes(spark, sf_dir))
    return kv.select("key", F.get_json_object("value", "$.chunk").alias("value_chunk"), F.get_json_object("value", "$.metadata.lang").alias("value_lang"))


@query(NODES + "SELECT DISTINCT id, lang AS meta_lang, NULL::VARCHAR AS meta_title FROM nodes WHERE doc_id IN (SELECT min(doc_id) FROM nodes GROUP BY id)")
def sink_metadata_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured metadata as columns; a key that lacks is null. Of documents with one id the first has its say."""
    sink = sinks.ParquetSink(fresh_path(spark, "table"), mode="upsert", order=("doc_id",)).with_metadata("lang", "title")
    sink.setup(spark)
    sink.store(document_nodes(spark, sf_dir, keyed=True))
    return sink.read(spark).select("id", "meta_lang", "meta_title")


@query("SELECT vec_id::VARCHAR AS id, 'Combined' AS names, 64 AS size FROM embeddings")
def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for a vector store: configured vectors alone."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.lit("p").alias("path"), F.lit("c").alias("chunk"), F.create_map().cast("map<string,string>").alias("metadata"),
        F.create_map(F.lit("Combined"), F.col("embedding"), F.lit("Chunk"), F.col("embedding")).alias("vectors"),
    )
    p = sinks.points(e, ("Combined",))
    return p.select("id", F.array_join(F.map_keys("vectors"), ",").alias("names"), F.size(F.element_at("vectors", F.lit("Combined"))).alias("size"))


# --- chunkers and transformers ----------------------------------------------------------------------------------------


@query("SELECT doc_id, line AS chunk FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_replace(line, '\\s+', '', 'g') <> ''")
def chunk_fixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _flagged(spark, sf_dir).withColumn("error", F.lit(None).cast("string"))
    return N.chunk_lines(df).select(_doc_id(), "chunk")


def _bounds(spark: SparkSession, sf_dir: str, stage: N.Stage, most: int) -> DataFrame:
    """Per document: chunks out of bounds, untrimmed ones, and characters that aren't white space."""
    df = stage(_flagged(spark, sf_dir).withColumn("error", F.lit(None).cast("string")))
    bare = F.regexp_replace("chunk", r"(?U)\s+", "")
    per = df.groupBy(_doc_id()).agg(
        F.count_if(F.char_length("chunk") > most).alias("too_long"), F.count_if(F.col("chunk") != scalar.trimmed("chunk")).alias("untrimmed"), F.sum(F.char_length(bare)).alias("solid_chars")
    )
    return per


_BOUNDS = "SELECT doc_id, 0::BIGINT AS too_long, 0::BIGINT AS untrimmed, length(regexp_replace(text, '\\s+', '', 'g'))::BIGINT AS solid_chars FROM documents WHERE regexp_replace(text, '\\s+', '', 'g') <> ''"


@query(_BOUNDS)
def chunk_text_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds(spark, sf_dir, N.chunk_text(200), 200)


@query(_BOUNDS)
def chunk_markdown_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds(spark, sf_dir, N.chunk_markdown(300), 300)


@query()
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.chunk_text(span=(50, 400))(document_nodes(spark, sf_dir)).select("id", "path", "chunk", "original_size")


@query()
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.chunk_markdown(span=(50, 400))(document_nodes(spark, sf_dir)).select("id", "path", "chunk", "original_size")


@query()
def chunk_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the comments of a Python class with two methods, in chunks by syntax."""
    said = F.regexp_replace("text", r"(?m)^", "        # ")
    code = F.concat(F.lit("class Document"), F.col("doc_id"), F.lit(":\n    def text(self):\n"), said, F.lit("\n        return "), F.col("n_chars"), F.lit("\n\n    def lang(self):\n        return '"), F.col("lang"), F.lit("'\n"))
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("d"), F.col("doc_id"), F.lit(".py"))).withColumn("code", code)
    return N.chunk_code("python", 1500)(N.nodes(docs, path="path", chunk="code")).select("id", "path", "chunk", "offset")


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.html_to_markdown(loaders.pages(table(spark, sf_dir, "pages"))).select("id", "path", "chunk")


@query("SELECT page_id, false AS has_script, true AS has_text FROM pages")
def html_to_markdown_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    n = N.html_to_markdown(N.nodes(p.withColumn("u", F.col("page_id").cast("string")), path="u", chunk="html"))
    return n.select(F.col("path").cast("bigint").alias("page_id"), F.contains("chunk", F.lit("track(")).alias("has_script"), (F.length("chunk") > 0).alias("has_text"))


@query(NODES + "SELECT id, 2::BIGINT AS fields, 64::BIGINT AS size, 1.0::DOUBLE AS norm FROM nodes")
def embed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of every node by the offline model, with their number, size and length."""
    df = document_nodes(spark, sf_dir).withColumn("embed_mode", F.lit(schema.PER_FIELD)).withColumn("metadata", F.map_filter("metadata", lambda k, _: k == "lang"))
    v = F.element_at("vectors", F.lit(schema.CHUNK))
    return N.embed(models.HashEmbedder(64))(df).select("id", F.size("vectors").cast("bigint").alias("fields"), F.size(v).cast("bigint").alias("size"), F.round(F.sqrt(scalar.dot(v, v)), 4).alias("norm"))


@query(NODES + "SELECT id, true AS ascending FROM nodes")
def sparse_embed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = N.sparse_embed(models.HashSparseEmbedder())(document_nodes(spark, sf_dir))
    i = F.element_at("sparse_vectors", F.lit(schema.COMBINED))["indices"]
    return df.select("id", (i == F.array_sort(F.array_distinct(i))).alias("ascending"))


@query(NODES + "SELECT id, 'T ' || 'Give the' AS title FROM nodes")
def metadata_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata entry from a prompt, by the offline model that echoes."""
    df = N.metadata_from_prompt("Title", models.EchoPrompt(2, "T "))(document_nodes(spark, sf_dir))
    return df.select("id", F.element_at("metadata", F.lit("Title")).alias("title"))


# --- scalar functions -------------------------------------------------------------------------------------------------


@query(
    r"""SELECT p_partkey, lower(regexp_replace(array_to_string(list_slice(list_filter(regexp_split_to_array(regexp_replace(n, '(?s)[(\[{<].*$', ''), '\s+'), lambda w: w <> ''), 1, 3), '_'), '[^\p{L}\p{N}_]', '', 'g')) AS words,
regexp_replace(lower(n), '[^\p{L}\p{N}]', '_', 'g') AS plain FROM (SELECT p_partkey, p_name || ' ' || p_type || ' (' || p_brand || ')' AS n FROM part)"""
)
def normalize_field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.concat("p_name", F.lit(" "), "p_type", F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", scalar.column_name_words(n).alias("words"), scalar.column_name_plain(n).alias("plain"))


@query("SELECT doc_id, substr(text, 1, 20) || ' (' || length(text) || ')' AS shown, replace(text, '''', '''''') AS quoted, regexp_full_match(source, '[A-Za-z_][A-Za-z0-9_$]{0,62}') AS identifier FROM documents")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalar.debug_text("text", 20).alias("shown"), scalar.quoted("text").alias("quoted"), scalar.is_identifier("source").alias("identifier"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || chr(10) ELSE text END AS code FROM documents")
def fenced_code_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Here:\n```python\n"), text, F.lit("\n```\nthat's all"))).otherwise(text)
    return table(spark, sf_dir, "documents").select("doc_id", scalar.fenced_code(said).alias("code"))


@query("""SELECT event_id, '{"a":' || user_id || ',"k":' || (props->>'k') || '}' AS json FROM events""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    mixed = F.concat(F.lit('{ "k" : '), F.get_json_object("props", "$.k"), F.lit(' , "a": '), F.col("user_id").cast("string"), F.lit("}"))
    return e.select("event_id", scalar.canonical_json(mixed).alias("json"))


# --- streams ----------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events, deduplicated by key and stored per micro-batch."""
    path = fresh_path(spark, "stream")
    kind = table(spark, sf_dir, "events").schema
    s = streams.files(spark, sf_dir, kind, glob="events.parquet").select("user_id", "event_type").withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    # A repeated micro-batch overwrites its own folder.
    streams.drained(streams.stored(streams.deduplicated(s, "key"), lambda df, n: df.select("user_id", "event_type").write.mode("overwrite").parquet(f"{path}/batch={n}"), f"{path}-state"))
    return spark.read.parquet(path).select("user_id", "event_type")


@query(
    """WITH RECURSIVE k AS (
        SELECT user_id, min(ts) AS ts FROM events WHERE ts IS NOT NULL GROUP BY user_id
        UNION ALL
        SELECT e.user_id, min(e.ts) FROM k JOIN events e ON e.user_id IS NOT DISTINCT FROM k.user_id AND e.ts > k.ts + INTERVAL 7 DAY GROUP BY e.user_id
    ) SELECT user_id, ts FROM k"""
)
def stream_expiring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events, of which a user's is let through once more than seven days after the last one let through."""
    path = fresh_path(spark, "expiring")
    s = streams.files(spark, sf_dir, table(spark, sf_dir, "events").schema, glob="events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    kept = stateful.once_within(s, "user_id", "ts", 7 * 86400)
    streams.drained(streams.stored(kept, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"), f"{path}-state"))
    return spark.read.parquet(path).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(
    """SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, max(turn) AS seq, sum(strlen(text))::BIGINT AS completion_tokens,
    string_agg(role || ':' || turn, ',' ORDER BY turn) FILTER (turn % 2 = 1) AS args FROM conversations GROUP BY conv_id"""
)
def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns taken as parts of a message that come in two micro-batches in no order, and its state once it is closed; odd turns bring parts of one tool call."""
    path, w = fresh_path(spark, "parts"), Window.partitionBy("conv_id")
    odd, n = F.col("turn") % 2 == 1, F.octet_length("text").cast("bigint")
    none = F.lit(None)
    parts = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("seq"), F.col("text").alias("delta"), F.when(odd, 0).alias("index"), none.cast("string").alias("id"), none.cast("string").alias("name"),
        F.when(odd, F.concat(F.when(F.col("turn") > 1, ",").otherwise(""), "role", F.lit(":"), F.col("turn").cast("string"))).alias("args"),
        none.cast("bigint").alias("prompt_tokens"), n.alias("completion_tokens"), none.cast("bigint").alias("total_tokens"), (F.col("turn") == F.max("turn").over(w)).alias("last"),
        F.timestamp_seconds(F.col("turn") + 1).alias("time"), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(2)).alias("file"),
    )
    written = f"{path}/in"
    parts.repartition(2, "file").drop("file").write.parquet(written)
    s = streams.files(spark, written, spark.read.parquet(written).schema, files_per_batch=1)
    out = stateful.messages(s, wait=86400.0, late="1 day")
    streams.drained(streams.stored(out, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n}"), f"{path}/state"))
    closed = spark.read.parquet(f"{path}/out").where("status = 'closed'")
    return closed.select("conv_id", "text", "seq", "completion_tokens", F.col("tool_calls")[0]["args"].alias("args"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day by a windowed stream with a watermark, the last state of each window kept."""
    path = fresh_path(spark, "windows")
    kind = table(spark, sf_dir, "events").schema
    s = streams.files(spark, sf_dir, kind, glob="events.parquet").withColumn("time", F.col("ts").cast("timestamp"))
    counted = streams.windowed_counts(s, "time", "1 day", by=("event_type",))
    w = counted.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    streams.drained(w.start())
    return spark.read.parquet(path).select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 26 = 5 THEN 10 ELSE greatest(doc_id % 10, CASE WHEN doc_id % 11 < 10 THEN doc_id % 11 ELSE 0 END) END::INT AS revision, lang FROM documents
    WHERE doc_id % 13 <> 5 OR doc_id % 26 = 5"""
)
def merge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten upserts, of which later ones change earlier rows, a compaction, a removal and another upsert, read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    stored = mergetable.MergeTable(spark, fresh_path(spark, "merge-table"), key="doc_id")
    for i in range(10):
        stored.upsert(docs.where((F.col("doc_id") % 10 == i) | (F.col("doc_id") % 11 == i)).select("doc_id", F.lit(i).alias("revision"), "lang"))
        if i == 5:
            stored.compact()
    stored.remove(docs.where("doc_id % 13 = 5"))
    stored.upsert(docs.where("doc_id % 26 = 5").select("doc_id", F.lit(10).alias("revision"), "lang"))
    return stored.read().select("doc_id", "revision", "lang")
