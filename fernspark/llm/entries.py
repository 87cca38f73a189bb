"""Queries of the training-data operators over the fixture tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernspark.llm import bpe, filteraudit, langid, lshforest, minhash, packing, secrets, simhash, toolcalls, urlfilter, warc, webp, whitening
from fernspark.llm.common import written
from fernspark.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives."""
    stored = written(warc.archives(warc.with_revisits(table(spark, sf_dir, "pages"), least_bytes=100)))
    return warc.read(stored).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
     f AS (SELECT payload, min(page_id) AS first FROM p WHERE strlen(payload) >= 100 GROUP BY payload)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload)
"""


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and group of near-duplicates."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Fixed values of the contract: host, path and verdict of the listed URLs.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url; a url that no entry fits isn't listed and so is allowed."""
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules, default="allow")


SQL["op3_url_filter"] = f"""
WITH r(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict FROM p LEFT JOIN r
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM m QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
"""


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held = lambda: F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2
    profiles = langid.learn(docs.where(~held() & F.col("lang").isNotNull()))
    return langid.identify(docs, profiles).select("doc_id", held().alias("held_out"), "lang_pred", "score")


@query
def op5_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as a lossless WebP image, read back."""
    stored = written(webp.media(table(spark, sf_dir, "documents")))
    return webp.samples(stored).select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


@query
def op8_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector among all."""
    vectors = table(spark, sf_dir, "embeddings")
    return lshforest.nearest(vectors, vectors.where(F.pmod("vec_id", F.lit(100)) == 0), k=10)


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes that they decode to, as digests."""
    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: The schema of the tool that plain conversations call.
REPLY = {
    "type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
    "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
}


@query
def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a call, linked to the assistant's turn that answers it."""
    calls, results = toolcalls.from_conversations(table(spark, sf_dir, "conversations"))
    return toolcalls.link(calls, results, {"reply": REPLY}, extras=True)


SQL["op9_tool_calls"] = """
WITH c AS (SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS call_id, 'c' || conv_id || '-' || (turn - 2) AS pre, text FROM conversations WHERE role = 'user'),
     r AS (SELECT conv_id, turn, 'c' || conv_id || '-' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant')
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, CASE WHEN c.call_id IS NOT NULL THEN 'reply' END AS name,
       c.turn AS turn, r.turn AS result_turn, CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'pending' ELSE 'linked' END AS status,
       c.turn * 1048576 AS order_key,
       (CASE WHEN c.turn >= 2 AND NOT EXISTS (SELECT 1 FROM c AS b WHERE b.call_id = c.pre) THEN 1 ELSE 0 END)::BIGINT AS missing_after,
       CASE WHEN c.call_id IS NOT NULL THEN c.text <> '' END AS valid,
       CASE WHEN c.call_id IS NOT NULL THEN CASE WHEN c.text <> '' THEN '' ELSE 'arguments.prompt: breaks minLength 1' END END AS errors,
       '{' || CASE WHEN c.call_id IS NOT NULL THEN '"arguments":{"prompt":' || to_json(c.text) || ',"turn":' || c.turn || '},' ELSE '' END
           || '"id":' || to_json(coalesce(c.call_id, r.call_id)) || CASE WHEN c.call_id IS NOT NULL THEN ',"name":"reply"' ELSE '' END
           || CASE WHEN r.text IS NOT NULL THEN ',"result":' || to_json(r.text) ELSE '' END || '}' AS json
FROM c FULL JOIN r ON c.call_id = r.call_id
"""


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 4096 tokens."""
    pieces = packing.cut(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)
    packed = packing.pack(pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32"), capacity=4096)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, by language."""
    return filteraudit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op13_filter_audit"] = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
w AS (SELECT t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words FROM f),
m AS (SELECT t, (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
      + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END)
      + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) AS mask FROM w),
c AS (SELECT part, mask + (CASE WHEN d.doc_id > first THEN 16 ELSE 0 END) AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM d JOIN f USING (t) JOIN m USING (t) LEFT JOIN l ON d.doc_id = l.doc_id GROUP BY ALL),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, list_sum(bits[1:step - 1])::BIGINT AS before FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0) = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's scores of up to 32 components, whitened by the exact covariance of all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    fit = whitening.fit(vectors, components=32)
    if fit is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = fit.transform(vectors).select("vec_id", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    explained = F.lit(fit.explained).cast("array<double>")
    return rows.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, "place").alias("explained"), F.lit(fit.identity_error(vectors)).cast("double").alias("identity_error"),
    )


@query
def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near-duplicates by the similarity of sets of five-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=85)
