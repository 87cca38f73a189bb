"""Scalar functions as Column expressions; all stay in the JVM but for the lossy decoder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fernspark import schema

#: The bytes of the UUID namespace for object identifiers, and the four variant digits.
OID_NAMESPACE, VARIANTS = "6ba7b8129dad11d180b400c04fd430c8", "89ab89ab89ab89ab"
#: Words that can't name a column or table.
RESERVED = ("SELECT", "FROM", "WHERE", "INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "TABLE", "INDEX", "ALTER", "ADD", "COLUMN", "AND", "OR", "NOT", "NULL", "TRUE", "FALSE")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def node_id(path: str | Column, chunk: str | Column) -> Column:
    """UUID version 3 in the OID namespace over path and chunk, joined without a separator."""
    h = F.md5(F.concat(F.unhex(F.lit(OID_NAMESPACE)), F.encode(F.coalesce(col(path), F.lit("")), "UTF-8"), F.encode(F.coalesce(col(chunk), F.lit("")), "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-3"), part(14, 3), F.lit("-"), F.translate(part(17, 1), "0123456789abcdef", VARIANTS), part(18, 3), F.lit("-"), part(21, 12))


def sorted_keys(metadata: str | Column) -> Column:
    return F.array_sort(F.map_keys(col(metadata)))


def combined_text(chunk: str | Column, metadata: str | Column) -> Column:
    """``key: value`` lines in the keys' order, a line feed, then the chunk; without metadata the text begins with the line feed."""
    lines = F.transform(sorted_keys(metadata), lambda k: F.concat(k, F.lit(": "), F.coalesce(F.element_at(col(metadata), k), F.lit("null"))))
    return F.concat(F.coalesce(F.array_join(lines, "\n"), F.lit("")), F.lit("\n"), F.coalesce(col(chunk), F.lit("")))


def embeddables(chunk: str | Column, metadata: str | Column, mode: str | Column) -> Column:
    """``array<struct<field,text>>`` of what is embedded: the combined text, the chunk and each metadata value, or both."""
    pair = lambda f, t: F.struct(f.alias("field"), t.alias("text"))
    single = F.array(pair(F.lit(schema.COMBINED), combined_text(chunk, metadata)))
    values = F.transform(F.coalesce(sorted_keys(metadata), F.array().cast("array<string>")), lambda k: pair(F.concat(F.lit("Metadata: "), k), F.element_at(col(metadata), k)))
    fields = F.concat(F.array(pair(F.lit(schema.CHUNK), col(chunk))), values)
    m = F.lit(mode) if isinstance(mode, str) and mode in schema.EMBED_MODES else col(mode)
    return F.when(m == schema.PER_FIELD, fields).when(m == schema.BOTH, F.concat(single, fields)).otherwise(single)


def trimmed(text: str | Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def token_estimate(text: str | Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.char_length(col(text)) / 4).cast("long")


def truncated(text: str | Column, n: int) -> Column:
    """The first ``n`` characters."""
    return F.substring(col(text), 1, n)


def debug_text(text: str | Column, n: int) -> Column:
    """The first ``n`` characters and the number of all in brackets."""
    return F.concat(truncated(text, n), F.lit(" ("), F.char_length(col(text)).cast("string"), F.lit(")"))


def column_name_words(name: str | Column) -> Column:
    """A table column's name: what stands before the first bracket, its first three words joined by ``_``, lower case, letters, digits and ``_`` alone."""
    head = F.regexp_replace(col(name), r"(?s)[(\[{<].*$", "")
    words = F.filter(F.split(head, r"\s+"), lambda w: w != "")
    return F.regexp_replace(F.lower(F.array_join(F.slice(words, 1, 3), "_")), r"[^\p{L}\p{N}_]", "")


def column_name_plain(name: str | Column) -> Column:
    """A column name in lower case with ``_`` for all that isn't a letter or digit."""
    return F.regexp_replace(F.lower(col(name)), r"[^\p{L}\p{N}]", "_")


def is_identifier(name: str | Column) -> Column:
    """Whether a name can stand in SQL unquoted: ASCII letters, digits, ``_`` and ``$``, the first a letter or ``_``, at most 63 long and no reserved word."""
    return F.coalesce(col(name).rlike(r"\A[A-Za-z_][A-Za-z0-9_$]{0,62}\z") & ~F.upper(col(name)).isin(*RESERVED), F.lit(False))


def quoted(text: str | Column) -> Column:
    """As an SQL string's inside: single quotes doubled."""
    return F.replace(col(text), F.lit("'"), F.lit("''"))


def fenced_code(text: str | Column) -> Column:
    """The inside of the first fenced block; the text itself without one."""
    found = F.regexp_extract(col(text), r"(?s)```\w*\n(.*?)```", 1)
    return F.when(col(text).rlike(r"(?s)```\w*\n.*?```"), found).otherwise(col(text))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance in double precision."""
    return F.sqrt(_sum(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def sparse_dot(a: str | Column, b: str | Column) -> Column:
    """Dot product of two ``struct<indices,values>`` over common indices."""
    left = F.map_from_arrays(col(a)["indices"], col(a)["values"])
    pairs = F.arrays_zip(col(b)["indices"].alias("i"), col(b)["values"].alias("v"))
    return _sum(F.transform(pairs, lambda p: F.coalesce(F.element_at(left, p["i"]).cast("double"), F.lit(0.0)) * p["v"].cast("double")))


def canonical_json(text: str | Column) -> Column:
    """JSON with sorted keys and no blanks; null where it doesn't parse."""
    return F.to_json(F.try_parse_json(col(text)))


def host_kind(url: str | Column) -> Column:
    """``local`` for hosts that a crawl's cloud proxy can't reach, else ``remote``."""
    host = F.lower(F.coalesce(F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1), F.lit("")))
    local = host.isin("localhost", "::1", "[::1]", "0.0.0.0") | host.endswith(".localhost") | host.endswith(".local")
    return F.when(local | host.rlike(r"^(127|10)\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.|^169\.254\."), "local").otherwise("remote")


@F.pandas_udf(StringType())
def lossy_text(data: pd.Series) -> pd.Series:
    """UTF-8 with a replacement character for each malformed part."""
    return data.map(lambda b: b.decode("utf-8", "replace"), na_action="ignore")
