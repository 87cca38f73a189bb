"""Tool-call linking with DataFrame functions alone: hash join by identifier, topological order, schema checks, canonical JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernspark.llm.common import discard, written

CALL = "conv_id long, turn long, index int, call_id string, name string, arguments string, after array<string>"
RESULT = "conv_id long, turn long, call_id string, content string"
#: A call's place in its conversation is turn * PLACES + index.
PLACES = 1 << 20
#: Calls and needs of a conversation that is sorted within one row; larger ones are sorted by joins.
MOST_SORTED = 2048
#: Properties of all schemas together; they become one expression.
MOST_CHECKS = 5000

_CALLS_JSON = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"


def from_conversations(messages: DataFrame, *, tool: str = "reply", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns.

    A turn whose text is a JSON object with an array ``tool_calls`` (``id, name, arguments`` as an object or as JSON text, ``after`` ids of
    calls that it needs) makes those calls; one whose role is ``tool``, a JSON object with ``tool_call_id`` and ``content``, is a result.
    In a plain conversation every user turn t is a call of ``tool`` named ``c<conv>-<t>`` with arguments ``prompt`` and ``turn``, after the
    call of turn t - 2 if t is 2 or more; every assistant turn t is the result of ``c<conv>-<t - 1>``. Other turns make nothing. A null conversation,
    turn or text gives null names or prompts, which are reported and never linked.
    """
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    is_json = F.col("text").startswith("{")
    value = F.when(is_json, F.try_parse_json("text"))
    rows = rows.withColumn("v", value)
    listed = F.from_json(F.get_json_object("text", "$.tool_calls"), _CALLS_JSON)
    made = F.when(F.col("v").isNotNull(), listed)
    rows = rows.withColumn("made", made).withColumn("tool_call_id", F.when(F.col("v").isNotNull() & (F.col("role") == "tool"), F.get_json_object("text", "$.tool_call_id")))
    given = rows.where("made is not null").select("conv_id", "turn", F.posexplode("made").alias("index", "c")).select("conv_id", "turn", "index", F.col("c.id").alias("call_id"), "c.name", "c.arguments", F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    label = lambda back: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - back).cast("string"))
    plain = rows.where("made is null and role = 'user'").select(
        "conv_id", "turn", F.lit(0).alias("index"), label(0).alias("call_id"), F.lit(tool).alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(label(2))).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    results = rows.where("tool_call_id is not null").select("conv_id", "turn", F.col("tool_call_id").alias("call_id"), F.get_json_object("text", "$.content").alias("content"))
    replies = rows.where("made is null and role = 'assistant'").select("conv_id", "turn", label(1).alias("call_id"), F.col("text").alias("content"))
    return given.unionByName(plain), results.unionByName(replies)


def violations(schema: dict, value: Column, place: str = "arguments") -> list[Column]:
    """Messages, each null where it doesn't apply, of what ``value`` (a variant) breaks of a JSON Schema.

    Keywords: type, enum, const, required, properties, additionalProperties (a boolean), items, minItems, maxItems, minLength, maxLength,
    pattern (Java's syntax), minimum, maximum, exclusiveMinimum, exclusiveMaximum. Others are an error.
    """
    known = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "title", "description"}
    if unknown := set(schema) - known:
        raise ValueError(f"unknown keywords at {place}: {sorted(unknown)}")
    found: list[Column] = []
    kind = F.schema_of_variant(value)
    is_object, is_array, is_string = kind.startswith("OBJECT"), kind.startswith("ARRAY"), kind == "STRING"
    number = F.try_variant_get(value, "$", "double")
    is_number = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
    broken = lambda when, text: found.append(F.when(when, F.lit(f"{place}: {text}")))
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        tests = {"object": is_object, "array": is_array, "string": is_string, "boolean": kind == "BOOLEAN", "null": F.is_variant_null(value), "number": is_number, "integer": is_number & (number == F.floor(number))}
        ok = F.lit(False)
        for n in names:
            ok = ok | tests[n]
        broken(~ok, f"not of type {'/'.join(names)}")
    if "enum" in schema or "const" in schema:
        allowed = [json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in schema.get("enum", [schema.get("const")])]
        broken(~F.to_json(value).isin(allowed), "not one of the values allowed")
    text = F.try_variant_get(value, "$", "string")
    for word, test in (
        ("minLength", lambda n: is_string & (F.char_length(text) < n)), ("maxLength", lambda n: is_string & (F.char_length(text) > n)), ("pattern", lambda p: is_string & ~text.rlike(p)),
        ("minimum", lambda n: is_number & (number < n)), ("maximum", lambda n: is_number & (number > n)),
        ("exclusiveMinimum", lambda n: is_number & (number <= n)), ("exclusiveMaximum", lambda n: is_number & (number >= n)),
    ):
        if word in schema:
            broken(test(schema[word]), f"breaks {word} {schema[word]}")
    members = F.try_variant_get(value, "$", "map<string,variant>")
    for key in schema.get("required", []):
        broken(is_object & ~F.coalesce(F.map_contains_key(members, F.lit(key)), F.lit(False)), f"{key} is missing")
    if schema.get("additionalProperties") is False:
        extra = F.array_except(F.map_keys(members), F.array(*[F.lit(k) for k in schema.get("properties", {})]).cast("array<string>"))
        broken(is_object & (F.size(extra) > 0), "has unknown properties")
    for key, inner in schema.get("properties", {}).items():
        child = F.when(is_object, F.element_at(members, F.lit(key)))
        found += [F.when(child.isNotNull(), v) for v in violations(inner, child, f"{place}.{key}")]
    items = F.try_variant_get(value, "$", "array<variant>")
    if "minItems" in schema:
        broken(is_array & (F.size(items) < schema["minItems"]), f"breaks minItems {schema['minItems']}")
    if "maxItems" in schema:
        broken(is_array & (F.size(items) > schema["maxItems"]), f"breaks maxItems {schema['maxItems']}")
    if "items" in schema:
        each = F.filter(items, lambda x: F.coalesce(*violations(schema["items"], x, f"{place}[]"), F.lit(None).cast("string")).isNotNull())
        broken(is_array & (F.size(each) > 0), "has an item that breaks its schema")
    return found


def order_keys(edges: DataFrame, calls: DataFrame, most_sorted: int = MOST_SORTED) -> DataFrame:
    """``key, order_key long`` of ``calls`` (``key, place``): the least numbers that are at least a call's place and greater than those of all calls that it needs; null in and behind a cycle or a call without a place.

    ``edges``: ``key, pre`` among ``calls``, both structs of conversation and identifier. Conversations of at most ``most_sorted`` calls and needs are sorted each in a row of arrays, by passes that stop when
    nothing changes, so a chain of any form costs no job of its own; larger ones by a round of joins per call of the longest chain.
    """
    size = calls.select("key.conv_id").unionByName(edges.select("key.conv_id")).groupBy("conv_id").agg(F.count("*").alias("n"))
    size = size.select(F.struct("conv_id").alias("conv"), (F.col("n") <= most_sorted).alias("small"))
    sized = written(calls.withColumn("conv", F.struct("key.conv_id")).join(size, "conv"))
    linked = written(edges.withColumn("conv", F.struct("key.conv_id")).join(size, "conv"))
    small = _sorted_in_rows(linked.where("small"), sized.where("small"))
    large = sized.where("not small").select("key", "place")
    if large.isEmpty():
        return small
    return small.unionByName(_sorted_by_joins(linked.where("not small").select("key", "pre"), large))


def _sorted_in_rows(edges: DataFrame, calls: DataFrame) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("conv").orderBy("place", "key")).alias("at")
    numbered = calls.select("conv", "key", "place", at)
    needs = edges.select("key", "pre").join(numbered.select(F.col("key").alias("pre"), F.col("at").alias("pre_at")), "pre").groupBy("key").agg(F.collect_list("pre_at").alias("pres"))
    each = numbered.join(needs, "key", "left").select("conv", F.struct("at", "key", "place", F.coalesce("pres", F.array().cast("array<int>")).alias("pres")).alias("c"))
    rows = each.groupBy("conv").agg(F.array_sort(F.collect_list("c")).alias("calls"))
    calls_of = F.col("calls")

    def again(state: Column, _: Column) -> Column:
        """One pass: calls whose needs all have a key get theirs; the state stays as it is once a pass has changed nothing."""
        keys = state["keys"]
        get = lambda n: F.get(keys, n - 1)
        ready = lambda c: F.forall(c["pres"], lambda n: get(n).isNotNull())
        new = F.transform(calls_of, lambda c, i: F.coalesce(F.get(keys, i), F.when(c["place"].isNotNull() & ready(c), F.greatest(c["place"], F.coalesce(F.array_max(F.transform(c["pres"], get)) + 1, c["place"])))))
        left = F.size(F.filter(new, lambda k: k.isNull()))
        return F.when(state["done"], state).otherwise(F.struct(new.alias("keys"), ((left == 0) | (left == state["left"])).alias("done"), left.alias("left")))

    none = F.transform(calls_of, lambda _: F.lit(None).cast("long"))
    start = F.struct(none.alias("keys"), F.lit(False).alias("done"), F.size(calls_of).alias("left"))
    solved = rows.select("calls", F.aggregate(F.sequence(F.lit(1), F.size(calls_of)), start, again)["keys"].alias("keys"))
    return solved.select(F.explode(F.arrays_zip("calls", "keys")).alias("x")).select("x.calls.key", F.col("x.keys").alias("order_key"))


def _sorted_by_joins(edges: DataFrame, calls: DataFrame) -> DataFrame:
    """A round per call of the longest chain: calls of which every needed one has its key get theirs."""
    placed = calls.where("place is not null")
    done = written(placed.join(edges.select("key"), "key", "left_anti").select("key", F.col("place").alias("order_key")))
    left = written(edges.join(placed, "key"))
    while True:
        known = left.join(done.select(F.col("key").alias("pre"), "order_key"), "pre", "left")
        ready = known.groupBy("key", "place").agg(F.max("order_key").alias("most"), F.count_if(F.col("order_key").isNull()).alias("open")).where("open = 0")
        new = written(ready.select("key", F.greatest(F.col("most") + 1, "place").alias("order_key")))
        if new.isEmpty():
            discard(new), discard(left)
            return calls.select("key").join(done, "key", "left")
        old = done, left
        left, done = written(left.join(new.select("key"), "key", "left_anti")), written(done.unionByName(new))
        for df in (*old, new):
            discard(df)


def _keyed(df: DataFrame) -> DataFrame:
    """With ``key``, the conversation and identifier of a row; null where the identifier is."""
    return df.withColumn("key", F.when(F.col("call_id").isNotNull(), F.struct("conv_id", "call_id")))


def further(calls: DataFrame, results: DataFrame) -> DataFrame:
    """``key, conv_id, call_id, turn, content, status`` of every result but the first of its conversation and identifier, copies too: ``extra`` where a call has them, else ``orphan``.

    Both tables have ``key``, results ``digest``. Only identifiers with several results are looked at again; equal results are counted, not gathered.
    """
    keys = calls.select("key", F.lit(0).alias("n"), F.lit(True).alias("called")).unionByName(results.select("key", F.lit(1).alias("n"), F.lit(False).alias("called")))
    again = written(keys.where("key is not null").groupBy("key").agg(F.sum("n").alias("n"), F.max("called").alias("called")).where("n > 1").select("key", "called"))
    each = results.join(again, "key").groupBy("key", "called", "turn", "digest", "content").agg(F.count("*").alias("n"))
    first = each.groupBy("key").agg(F.min(F.struct("turn", "digest")).alias("first"))
    left = each.join(first, "key").withColumn("n", F.col("n") - F.struct("turn", "digest").eqNullSafe(F.col("first")).cast("long")).where("n > 0")
    return left.select("key", "key.conv_id", "key.call_id", "turn", "content", F.when(F.col("called"), "extra").otherwise("orphan").alias("status"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).drop("copy")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], *, extras: bool = False) -> DataFrame:
    """Every call with its result, its place in a topological order, what its arguments break, and canonical JSON.

    ``calls`` and ``results`` have the columns of ``CALL`` and ``RESULT`` (others aren't read). An identifier counts within its conversation; a null
    conversation is one too. Returns a row per call, one per result without a call and, with ``extras``, one per further result of a call:
    ``conv_id, call_id, name, turn, result_turn, status, order_key, missing_after, valid, errors, json``.

    * status: ``linked`` (the first result by turn, then a digest of the content), ``early`` (that result isn't after the call), ``pending`` (no result), ``duplicate`` (an earlier call of the conversation has the
      identifier; the first by place, then name and a digest of the arguments is the one, and one without a place comes last; exact repeats of it are duplicates nowhere and link alike), ``extra`` (a result of a call that has
      an earlier one), ``orphan`` (a result without a call), ``unnamed`` (a null identifier).
    * order_key: smaller for a call than for any that needs it: the least number that is at least the call's place, ``turn * 2^20 + index``, and greater than
      those of all calls that it needs. So it is the place itself unless a call needs a later one; calls in or behind a cycle have null, and so have calls
      without a turn or an index and those that need one of them. A duplicate or unnamed call has its own place, as it is none that others could need.
      ``missing_after`` counts what this call needs that its conversation doesn't have.
    * valid, errors: arguments that aren't a JSON object, a tool without a schema and each broken keyword are named, joined by '; '; valid is their absence.
    * json: an object of arguments, id, name and result with sorted keys and no blanks, null members left out; arguments that don't parse are left out too.

    Conversations' identifiers are reduced to one row each, with partial aggregation, before the hash join, so copies don't multiply; its hash tables hold places and
    digests, and results' contents come by a join that can spill. The calls' side of a crowded identifier is split by the join's skew handling. Very long
    arguments and results pass through whole. Empty tables give an empty table.
    """
    if sum(len(json.dumps(s)) for s in schemas.values()) > 100 * MOST_CHECKS:
        raise ValueError("too many schemas for one expression")
    calls = _keyed(calls.select(*[F.col(c.split()[0]) for c in CALL.split(", ")]).withColumn("place", F.col("turn") * PLACES + F.col("index")).withColumn("needs", F.struct("place", F.xxhash64("after").alias("after"))))
    results = _keyed(results.select(*[F.col(c.split()[0]) for c in RESULT.split(", ")]).withColumn("digest", F.md5("content")))
    who = F.struct(F.col("place").isNull().alias("unplaced"), "place", "name", F.md5("arguments").alias("arguments"))
    ids = (
        calls.where("key is not null").select("key", who.alias("first"), F.lit(None).cast("struct<turn:bigint,digest:string>").alias("result"))
        .unionByName(results.where("key is not null").select("key", F.struct("turn", "digest").alias("result")), allowMissingColumns=True)
        .groupBy("key").agg(F.min("first").alias("first"), F.min("result").alias("result"))
    )
    contents = results.where("key is not null").groupBy("key").agg(F.min_by("content", F.struct("turn", "digest")).alias("content"))
    edges = calls.where("key is not null and size(after) > 0").select("conv_id", "key", "place", "needs", F.explode(F.array_distinct("after")).alias("pre"))
    edges = edges.withColumn("pre", F.struct("conv_id", F.col("pre").alias("call_id"))).distinct()
    known = ids.where("first is not null").select(F.col("key").alias("pre"), F.col("first.place").alias("pre_place"), F.lit(True).alias("there"))
    edges = written(edges.join(known, "pre", "left"))
    missing = edges.where("there is null").groupBy("key", "needs").agg(F.count("*").alias("missing_after"))
    tangled = edges.where("there and (pre_place is null or pre_place >= place)").select(F.struct("conv_id").alias("conv")).distinct()

    keyed = calls.join(ids.hint("shuffle_hash"), "key", "left").join(contents, "key", "left").join(missing, ["key", "needs"], "left")
    own = F.col("call_id").isNotNull() & who.eqNullSafe(F.col("first"))
    if tangled.isEmpty():
        keyed = keyed.withColumn("order_key", F.col("place"))
    else:
        inner = written(ids.where("first is not null").select("key", F.col("first.place").alias("place")).withColumn("conv", F.struct("key.conv_id")).join(tangled, "conv", "left_semi").select("key", "place"))
        needed = edges.where("there").join(ids.select("key", "first"), "key").where(F.col("place").eqNullSafe(F.col("first.place"))).select("key", "pre").distinct()
        keys = order_keys(needed.join(inner.select("key"), "key", "left_semi"), inner)
        keyed = keyed.join(keys.withColumn("sorted", F.lit(True)), "key", "left").withColumn("order_key", F.when(F.col("sorted") & own, F.col("order_key")).otherwise(F.col("place")))

    v = F.col("v")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    parts = [F.when(~is_object, F.lit("arguments: not a JSON object")), F.when(~F.coalesce(F.col("name").isin(list(schemas)), F.lit(False)), F.lit("name: a tool without a schema"))]
    for name, schema in sorted(schemas.items()):
        parts += [F.when(is_object & (F.col("name") == name), x) for x in violations(schema, v)]
    checked = keyed.withColumn("v", F.try_parse_json("arguments")).withColumn("errors", F.array_join(F.array_compact(F.array(*parts)), "; "))
    status = (
        F.when(F.col("call_id").isNull(), "unnamed").when(~own, "duplicate").when(F.col("result").isNull(), "pending")
        .when(F.col("result.turn") <= F.col("turn"), "early").otherwise("linked")
    )
    out = checked.select(
        "conv_id", "call_id", "name", "turn", F.when(own, F.col("result.turn")).alias("result_turn"), status.alias("status"), "order_key", F.coalesce("missing_after", F.lit(0)).cast("long").alias("missing_after"),
        (F.col("errors") == "").alias("valid"), "errors",
        F.to_json(F.struct(v.alias("arguments"), F.col("call_id").alias("id"), "name", F.when(own, F.col("content")).alias("result"))).alias("json"),
    )
    lone = ids.where("first is null").join(contents, "key").select("key.call_id", F.col("result.turn").alias("turn"), "content", "key.conv_id", F.lit("orphan").alias("status"))
    spare = further(calls, results).drop("key")
    lone = lone.unionByName(spare if extras else spare.where("status = 'orphan'"))
    lone = lone.unionByName(results.where("call_id is null").select("call_id", "turn", "content", "conv_id", F.lit("unnamed").alias("status")))
    null = lambda kind: F.lit(None).cast(kind)
    rest = lone.select(
        "conv_id", "call_id", null("string").alias("name"), null("long").alias("turn"), F.col("turn").alias("result_turn"), "status", null("long").alias("order_key"), F.lit(0).cast("long").alias("missing_after"),
        null("boolean").alias("valid"), null("string").alias("errors"), F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"))).alias("json"),
    )
    return out.unionByName(rest)
