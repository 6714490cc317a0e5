"""Tool-call linking for chat data, in DataFrame operations only.

Calls and results meet by conversation and call identifier. Calls that name other calls in their
arguments are ordered topologically, level by level (Kahn's algorithm on tables). Arguments are
parsed as variants, held against the schema of their tool, and written as canonical JSON: keys sorted, no
white space, one form per value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.components import written

# Field -> (JSON type, required). Types: string, integer, number, boolean, array, object, reference
# (a string that is the identifier of another call of the conversation).
Schema = dict[str, tuple[str, bool]]

_KINDS = {
    "string": "{t} = 'STRING'",
    "reference": "{t} = 'STRING'",
    "integer": "{t} = 'BIGINT' OR {t} RLIKE '^DECIMAL\\\\([0-9]+,0\\\\)$'",
    "number": "{t} = 'BIGINT' OR {t} = 'DOUBLE' OR {t} RLIKE '^DECIMAL'",
    "boolean": "{t} = 'BOOLEAN'",
    "array": "{t} RLIKE '^ARRAY'",
    "object": "{t} RLIKE '^OBJECT'",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _errors(schemas: dict[str, Schema]) -> Column:
    """What is wrong with ``args`` (a variant) of a call of ``name``: sorted, empty if nothing is."""
    tools = ["WHEN args IS NULL THEN array('not JSON')", "WHEN NOT (schema_of_variant(args) RLIKE '^OBJECT') THEN array('not an object')"]
    for name, schema in schemas.items():
        checks = []
        for field, (kind, required) in schema.items():
            value = f"variant_get(args, {_quoted('$.' + field)}, 'variant')"
            fits = _KINDS[kind].format(t=f"schema_of_variant({value})")
            missing = _quoted(f"missing {field}") if required else "NULL"
            checks.append(f"CASE WHEN {value} IS NULL THEN {missing} WHEN NOT ({fits}) THEN {_quoted(f'{field} is not {kind}')} END")
        known = ", ".join(_quoted(f) for f in schema)
        extra = f"transform(array_except(keys, array({known})), k -> concat('unknown ', k))"
        tools.append(f"WHEN name = {_quoted(name)} THEN concat(array({', '.join(checks)}), {extra})")
    return F.expr(f"array_sort(array_compact(CASE {' '.join(tools)} ELSE array('unknown tool') END))")


def _references(schemas: dict[str, Schema]) -> Column:
    """The call identifiers that the arguments name."""
    cases = []
    for name, schema in schemas.items():
        fields = [f for f, (kind, _) in schema.items() if kind == "reference"]
        values = ", ".join(f"try_variant_get(args, {_quoted('$.' + f)}, 'string')" for f in fields)
        cases.append(f"WHEN name = {_quoted(name)} THEN array_distinct(array_compact(cast(array({values}) AS array<string>)))")
    return F.expr(f"coalesce(CASE {' '.join(cases)} END, cast(array() AS array<string>))")


def _levels(calls: DataFrame) -> DataFrame:
    """``conv``, ``call_id``, ``level`` for calls whose references can be resolved.

    Level 0 names no other call; a call is one above the highest call it names. Each round settles one level and
    leaves only what still waits, so the rounds are as many as the longest chain. Calls on a cycle, or above
    one, never settle and have no level.
    """
    edges = calls.select("conv", "call_id", F.explode("references").alias("needs"))
    known = calls.select("conv", F.col("call_id").alias("needs"))
    edges = written(edges.join(known, ["conv", "needs"], "left_semi"), "references")
    names = calls.select("conv", "call_id")
    done = written(names.join(edges, ["conv", "call_id"], "left_anti").withColumn("level", F.lit(0)), "level")
    settled, level = done, 0
    while True:
        level += 1
        ready = done.select("conv", F.col("call_id").alias("needs"))
        # Of what waits, an edge is gone once the call it needs is settled.
        after = written(edges.join(ready, ["conv", "needs"], "left_anti"), "waiting")
        freed = edges.select("conv", "call_id").distinct().join(after, ["conv", "call_id"], "left_anti")
        done = written(freed.withColumn("level", F.lit(level)), "level")
        if done.isEmpty():
            return settled
        settled, edges = settled.union(done), after


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema], others: DataFrame | None = None) -> DataFrame:
    """Link ``calls`` (conv_id, turn, call_id, name, arguments) with ``results`` (conv_id, turn, call_id, content).

    Returns one row per different call (conversation and identifier): ``conv_id``, ``call_id``, ``name``, ``turn``,
    ``result_turn``, ``copies`` (calls of that identifier), ``answers`` (results of it), ``level`` (topological; null on a
    cycle), ``errors``, ``valid``, ``status`` (linked, pending without a result, early if the result stands before the
    call) and ``record`` (canonical JSON). Of several calls or results of one identifier the first is linked, by turn,
    then by content. Results without a call are rows with status orphan.

    Every other call and result has its own row too, with status repeated and its content in ``record``; rows that agree in
    everything share one, and ``copies`` or ``answers`` says how many they are. They are rows and no list, since one
    identifier may have any number of them. ``others`` (conv_id, turn, name, content) are turns that are neither: rows with
    status context and null identifier. So each input row is in exactly one output row.

    A null conversation is a conversation of its own; a null identifier is the identifier ''. References to calls that do
    not exist are errors.
    """
    conv = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id"), F.lit(0)).alias("id"))
    key = ["conv", "call_id"]
    name_of = F.coalesce("call_id", F.lit("")).alias("call_id")

    def distinct(rows: DataFrame, *fields: str) -> DataFrame:
        """Equal rows as one, with their number in ``n``. A partial aggregate, as are the minima: no row is a hot spot."""
        return rows.select(conv.alias("conv"), name_of, F.struct(*fields).alias("row")).groupBy(*key, "row").agg(F.count("*").alias("n"))

    called = written(distinct(calls, "turn", "name", "arguments"), "called")
    answered = written(distinct(results, "turn", "content"), "answered")
    first = (
        called.groupBy(*key)
        .agg(F.min("row").alias("c"), F.sum("n").alias("copies"))
        .select(*key, "copies", "c.*")
        .withColumn("args", F.try_parse_json("arguments"))
        .withColumn("keys", F.expr("coalesce(json_object_keys(arguments), cast(array() AS array<string>))"))
        .withColumn("errors", _errors(schemas))
        .withColumn("references", _references(schemas))
        .withColumn("arguments", F.to_json("args"))
        .drop("args", "keys")
    )
    first = written(first, "calls")
    answers = (
        answered.groupBy(*key)
        .agg(F.min("row").alias("r"), F.sum("n").alias("answers"))
        .select(*key, "answers", F.col("r.turn").alias("result_turn"), "r.content")
    )
    named = first.select("conv", F.col("call_id").alias("n")).withColumnRenamed("n", "needs")
    wanted = first.select(*key, F.explode("references").alias("needs"))
    dangling = (
        wanted.join(named, ["conv", "needs"], "left_anti")
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set(F.concat(F.lit("no call "), "needs"))).alias("dangling"))
    )
    whole = (
        first.withColumn("called", F.lit(True))
        .join(answers, key, "full")
        .join(_levels(first), key, "left")
        .join(dangling, key, "left")
        .withColumn("errors", F.concat(F.coalesce("errors", F.array().cast("array<string>")), F.coalesce("dangling", F.array().cast("array<string>"))))
    )
    has_call = F.col("called").isNotNull()
    status = (
        F.when(~has_call, "orphan")
        .when(F.col("answers").isNull(), "pending")
        .when(F.col("result_turn") < F.col("turn"), "early")
        .otherwise("linked")
    )
    linked = whole.select(
        F.when(~F.col("conv.none"), F.col("conv.id")).alias("conv_id"),
        "call_id", "name", "turn", "result_turn",
        F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("answers", F.lit(0)).alias("answers"),
        "level", "errors", (has_call & (F.size("errors") == 0) & F.col("level").isNotNull()).alias("valid"),
        status.alias("status"), _record(F.coalesce("arguments", F.lit("null")), "call_id", "name", "content", "level").alias("record"),
    )
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null"))
    calls_again = _beyond_first(called, key).select(*key, "n", "row.*")
    results_again = _beyond_first(answered, key).select(*key, "n", "row.*")
    out = linked.unionByName(
        _plain(calls_again, "repeated", name="name", turn="turn", copies="n", record=_record(arguments, "call_id", "name"))
    ).unionByName(_plain(results_again, "repeated", result_turn="turn", answers="n", record=_record(None, "call_id", "content")))
    if others is None:
        return out
    turns = others.select(conv.alias("conv"), F.lit(None).cast("string").alias("call_id"), "turn", "name", "content")
    return out.unionByName(_plain(turns, "context", name="name", turn="turn", record=_record(None, "name", "content")))


def _record(arguments: Column | None, *fields: str) -> Column:
    """Canonical JSON: null fields are left out; the writer of variants sorts the keys."""
    whole = F.to_json(F.struct(*fields))
    if arguments is not None:
        more = F.substring(whole, 2, 2_000_000_000)
        whole = F.concat(F.lit('{"arguments":'), arguments, F.when(more == "}", F.lit("")).otherwise(F.lit(",")), more)
    return F.to_json(F.try_parse_json(whole))


def _beyond_first(rows: DataFrame, key: list[str]) -> DataFrame:
    """Distinct rows of each key without the one that is linked, of which its further copies stay.

    Few identifiers have several rows; the join meets only those. One with very many is split by the engine's skew
    handling, since its side of the join has one row.
    """
    first = rows.groupBy(*key).agg(F.min("row").alias("first"), F.sum("n").alias("every")).filter(F.col("every") > 1)
    again = rows.join(first.drop("every"), key)
    same = F.col("row").eqNullSafe(F.col("first"))
    return again.withColumn("n", F.col("n") - F.when(same, 1).otherwise(0)).filter(F.col("n") > 0).drop("first")


def _plain(rows: DataFrame, status: str, record: Column, **columns: str) -> DataFrame:
    """Rows of the result that link nothing."""
    types = {"name": "string", "turn": "long", "result_turn": "long", "copies": "long", "answers": "long"}
    values = {c: F.col(columns[c]).cast(t) if c in columns else F.lit(0 if c in ("copies", "answers") else None).cast(t) for c, t in types.items()}
    return rows.select(
        F.when(~F.col("conv.none"), F.col("conv.id")).alias("conv_id"), "call_id", *[v.alias(c) for c, v in values.items()],
        F.lit(None).cast("int").alias("level"), F.array().cast("array<string>").alias("errors"), F.lit(False).alias("valid"),
        F.lit(status).alias("status"), record.alias("record"),
    )


# The tools of ``as_tool_calls``.
SCHEMAS: dict[str, Schema] = {
    "search": {"query": ("string", True), "limit": ("integer", True), "after": ("reference", False)},
    "lookup": {"query": ("string", True), "limit": ("integer", False), "after": ("reference", False), "exact": ("boolean", True)},
    "write": {"query": ("string", True), "score": ("number", True), "after": ("reference", False)},
}


def as_tool_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and other turns from plain turns: an assistant's turn is a call, the user's turn after it is its result.

    All else is context: other roles and null ones, opening user turns, and turns without a number.
    The tool follows from the turn, the arguments from the text; every fifth text length gives a limit as a string.
    A call builds on the call at about half its turn.
    """
    turn = F.col("turn")
    up = 2 * F.floor((turn + 1) / 4) - 1 + (turn + 1) % 2
    size = F.length(F.coalesce("text", F.lit("")))
    after = F.when(up >= 1, F.concat(F.lit("call-"), up.cast("string")))
    common = [F.col("text").alias("query"), after.alias("after")]
    search = F.to_json(F.struct(*common, size.alias("limit")))
    spoiled = F.to_json(F.struct(*common, size.cast("string").alias("limit")))
    lookup = F.to_json(F.struct(*common, (size % 2 == 0).alias("exact")))
    write = F.to_json(F.struct(*common, (size / 2).alias("score")))
    tool = F.pmod(turn, F.lit(3))
    arguments = (
        F.when((tool == 0) & (size % 5 == 0), spoiled).when(tool == 0, search).when(tool == 1, lookup).otherwise(write)
    )
    name = F.when(tool == 0, "search").when(tool == 1, "lookup").otherwise("write")
    is_call, is_result = "role = 'assistant' AND turn IS NOT NULL", "role = 'user' AND turn > 0"
    calls = conversations.filter(is_call).select(
        "conv_id", "turn", F.concat(F.lit("call-"), turn.cast("string")).alias("call_id"), name.alias("name"), arguments.alias("arguments")
    )
    results = conversations.filter(is_result).select(
        "conv_id", "turn", F.concat(F.lit("call-"), (turn - 1).cast("string")).alias("call_id"), F.col("text").alias("content")
    )
    others = conversations.filter(f"NOT coalesce(({is_call}) OR ({is_result}), false)").select(
        "conv_id", "turn", F.col("role").alias("name"), F.col("text").alias("content")
    )
    return calls, results, others
