"""Chat formatting with linked tool calls, in DataFrame operations only.

A message whose text is a JSON object with ``tool_calls`` (a list of {id, name, arguments}) makes calls; a
message of role ``tool`` whose text is an object with ``tool_call_id`` brings a result. Every other text is plain.

Linking. Calls and results of a conversation are hash-joined by identifier. A result belongs to the last call
of its identifier at or before its turn, else to the first after it. Arguments may refer to the results of earlier
calls by objects {"$from": "<id>"}; the message then depends on that call's results.

Order. Messages keep the order of their turns unless a link contradicts it: a message follows what it
depends on. Its place is (after, depth): ``after`` is the largest turn among itself and all it depends on, directly or
not, depth the links since a message that has its own turn there. Places are found exactly, with no bound on
the links: chains by doubling, the rest by rounds of joins until none settles. Messages on a circle of links, or behind one at the
same ``after``, never settle: they are marked and keep their own turns.

Validation. Arguments are checked against the schema of the tool: missing and unknown names, and types.

Output is one row a message with the message as canonical JSON: keys sorted, no spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, table

#: Tools of the query: name -> argument -> (type, required). Types: string, number, integer, boolean, object, array.
TOOLS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string", True)},
    "weather": {"city": ("string", True), "days": ("integer", False), "metric": ("boolean", False)},
    "fetch": {"url": ("string", True), "headers": ("object", False)},
}
CALLS = "array<struct<id: string, name: string, arguments: string>>"
#: How a variant's type is written, by JSON type.
KINDS = {"string": "STRING", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "integer": "BIGINT", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _errors(tools: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Errors of a call (name, args): array of text, in a fixed order."""
    known = "CASE name"
    for tool, schema in sorted(tools.items()):
        checks = []
        for arg, (kind, required) in sorted(schema.items()):
            at = f"try_variant_get(args, {_text('$[' + chr(34) + arg + chr(34) + ']')}, 'variant')"
            missing = f"WHEN {at} IS NULL THEN {_text('missing ' + arg) if required else 'NULL'}"
            given = f"try_variant_get({at}, {_text('$[' + chr(34) + '$from' + chr(34) + ']')}, 'string') IS NOT NULL"  # some result will be put here
            checks.append(f"CASE {missing} WHEN {given} THEN NULL WHEN NOT schema_of_variant({at}) RLIKE '^({KINDS[kind]})$' THEN {_text(f'{arg} is not {kind}')} END")
        names = "array(" + ", ".join(_text(a) for a in sorted(schema)) + ")" if schema else "CAST(array() AS array<string>)"
        unknown = f"transform(array_except(array_sort(names), {names}), a -> concat('unknown ', a))"
        known += f" WHEN {_text(tool)} THEN concat(filter(array({', '.join(checks) or 'NULL'}), e -> e IS NOT NULL), {unknown})"
    known += " ELSE array(concat('no tool ', coalesce(name, 'null'))) END"
    return F.expr(f"CASE WHEN args IS NULL OR NOT schema_of_variant(args) RLIKE '^OBJECT' THEN array('arguments are not an object') ELSE {known} END")


def format_chat(
    messages: DataFrame,
    tools: dict[str, dict[str, tuple[str, bool]]] | None = None,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """A row for each row of ``messages``: conv_id, turn, role, after, depth, n_calls, call_id, status, errors, json.

    status: plain, call, result, unanswered (some call of the message has no result), orphan (a result without
    a call), circular. errors: of the message's calls, joined by '; ', '' if none; call_id: of a result. Null texts count as empty;
    a null role is written as null; rows with a null conversation or turn link with nothing. Repeated rows are each
    formatted; a call or result that is repeated under the same turn counts once in links. Other columns are ignored; an
    empty table gives no rows.
    """
    tools = TOOLS if tools is None else tools
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("v", F.expr("IF(startswith(ltrim(text), '{'), try_parse_json(text), NULL)"))
    rows = rows.withColumn("calls", F.expr(f"IF(v IS NOT NULL AND NOT role <=> 'tool', from_json(to_json(try_variant_get(v, '$.tool_calls', 'variant')), '{CALLS}'), NULL)"))
    rows = rows.withColumn("calls", F.expr("IF(size(calls) > 0, calls, NULL)"))
    rows = rows.withColumn("call_id", F.expr("IF(role = 'tool' AND v IS NOT NULL, try_variant_get(v, '$.tool_call_id', 'string'), NULL)"))
    rows = rows.withColumn("n_calls", F.expr("CAST(coalesce(size(calls), 0) AS BIGINT)"))

    linked = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    made = (
        linked.where("n_calls > 0")
        .select("conv_id", "turn", F.posexplode("calls").alias("k", "call"))
        .select("conv_id", "turn", F.col("call.id").alias("id"), F.col("call.name").alias("name"), F.expr("try_parse_json(call.arguments)").alias("args"), F.col("call.arguments").alias("raw"))
    )
    made = made.withColumn("names", F.expr("IF(args IS NOT NULL AND schema_of_variant(args) RLIKE '^OBJECT', json_object_keys(raw), NULL)"))
    made = made.withColumn("errors", _errors(tools))
    calls = Written(made.select("conv_id", "turn", "id", "raw", "errors"), "calls").read()
    results = Written(linked.where("call_id IS NOT NULL").select("conv_id", "turn", F.col("call_id").alias("id")).distinct(), "results").read()

    asked = calls.where("id IS NOT NULL").select("conv_id", "id", F.col("turn").alias("asked")).distinct()
    # One call for each result: the last at or before it, else the first after.
    pairs = (
        results.join(asked.hint("shuffle_hash"), ["conv_id", "id"])
        .groupBy("conv_id", "id", "turn")
        .agg(F.expr("coalesce(max(asked) FILTER (WHERE asked <= turn), min(asked))").alias("asked"))
    )
    pairs = Written(pairs, "answers").read()
    # References of arguments to earlier results, as edges from the result's message.
    wanted = calls.select("conv_id", "turn", F.explode(F.expr("""regexp_extract_all(raw, '\\\\{\\\\s*"\\\\$from"\\\\s*:\\\\s*"([^"]*)"\\\\s*\\\\}', 1)""")).alias("id")).distinct()
    edges = pairs.select("conv_id", F.col("asked").alias("source"), F.col("turn").alias("turn")).union(
        wanted.join(pairs.select("conv_id", "id", F.col("turn").alias("source")).hint("shuffle_hash"), ["conv_id", "id"]).select("conv_id", "source", "turn")
    )
    # A link to a message of its own turn or a later one is all that can move a message.
    edges = Written(edges.where("source <> turn").distinct(), "edges").read()
    places = _places(edges)

    by_turn = calls.groupBy("conv_id", "turn").agg(F.array_join(F.array_sort(F.flatten(F.collect_set("errors"))), "; ").alias("errors"))
    unanswered = (
        calls.join(pairs.select("conv_id", "id", F.col("asked").alias("turn")).distinct(), ["conv_id", "id", "turn"], "left_anti").select("conv_id", "turn").distinct().withColumn("unanswered", F.lit(True))
    )
    answered = pairs.select("conv_id", "turn", F.col("id").alias("call_id"), F.lit(True).alias("answers"))
    found = (
        rows.drop("calls")
        .join(by_turn, ["conv_id", "turn"], "left")
        .join(unanswered, ["conv_id", "turn"], "left")
        .join(answered, ["conv_id", "turn", "call_id"], "left")
        .join(places, ["conv_id", "turn"], "left")
    )
    status = (
        F.when(F.coalesce("circular", F.lit(False)), "circular")
        .when(F.col("n_calls") > 0, F.when(F.col("unanswered"), "unanswered").otherwise("call"))
        .when(F.col("call_id").isNotNull(), F.when(F.col("answers"), "result").otherwise("orphan"))
        .otherwise("plain")
    )
    # A variant holds the keys of its objects in order, so its JSON is canonical.
    own = F.expr("IF(n_calls > 0 OR call_id IS NOT NULL, to_json(v), to_json(named_struct('c', text)))")
    content = F.when((F.col("n_calls") > 0) | F.col("call_id").isNotNull(), own).otherwise(F.expr("substr(to_json(named_struct('c', text)), 6, length(to_json(named_struct('c', text))) - 6)"))
    role_json = F.expr("IF(role IS NULL, 'null', substr(to_json(named_struct('c', role)), 6, length(to_json(named_struct('c', role))) - 6))")
    return found.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce("after", "turn").alias("after"),
        F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
        "n_calls",
        "call_id",
        status.alias("status"),
        F.when(F.col("n_calls") > 0, F.coalesce("errors", F.lit(""))).otherwise("").alias("errors"),
        F.concat(F.lit('{"content":'), content, F.lit(',"role":'), role_json, F.lit("}")).alias("json"),
    )


def _chains(edges: DataFrame) -> Written:
    """Messages with one source: (conv_id, turn, up, m, k, len, loop, endless), found by doubling.

    up is the first message upwards that has no source or several, len the links from there, m the largest turn
    below up, k the links since it. A place (a, d) of up gives (a, d + len) if a >= m, else (m, k). A chain
    that runs in a circle has no such up and is endless; loop: m stands on the circle.
    """
    single = edges.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.min("source").alias("up")).where("n = 1")
    chains = Written(
        single.select("conv_id", "turn", "up", F.col("turn").alias("m"), F.lit(0).cast("long").alias("k"), F.lit(1).cast("long").alias("len"), F.lit(False).alias("loop"), F.lit(False).alias("endless")), "chains"
    )
    most = chains.read().groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while True:
        now = chains.read()
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("m").alias("m2"), F.col("k").alias("k2"), F.col("len").alias("len2"), F.col("loop").alias("loop2"))
        step = now.join(above, ["conv_id", "up"], "left")
        step = step.select(
            "conv_id", "turn", F.coalesce("up2", "up").alias("up"), F.greatest("m", "m2").alias("m"),
            F.when(F.col("m2") >= F.col("m"), F.col("k2") + F.col("len")).otherwise(F.col("k")).alias("k"),
            (F.col("len") + F.coalesce("len2", F.lit(0))).alias("len"),
            F.when(F.col("m2") > F.col("m"), F.col("loop2")).otherwise(F.col("loop") | F.coalesce(F.col("m2") == F.col("m"), F.lit(False))).alias("loop"),
            F.col("up2").isNotNull().alias("endless"),
        )
        following = Written(step, "chains")
        chains.discard()
        chains, reach = following, 2 * reach
        # What still climbs after twice the messages there are has passed its circle twice.
        if chains.read().where("endless").isEmpty() or reach > 4 * most:
            return chains


def _places(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, after, depth, circular) of the messages that links move.

    Only conversations with a backward link are looked at. Chains of messages with one source are settled by doubling;
    those with several first hear the largest turn above them, until none hears more, and then settle once all sources of the
    same ``after`` have, until none more does. What is left is on a circle or behind one.
    """
    backward = edges.where("source > turn").select("conv_id").distinct()
    if backward.isEmpty():  # every link goes forward in turns: none moves
        return edges.select("conv_id", "turn", F.col("turn").alias("after"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("circular")).where("false")
    edges = Written(edges.join(backward, "conv_id", "left_semi"), "edges").read()
    chains = _chains(edges).read()
    targets = edges.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    roots = edges.select("conv_id", F.col("source").alias("turn")).distinct().join(targets, ["conv_id", "turn"], "left_anti")
    merging = targets.where("n > 1").select("conv_id", "turn")
    above = chains.select("conv_id", F.col("turn").alias("source"), "up", "m", "k", "len", "loop", "endless")
    links = edges.join(merging, ["conv_id", "turn"]).join(above, ["conv_id", "source"], "left")
    none = F.lit(-(2**63)).cast("long")  # below every turn
    links = Written(
        links.select(
            "conv_id", "turn", F.coalesce("up", "source").alias("up"), F.coalesce("m", none).alias("m"), F.coalesce("k", F.lit(0)).cast("long").alias("k"), F.coalesce("len", F.lit(0)).cast("long").alias("len"),
            F.coalesce("loop", F.lit(False)).alias("loop"), F.coalesce("endless", F.lit(False)).alias("endless"),
        ),
        "links",
    ).read()

    known = roots.select("conv_id", "turn", F.col("turn").alias("after"), F.lit(0).cast("long").alias("depth")).union(merging.select("conv_id", "turn", F.col("turn").alias("after"), F.lit(None).cast("long").alias("depth")))
    at = Written(known, "places")

    def heard() -> DataFrame:
        over = at.read().select("conv_id", F.col("turn").alias("up"), F.col("after").alias("a"), F.col("depth").alias("d"))
        return links.join(over, ["conv_id", "up"], "left")

    def follow(step: DataFrame) -> bool:
        nonlocal at
        following = Written(step, "places")
        at.discard()
        at = following
        return not at.read().where("moving").isEmpty()

    several = not merging.isEmpty()
    moving = several
    while moving:
        most = heard().groupBy("conv_id", "turn").agg(F.max(F.greatest("m", F.when(F.col("endless"), none).otherwise(F.col("a")))).alias("most"))
        step = at.read().join(most, ["conv_id", "turn"], "left")
        moving = follow(step.select("conv_id", "turn", F.greatest("after", "most").alias("after"), "depth", F.coalesce(F.col("most") > F.col("after"), F.lit(False)).alias("moving")))
    moving = several
    while moving:
        own = at.read().select("conv_id", "turn", "after")
        # A link counts if it brings the message's own after; its depth is null as long as it isn't settled.
        through = heard().join(own, ["conv_id", "turn"])
        by_up = F.expr("NOT endless AND a >= m")
        brought = F.when(by_up, F.col("a")).otherwise(F.col("m"))
        depth = F.when(by_up, F.col("d") + F.col("len")).when(~F.col("loop"), F.col("k"))
        through = through.select("conv_id", "turn", (brought == F.col("after")).alias("counts"), depth.alias("d"))
        ready = through.groupBy("conv_id", "turn").agg(F.coalesce(F.bool_and(F.expr("NOT counts OR d IS NOT NULL")), F.lit(False)).alias("ready"), F.expr("coalesce(max(d) FILTER (WHERE counts) + 1, 0)").alias("d"))
        step = at.read().join(ready, ["conv_id", "turn"], "left")
        settles = F.expr("depth IS NULL AND ready")
        moving = follow(step.select("conv_id", "turn", "after", F.when(settles, F.col("d")).otherwise(F.col("depth")).alias("depth"), settles.alias("moving")))

    places = at.read().select("conv_id", "turn", "after", "depth")
    over = places.select("conv_id", F.col("turn").alias("up"), F.col("after").alias("a"), F.col("depth").alias("d"))
    by_up = F.expr("NOT endless AND a >= m")
    hung = chains.join(over, ["conv_id", "up"], "left").select(
        "conv_id", "turn", F.when(by_up, F.col("a")).otherwise(F.col("m")).alias("after"), F.when(by_up, F.col("d") + F.col("len")).when(~F.col("loop"), F.col("k")).alias("depth")
    )
    circular = F.col("depth").isNull()
    return (
        places.union(hung)
        .select("conv_id", "turn", F.when(circular, F.col("turn")).otherwise(F.col("after")).alias("after"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), circular.alias("circular"))
        .where("circular OR after <> turn OR depth <> 0")
    )


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(table(spark, sf_dir, "conversations"))


#: For conversations without calls, as the tables have them; links are tested on fixtures.
OP9_SQL = """
SELECT conv_id, turn, role, turn AS "after", CAST(0 AS BIGINT) AS depth, CAST(0 AS BIGINT) AS n_calls,
       CAST(NULL AS VARCHAR) AS call_id, 'plain' AS status, '' AS errors,
       CAST(json_object('content', coalesce(text, ''), 'role', role) AS VARCHAR) AS json
FROM conversations
"""
