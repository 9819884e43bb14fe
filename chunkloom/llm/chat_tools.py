"""Chat formatting: tool calls and their results, linked, checked, ordered and serialised.

DataFrame functions only. Calls and results are joined by (conversation, call id); a result
without a call, a call without a result and repeated ids are told apart, not dropped. Arguments are checked against
a schema per tool: JSON object, required keys, no unknown keys, a type for each key. Calls
that use another call's result (``depends_on``) come after it, wherever they stand: a call's level
is the number of calls in its longest chain of dependencies; calls on a cycle, or behind one, have
no level and sort last in their conversation. Chains of calls with one dependency each are levelled
by pointer doubling, in as many rounds as the logarithm of their length; calls with several cost
one round for each step of the longest chain of such calls. Dependencies on ids that no call has
hold nothing back. The canonical JSON has keys in a fixed order, minimal escapes and no blanks.

The query's table has no tool calls: a user turn stands for a call and the turn of any other role
after it for its result; see ``calls_and_results`` for what is made up.

Defined results: a null or empty conversation id or call id links with nothing and is reported
as such; a null text is an empty string; a repeated call id is ``duplicate`` from its second
position on and links with nothing; repeated rows are repeated ids; empty tables give an empty
result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkloom.llm.common import Scratch, table

#: Tools: for each key of the arguments its type and whether it is required.
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "lookup": {"key": ("string", True)},
    "compute": {"expression": ("string", True), "precise": ("boolean", False)},
}


def json_string(c: Column) -> Column:
    """A JSON string with minimal escapes."""
    one = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"')
    for ch, esc in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        one = F.replace(one, F.lit(ch), F.lit("\\" + esc))
    for code in [*range(0, 8), 11, *range(14, 32)]:
        one = F.replace(one, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), one, F.lit('"'))


def argument_error(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """Null for valid arguments, else what is wrong with them."""
    keys = F.json_object_keys(arguments)
    out = F.when(name.isNull() | ~name.isin(list(schemas)), "unknown tool").when(keys.isNull(), "not an object")
    types = {"string": r'^"', "integer": r"^-?[0-9]+$", "number": r"^-?[0-9]", "boolean": r"^(true|false)$", "object": r"^\{", "array": r"^\["}
    for tool, fields in schemas.items():
        here = name == tool
        out = out.when(here & (F.size(F.array_except(keys, F.array(*map(F.lit, fields)))) > 0), "unknown key")
        for key, (kind, required) in fields.items():
            # A variant keeps the JSON type, which get_json_object would lose for strings.
            value = F.to_json(F.try_variant_get(F.try_parse_json(arguments), f"$.{key}", "variant"))
            has = F.array_contains(keys, key)
            if required:
                out = out.when(here & ~has, f"missing {key}")
            out = out.when(here & has & ~F.coalesce(value.rlike(types[kind]), F.lit(False)), f"{key} is not {kind}")
    return out


_ID = ["conv_id", "call_id"]


def _doubled(pointers: DataFrame, calls: int, scratch: Scratch) -> DataFrame:
    """Pointers (conv_id, call_id, dep, far) followed to a call that has none; those on a cycle, or behind it, keep one that has."""
    for _ in range(max(1, calls.bit_length() + 1)):
        on = pointers.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("next"), F.col("far").alias("more"))
        step = pointers.join(on, ["conv_id", "dep"], "left")
        new = scratch.keep(step.select("conv_id", "call_id", F.coalesce("next", "dep").alias("dep"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(pointers)
        pointers = new
        if not pointers.filter("moved").limit(1).count():
            break
    return pointers


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, level): the length of the longest chain of dependencies; null on and behind cycles."""
    calls = scratch.keep(calls.select("conv_id", "call_id", "depends_on"))
    ids = calls.select("conv_id", F.col("call_id").alias("dep"))
    e = scratch.keep(calls.select("conv_id", "call_id", F.explode("depends_on").alias("dep")).distinct().join(ids, ["conv_id", "dep"], "left_semi"))
    n = scratch.keep(e.groupBy(*_ID).agg(F.count("*").alias("n"), F.min("dep").alias("dep")))
    done = calls.select(*_ID).join(n, _ID, "left_anti").withColumn("level", F.lit(0))
    most = n.groupBy("conv_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    if not most:
        return done.withColumn("level", F.col("level").cast("int"))
    # Calls with one dependency, and what their chains end in: a call with none or with several.
    one = _doubled(scratch.keep(n.filter("n = 1").select(*_ID, "dep", F.lit(1).cast("long").alias("far"))), most, scratch)
    several = n.filter("n > 1").select(*_ID)
    if several.limit(1).count():
        done = done.union(_several(several, e, one, scratch))
    end = done.select("conv_id", F.col("call_id").alias("dep"), F.col("level").alias("at"))
    chained = one.join(end, ["conv_id", "dep"], "left").select(*_ID, (F.col("at") + F.col("far")).alias("level"))  # null behind a cycle
    return done.union(chained).withColumn("level", F.col("level").cast("int"))


def _several(several: DataFrame, e: DataFrame, one: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, level) of the calls with several dependencies, by rounds over the chains between them."""
    names = several.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("held"))
    chain = one.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("end"), "far", F.lit(True).alias("chained"))
    x = e.join(several, _ID, "left_semi").join(chain, ["conv_id", "dep"], "left")
    x = x.select(*_ID, F.coalesce("end", "dep").alias("dep"), (F.coalesce("far", F.lit(0)) + 1).alias("far"), F.coalesce("chained", F.lit(False)).alias("chained"))
    # A chain that ends in a call with one dependency goes round: what it holds back stays held.
    round_ = one.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("cyclic"))
    x = scratch.keep(x.join(names, ["conv_id", "dep"], "left").join(round_, ["conv_id", "dep"], "left"))
    todo = scratch.keep(x.groupBy(*_ID).agg(F.coalesce(F.max(F.when(F.col("held").isNull(), F.col("far"))), F.lit(0)).alias("level")))
    x = scratch.keep(x.filter("held or cyclic").groupBy(*_ID, "dep").agg(F.max("far").alias("far")))
    parts: list[DataFrame] = []
    while True:
        free = scratch.keep(todo.join(x.select(*_ID).distinct(), _ID, "left_anti"))
        if not free.limit(1).count():
            break
        parts.append(free)
        if len(parts) > 16:
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.union(p)
            parts = [scratch.keep(whole)]
        gone = free.select("conv_id", F.col("call_id").alias("dep"), F.col("level").alias("at"))
        more = x.join(gone, ["conv_id", "dep"]).groupBy(*_ID).agg(F.max(F.col("at") + F.col("far")).alias("more"))
        todo = scratch.keep(todo.join(free, _ID, "left_anti").join(more, _ID, "left").select(*_ID, F.greatest("level", F.coalesce("more", "level")).alias("level")))
        x = scratch.keep(x.join(gone, ["conv_id", "dep"], "left_anti"))
    out = todo.withColumn("level", F.lit(None).cast("long"))
    for p in parts:
        out = out.union(p.select(*_ID, "level"))
    return out


def _first(rows: DataFrame, order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """Add ``name``: 0 without conversation or call id, 1 for the first row of an id by ``order``, 2 for the others.

    The first is found by an aggregation, so that an id that very many rows have is no one task's window.
    """
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()))
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = rows.filter(named).groupBy(*_ID).agg(F.min(F.struct(*order, "row")).alias("first")).select(F.col("first.row").alias("row"), F.lit(1).alias("is_first"))
    out = rows.join(first, "row", "left")
    return scratch.keep(out.withColumn(name, F.when(~named, 0).when(F.col("is_first") == 1, 1).otherwise(2)).drop("row", "is_first"))


def link_tools(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """Calls and results, linked and in order.

    calls: conv_id long, call_id string, pos long, name string, arguments string, depends_on array<string>
    results: conv_id long, call_id string, pos long, content string

    One row per call and per result without a call: conv_id, call_id, status (linked, no result,
    no call, duplicate, early: the result stands before its call), error, level, rank in the
    conversation's order, json.
    """
    scratch = Scratch(calls.sparkSession)
    c = _first(calls.select("conv_id", "call_id", "pos", "name", "arguments", "depends_on"), ["pos", "name", "arguments"], "nth", scratch)
    r = _first(results.select("conv_id", "call_id", F.col("pos").alias("r_pos"), "content"), ["r_pos", "content"], "r_nth", scratch)
    j = c.join(r, (c["conv_id"] == r["conv_id"]) & (c["call_id"] == r["call_id"]) & (c["nth"] == 1) & (r["r_nth"] == 1), "full_outer")
    conv, call = F.coalesce(c["conv_id"], r["conv_id"]), F.coalesce(c["call_id"], r["call_id"])
    status = (
        F.when(F.coalesce(F.col("nth"), F.col("r_nth")) > 1, "duplicate")
        .when(F.col("nth").isNull(), "no call")
        .when(F.col("r_nth").isNull(), "no result")
        .when(F.col("r_pos") < F.col("pos"), "early")
        .otherwise("linked")
    )
    error = F.when(F.col("nth").isNotNull(), argument_error(F.col("name"), F.coalesce("arguments", F.lit("")), schemas))
    j = j.select(conv.alias("conv_id"), call.alias("call_id"), F.coalesce("pos", "r_pos").alias("pos"), "nth", status.alias("status"), error.alias("error"), "name", "arguments", "content")
    lev = levels(c.filter("nth = 1"), scratch)
    j = j.join(lev, ["conv_id", "call_id"], "left")
    value = F.when(F.col("error").isNull() & F.col("nth").isNotNull(), F.to_json(F.try_parse_json("arguments"))).otherwise(json_string(F.coalesce("arguments", F.lit(""))))
    part = lambda k, v: F.concat(F.lit(f'"{k}":'), v)
    call_json = F.concat(F.lit("{"), part("arguments", value), F.lit(","), part("id", F.coalesce(json_string(F.col("call_id")), F.lit("null"))), F.lit(","), part("name", F.coalesce(json_string(F.col("name")), F.lit("null"))), F.lit("}"))
    body = [
        part("call", F.when(F.col("nth").isNotNull(), call_json).otherwise("null")),
        part("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))),
        part("result", F.when(F.col("content").isNotNull(), json_string(F.col("content"))).otherwise("null")),
        part("status", json_string(F.col("status"))),
    ]
    j = j.withColumn("json", F.concat(F.lit("{"), F.concat_ws(",", *body), F.lit("}")))
    # A conversation of any length: its rank is its salted slot, not one task's window.
    return ranked(j, scratch).select("conv_id", "call_id", "status", "error", "level", "rank", "json")


def ranked(j: DataFrame, scratch: Scratch, span: int = 4096) -> DataFrame:
    """Add the row's rank, from 0, in its conversation by (level, position, id), counting spans of levels and positions first."""
    j = j.withColumn("lev", F.coalesce("level", F.lit(2**31 - 1))).withColumn("span", F.floor(F.coalesce(F.col("pos"), F.lit(0)) / span))
    j = scratch.keep(j.withColumn("block", F.floor(F.col("lev") / span)))
    before = lambda of, w: F.coalesce(F.sum(of).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = scratch.keep(j.groupBy("conv_id", "block", "lev", "span").agg(F.count("*").alias("n")))
    blocks = n.groupBy("conv_id", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), before("n", Window.partitionBy("conv_id").orderBy("block")).alias("first"))
    n = n.withColumn("before", before("n", Window.partitionBy("conv_id", "block").orderBy("lev", "span")))
    n = n.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    n = n.select(F.col("conv_id").alias("c"), F.col("lev").alias("l"), F.col("span").alias("s"), (F.col("first") + F.col("before")).alias("before"))
    inner = Window.partitionBy("conv_id", "lev", "span").orderBy("pos", "call_id", "status", "json")
    j = j.withColumn("nth_here", F.row_number().over(inner))
    j = j.join(n, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("lev") == F.col("l")) & (F.col("span") == F.col("s")), "left")
    return j.withColumn("rank", (F.col("before") + F.col("nth_here") - 1).cast("long"))


def calls_and_results(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A user turn as a call, a turn of any other role as the result of the call before it.

    Turn t of conversation c calls ``c-t``; its tool and arguments follow from the text's length n.
    It depends on the next user turn's call if n mod 4 is 0, on those of the two user turns before
    it if n mod 4 is 1, else on that of the user turn before it, so calls have to be put in another
    order than they stand in, some wait for two, and some go round. Turn t + 1 answers ``c-t``.
    """
    text = F.coalesce("text", F.lit(""))
    pick = F.char_length(text) % 3
    name = F.when(pick == 0, "search").when(pick == 1, "lookup").otherwise("compute")
    q = json_string(text)
    arguments = (
        F.when(pick == 0, F.concat(F.lit('{"query":'), q, F.lit(',"limit":'), F.char_length(text).cast("string"), F.lit("}")))
        .when(pick == 1, F.concat(F.lit('{"key":'), q, F.lit("}")))
        .otherwise(F.concat(F.lit('{"precise":'), F.when(F.char_length(text) % 2 == 0, "true").otherwise('"no"'), F.lit(',"expression":'), q, F.lit("}")))
    )
    ident = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    turn = F.col("turn")
    four = F.char_length(text) % 4
    deps = F.when(turn.isNull(), F.array().cast("array<string>")).when(four == 0, F.array(ident(turn + 2))).when(four == 1, F.array(ident(turn - 2), ident(turn - 4))).otherwise(F.array(ident(turn - 2)))
    calls = conversations.filter("role = 'user'").select("conv_id", F.when(F.col("conv_id").isNotNull() & turn.isNotNull(), ident(turn)).alias("call_id"), turn.alias("pos"), name.alias("name"), arguments.alias("arguments"), deps.alias("depends_on"))
    results = conversations.filter("role is null or role <> 'user'").select("conv_id", F.when(F.col("conv_id").isNotNull() & turn.isNotNull(), ident(turn - 1)).alias("call_id"), turn.alias("pos"), text.alias("content"))
    return calls, results


def op2_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tools(*calls_and_results(table(spark, sf_dir, "conversations")))


QUERIES = {"op2_chat_tools": op2_chat_tools}

_CALL_SQL = """'{"arguments":' || CASE WHEN error IS NULL THEN valid ELSE CAST(to_json(arguments) AS VARCHAR) END || ',"id":' || coalesce(CAST(to_json(j.call_id) AS VARCHAR), 'null') || ',"name":"' || name || '"}'"""
ORACLE_SQL = {
    "op2_chat_tools": f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, CAST(to_json(coalesce(text, '')) AS VARCHAR) AS q, length(coalesce(text, '')) AS len FROM conversations),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY pos, name, arguments) AS nth FROM (
  SELECT conv_id, conv_id || '-' || turn AS call_id, turn AS pos,
    CASE len % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'compute' END AS name,
    CASE len % 3 WHEN 0 THEN '{{"query":' || q || ',"limit":' || len || '}}' WHEN 1 THEN '{{"key":' || q || '}}'
      ELSE '{{"precise":' || CASE WHEN len % 2 = 0 THEN 'true' ELSE '"no"' END || ',"expression":' || q || '}}' END AS arguments,
    CASE len % 3 WHEN 0 THEN '{{"limit":' || len || ',"query":' || q || '}}' WHEN 1 THEN '{{"key":' || q || '}}' ELSE '{{"expression":' || q || ',"precise":true}}' END AS valid,
    CASE WHEN len % 3 = 2 AND len % 2 = 1 THEN 'precise is not boolean' END AS error
  FROM t WHERE role = 'user')),
f AS (SELECT c.conv_id, c.call_id, pos, t.len FROM c JOIN t ON c.conv_id = t.conv_id AND pos = turn AND role = 'user' AND c.arguments LIKE '%' || t.q || '%' WHERE nth = 1),
d AS (SELECT DISTINCT f.conv_id, f.call_id, g.call_id AS dep FROM f JOIN f AS g ON f.conv_id = g.conv_id
  AND CASE f.len % 4 WHEN 0 THEN g.pos = f.pos + 2 WHEN 1 THEN g.pos IN (f.pos - 2, f.pos - 4) ELSE g.pos = f.pos - 2 END),
size AS (SELECT conv_id, count(*) AS calls FROM f GROUP BY conv_id),
w(conv_id, call_id, dep, far, calls) AS (SELECT conv_id, call_id, dep, 1, calls FROM d JOIN size USING (conv_id)
  UNION SELECT w.conv_id, w.call_id, d.dep, far + 1, calls FROM w JOIN d ON w.conv_id = d.conv_id AND w.dep = d.call_id WHERE far < calls),
lev AS (SELECT f.conv_id, f.call_id, CASE WHEN coalesce(max(far), 0) < any_value(s.calls) THEN coalesce(max(far), 0) END AS level
  FROM f JOIN size s USING (conv_id) LEFT JOIN w USING (conv_id, call_id) GROUP BY ALL),
r AS (SELECT conv_id, conv_id || '-' || (turn - 1) AS call_id, turn AS r_pos, q AS content,
  row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS r_nth FROM t WHERE role IS NULL OR role <> 'user'),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(pos, r_pos) AS pos, nth, name, arguments, valid, error, content,
  CASE WHEN coalesce(nth, r_nth) > 1 THEN 'duplicate' WHEN nth IS NULL THEN 'no call' WHEN r_nth IS NULL THEN 'no result' ELSE 'linked' END AS status
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id AND nth = 1 AND r_nth = 1),
o AS (SELECT j.conv_id, j.call_id, status, error, pos, lev.level,
  '{{"call":' || CASE WHEN nth IS NULL THEN 'null' ELSE {_CALL_SQL} END || ',"conv_id":' || coalesce(CAST(j.conv_id AS VARCHAR), 'null')
  || ',"result":' || coalesce(content, 'null') || ',"status":"' || status || '"}}' AS json FROM j LEFT JOIN lev ON j.conv_id = lev.conv_id AND j.call_id = lev.call_id)
SELECT conv_id, call_id, status, error, CAST(level AS INTEGER) AS level,
  row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(level, 2147483647), pos // 4096, pos, call_id, status, json) - 1 AS rank, json FROM o"""
}
