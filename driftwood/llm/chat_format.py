"""Chat formatting: tool calls linked to their results, ordered, validated, serialised.

Calls and results are joined by identifier. Calls are ordered so that each comes after the
calls it depends on; arguments are checked against the tools' schemas; a call with its
result becomes one canonical JSON object: keys in code-point order, no blanks, numbers in
their shortest form. Everything here is DataFrame expressions, variants included.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.llm.common import written

#: A row for each parameter of each tool.
PARAMS = "name string, param string, type string, required boolean, min_length int, minimum double, maximum double, allowed array<string>"
#: JSON-schema types and the variant types that fit them. Fixed values.
TYPES = {"string": "STRING", "integer": "BIGINT|DECIMAL\\([0-9]+,0\\)", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "null": "VOID", "array": "ARRAY.*", "object": "OBJECT.*"}


def derive_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns ``(conv_id, turn, role, text)``.

    A user turn calls the tool ``answer`` with its text, a system turn ``configure``; the
    call's identifier is conv_id:turn. An assistant turn is a result and names the turn just
    before it. Rows of other roles, and of none, are neither. A null text is left out of the
    arguments.

    What calls depend on and how their arguments break the schemas follows from numbers, so
    that all cases come up: by conv_id modulo 4, user calls depend on the one before (0), on
    the one after (1), on each other in pairs (2), or every other one on the one after and
    all on a call that is not there (3). Conversations of some other moduli write the turn as
    text, leave out the text, add a parameter, call an unknown tool or pass a list.
    """
    turns = conversations.select(F.col("conv_id").cast("string").alias("conv_id"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("n"), F.col("turn").cast("long").alias("seq"), "role", "text")
    name = lambda by: F.concat("conv_id", F.lit(":"), (F.col("seq") + by).cast("string"))
    every = lambda k: F.col("n") % k == 0
    size = F.coalesce(F.length("text"), F.lit(0))
    text = F.when(~every(11), F.col("text"))
    style = F.element_at(F.array(F.lit("short"), F.lit("long"), F.lit("loud")), (size % 3 + 1).cast("int"))
    number = (F.col("seq") - 1).alias("turn")
    extra = F.when(every(5), F.lit(True)).alias("debug")
    answer = F.to_json(F.struct(text.alias("query"), style.alias("style"), number, extra))
    worded = F.to_json(F.struct(text.alias("query"), style.alias("style"), number.cast("string").alias("turn"), extra))
    configure = F.to_json(F.struct(text.alias("instructions"), ((size % 12) / 10).alias("temperature"), extra))
    user = F.col("role") == "user"
    arguments = F.when(every(17), F.to_json(F.array("text"))).when(user & (F.col("n") % 7 == 1), worded).when(user, answer).otherwise(configure)
    odd = F.floor(F.col("seq") / 2) % 2 == 1
    kind = F.col("n") % 4
    before, after = F.array(name(-2)), F.array(name(2))
    depends = F.when(kind == 0, before).when(kind == 1, after).when(kind == 2, F.when(odd, before).otherwise(after))
    depends = depends.otherwise(F.concat(F.when(odd, F.array().cast("array<string>")).otherwise(after), F.array(F.lit("gone"))))
    calls = turns.where("role in ('user', 'system')").select(
        "conv_id", "seq", name(0).alias("call_id"), F.when(every(13), "ask").when(user, "answer").otherwise("configure").alias("name"), arguments.alias("arguments"),
        F.when(user, depends).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    return calls, turns.where("role = 'assistant'").select("conv_id", "seq", name(-1).alias("call_id"), F.col("text").alias("content"))


def conversation_tools(spark: SparkSession) -> DataFrame:
    """Schemas of the two tools of ``derive_calls``."""
    rows = [
        ("answer", "query", "string", True, 25, None, None, None), ("answer", "turn", "integer", True, None, 0.0, None, None), ("answer", "style", "string", False, None, None, None, ["short", "long"]),
        ("configure", "instructions", "string", True, 1, None, None, None), ("configure", "temperature", "number", True, None, 0.0, 1.0, None),
    ]
    return spark.createDataFrame(rows, PARAMS)


def _violations(args: Column, tool: Column) -> Column:
    kind = lambda k: F.schema_of_variant(args[k])
    names = F.transform(tool, lambda p: p["param"])
    has = lambda p: F.map_contains_key(args, p["param"])
    fits = lambda p: reduce(or_, ((p["type"] == t) & kind(p["param"]).rlike(f"^({x})$") for t, x in TYPES.items()))
    text = lambda p: F.try_variant_get(args[p["param"]], "$", "string")
    number = lambda p: F.try_variant_get(args[p["param"]], "$", "double")
    rules = {
        "missing": lambda p: p["required"] & ~has(p),
        "type": lambda p: has(p) & ~fits(p),
        "minLength": lambda p: has(p) & fits(p) & (F.length(text(p)) < p["min_length"]),
        "minimum": lambda p: has(p) & fits(p) & (number(p) < p["minimum"]),
        "maximum": lambda p: has(p) & fits(p) & (number(p) > p["maximum"]),
        "enum": lambda p: has(p) & fits(p) & p["allowed"].isNotNull() & ~F.array_contains(p["allowed"], text(p)),
    }

    def broken(rule: str, holds: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(tool, lambda p: F.coalesce(holds(p), F.lit(False))), lambda p: F.concat(F.lit(f"{rule}:"), p["param"]))

    found = [broken(rule, holds) for rule, holds in rules.items()]
    unknown = F.transform(F.filter(F.map_keys(args), lambda k: ~F.array_contains(names, k)), lambda k: F.concat(F.lit("unknown:"), k))
    return F.array_sort(F.concat(*found, unknown))


def validate(calls: DataFrame, params: DataFrame) -> DataFrame:
    """``calls`` with ``violations``, a sorted array of rule:parameter. Arguments that are
    no JSON object (or name a key twice) violate ``object:``, calls of unknown tools
    ``tool:``. ``params`` has the rows of PARAMS; it is joined by tool name, one row a tool."""
    tools = params.groupBy(F.col("name").alias("_tool")).agg(F.sort_array(F.collect_list(F.struct("param", "type", "required", "min_length", "minimum", "maximum", "allowed"))).alias("_params"))
    joined = calls.join(tools, F.col("name") == F.col("_tool"), "left")
    whole = F.try_parse_json("arguments")
    args = F.when(F.schema_of_variant(whole).startswith("OBJECT"), F.from_json("arguments", "map<string,variant>"))
    joined = joined.withColumn("_args", args)
    found = F.when(F.col("_args").isNull(), F.array(F.lit("object:"))).when(F.col("_params").isNull(), F.array(F.lit("tool:"))).otherwise(_violations(F.col("_args"), F.col("_params")))
    return joined.withColumn("violations", found).drop("_tool", "_params", "_args")


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """``calls`` with ``n_results`` and ``result``, the first result (by seq, then content)
    of the same conversation and identifier. Results are put together by identifier first,
    so repeated identifiers do not multiply rows."""
    by_id = results.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n_results"), F.min(F.struct("seq", "content")).alias("_first"))
    return calls.join(by_id, ["conv_id", "call_id"], "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)).cast("long")).withColumn("result", F.col("_first.content")).drop("_first")


def _follow(single: DataFrame) -> DataFrame:
    """``conv_id, call_id, end, top, steps, circle`` for calls ``(conv_id, call_id, dep,
    top)`` with one dependency each: the first call on their way that is not one of them, the
    largest ``top`` before it and the steps to it; or that the way goes round in a circle.
    Steps are doubled, so rounds grow with the logarithm of the calls in a conversation."""
    key, done = ["conv_id", "call_id"], []
    far = written(single.select(*key, F.col("dep").alias("end"), "top", F.lit(1).cast("long").alias("steps")))
    reach, most = 1, far.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    all_single = far.select("conv_id", F.col("call_id").alias("end"))
    while True:
        done.append(written(far.join(all_single, ["conv_id", "end"], "left_anti").withColumn("circle", F.lit(False))))
        far = written(far.join(all_single, ["conv_id", "end"], "left_semi"))
        if reach >= most or far.isEmpty():
            break
        # calls that have come to their end stay what others step to
        steps_to = reduce(DataFrame.unionByName, (d.drop("circle") for d in done), far)
        on = steps_to.select("conv_id", F.col("call_id").alias("end"), F.col("end").alias("_end"), F.col("top").alias("_top"), F.col("steps").alias("_steps"))
        far = written(far.join(on, ["conv_id", "end"]).select(*key, F.col("_end").alias("end"), F.greatest("top", "_top").alias("top"), (F.col("steps") + F.col("_steps")).alias("steps")))
        reach *= 2
    return written(reduce(DataFrame.unionByName, done, far.withColumn("circle", F.lit(True))))


def _split(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of calls with one dependency and of those with more."""
    counted = written(edges.join(edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("_n")), ["conv_id", "call_id"]))
    return counted.where("_n = 1").drop("_n"), counted.where("_n > 1").drop("_n")


def _links(many: DataFrame, ways: DataFrame) -> DataFrame:
    """``conv_id, call_id, end, top, steps, circle`` for each dependency of calls with
    several: where the way over it ends."""
    over = ways.select("conv_id", F.col("call_id").alias("dep"), F.col("end").alias("_end"), "top", "steps", "circle")
    return many.join(over, ["conv_id", "dep"], "left").select(
        "conv_id", "call_id", F.coalesce("_end", "dep").alias("end"), "top", (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), F.coalesce("circle", F.lit(False)).alias("circle")
    )


def _ready(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with ``ready`` raised to the largest of all they depend on, near or far."""
    key = ["conv_id", "call_id"]
    at_end = lambda df: df.select("conv_id", F.col("call_id").alias("end"), F.col("ready").alias("end_ready"))
    single, many = _split(edges)
    ways = _follow(single.join(nodes, key).select(*key, "dep", F.col("ready").alias("top")))
    links, rose = written(_links(many, ways)), not many.isEmpty()
    while rose:  # ready times run along the links of calls with several dependencies until none rises
        latest = links.join(at_end(nodes), ["conv_id", "end"]).groupBy(*key).agg(F.max(F.greatest("end_ready", "top")).alias("up"))
        nodes = written(nodes.join(latest, key, "left").select(*key, F.greatest("ready", "up").alias("ready"), (F.col("up") > F.col("ready")).alias("rose")))
        rose, nodes = not nodes.where("rose").isEmpty(), nodes.drop("rose")
    up = ways.join(at_end(nodes), ["conv_id", "end"]).select(*key, F.greatest("top", "end_ready").alias("up"))
    return written(nodes.join(up, key, "left").select(*key, F.greatest("ready", "up").alias("ready")))


def order(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, ready, level, cyclic)`` for each identifier.

    ``ready`` is the largest seq among the call and all it depends on, near or far;
    ``level`` counts steps back through calls that are ready at the same time. Sorting by
    (ready, level, seq, call_id) puts every call after its dependencies, and keeps the
    written order where that does so already. Dependencies on calls that are not there are
    passed over. Calls on a circle are ``cyclic`` and have level null (last), and so have
    those behind it that are ready at the same time; later ones come after it.
    Rounds grow with the logarithm of the longest chain, and beyond that with how many calls
    that have several dependencies follow on each other; without calls that are written too
    late there is none.
    """
    nodes = calls.groupBy("conv_id", "call_id").agg(F.min("seq").alias("ready"))
    edges = calls.select("conv_id", "call_id", F.explode("depends_on").alias("dep")).distinct()
    on = nodes.select("conv_id", F.col("call_id").alias("dep"), F.col("ready").alias("dep_ready"))
    edges = edges.join(on, ["conv_id", "dep"]).join(nodes, ["conv_id", "call_id"])
    late = written(edges.where("dep_ready >= ready").select("conv_id", "call_id", "dep"))
    nodes = written(nodes)
    if late.isEmpty():
        return nodes.select("conv_id", "call_id", "ready", F.lit(0).alias("level"), F.lit(False).alias("cyclic"))
    key, edges = ["conv_id", "call_id"], written(edges.select("conv_id", "call_id", "dep"))
    nodes = _ready(nodes, edges)
    as_dep = nodes.select("conv_id", F.col("call_id").alias("dep"), F.col("ready").alias("dep_ready"))
    single, many = _split(edges.join(as_dep, ["conv_id", "dep"]).join(nodes, key).where("dep_ready = ready").select(*key, "dep"))
    ways = _follow(single.withColumn("top", F.lit(None).cast("long")))
    left = written(_links(many, ways))
    branched = written(left.select(*key).distinct().withColumn("level", F.lit(None).cast("long")))
    while not left.isEmpty():  # then calls with several dependencies, when all of these have their level
        at_end = branched.select("conv_id", F.col("call_id").alias("end"), F.col("level").alias("end_level"), F.lit(True).alias("is_branched"))
        seen = left.join(at_end, ["conv_id", "end"], "left")
        waits = F.col("circle") | (F.col("is_branched").isNotNull() & F.col("end_level").isNull())
        found = written(seen.groupBy(*key).agg(F.max(waits).alias("waits"), F.max(F.col("steps") + F.coalesce("end_level", F.lit(0))).alias("found")).where("not waits").drop("waits"))
        if found.isEmpty():
            break
        branched = written(branched.join(found, key, "left").select(*key, F.coalesce("level", "found").alias("level")))
        left = written(left.join(found, key, "left_anti"))
    own = branched.select(*key, F.col("level").alias("own_level"), F.lit(True).alias("own"))
    at_end = branched.select("conv_id", F.col("call_id").alias("end"), F.col("level").alias("end_level"), F.lit(True).alias("is_branched"))
    joined = nodes.join(ways.drop("top"), key, "left").join(own, key, "left").join(at_end, ["conv_id", "end"], "left")
    level = F.when(F.col("own"), F.col("own_level")).when(F.col("end").isNull(), 0).when(F.col("circle"), None).when(F.col("is_branched"), F.col("steps") + F.col("end_level")).otherwise(F.col("steps"))
    return joined.select(*key, "ready", level.cast("int").alias("level"), level.isNull().alias("cyclic"))


def canonical_json(df: DataFrame, **fields: str | Column) -> Column:
    """One JSON object of the given fields (None: null), keys sorted."""
    return F.to_json(F.to_variant_object(F.struct(*((c if isinstance(c, Column) else F.col(c)).alias(k) for k, c in sorted(fields.items())))))


def format_calls(calls: DataFrame, results: DataFrame, params: DataFrame) -> DataFrame:
    """One row per row of ``calls``: ``conv_id, seq, call_id, name, ready, level, cyclic,
    n_results, violations, message``.

    ``calls`` has conv_id, seq, call_id, name, arguments (JSON text) and depends_on
    (identifiers); ``results`` has conv_id, seq, call_id and content. ``message`` is the
    canonical JSON of call and result; arguments that are no object are put in as text, a
    missing result is null. Null identifiers link to nothing. Results without a call have
    no row. Other columns are ignored; repeated calls stay repeated. Rows of a conversation
    are not gathered: sort by (conv_id, ready, level, seq, call_id) to read one.
    """
    calls = calls.select("conv_id", "seq", "call_id", "name", "arguments", "depends_on")
    ordered = order(calls)
    checked = validate(link(calls, results), params)
    joined = checked.join(ordered.withColumnRenamed("conv_id", "_conv").withColumnRenamed("call_id", "_call"), F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("call_id").eqNullSafe(F.col("_call")))
    is_object = ~F.array_contains("violations", "object:")
    arguments = F.when(is_object, F.try_parse_json("arguments")).otherwise(F.col("arguments").cast("variant"))
    message = canonical_json(joined, arguments=arguments, call_id="call_id", name="name", result="result", valid=F.size("violations") == 0)
    return joined.select("conv_id", "seq", "call_id", "name", "ready", "level", "cyclic", "n_results", "violations", message.alias("message"))
