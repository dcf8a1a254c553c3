"""Hash routes, shards, validity windows.

A route is a number in [0, 1) computed from a key. Shards own half-open ranges [a, b) of it
and windows are half-open times [s, e). Tables of shards and windows are configuration, so
joins with them are range joins against a small side; ``buckets`` turns a range join into
an equi-join where that side is large.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.operators.ranges import RANGE, in_ranges, numbered, running

# Fixed value: marks a key that names its own route, as _<number> right behind it.
VARIABLE_SHARD = "VARIABLE_SHARD_f0234jfah08fgyhfgyssdds83nmp"
#: So many entries of a configuration are compared with a probe in one expression.
ENTRY_BLOCK = 4096


def named_route(key: Column) -> Column:
    """The number that follows the first sentinel of a key, or null."""
    at = F.instr(key, VARIABLE_SHARD)
    named = F.regexp_extract(F.substring(key, at + len(VARIABLE_SHARD), F.length(key)), r"^_([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when((at > 0) & (named != ""), named.cast("double"))


def route(key: Column) -> Column:
    """The key's route: its own number if it names one, else 12 hex digits of its SHA-256,
    modulo 10**9, over 10**9."""
    text = key.cast("string")
    hashed = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 12), 16, 10).cast("long") % 1000000000 / F.lit(1e9)
    return F.coalesce(named_route(text), hashed)


def in_routes(key: Column, routes: list[tuple[float, float]] | None) -> Column:
    """Whether the key's route is in one of the half-open ranges; None is everything."""
    if routes is None:
        return F.lit(True)
    at = route(key)
    return reduce(or_, ((at >= a) & (at < b) for a, b in routes), F.lit(False))


def shard_key(key: Column, a: Column, b: Column, ident: Column) -> Column:
    """A key that names a route inside [a, b), drawn from ``ident``."""
    drawn = F.pmod(F.xxhash64(ident), F.lit(1 << 30)) / F.lit(float(1 << 30))
    at = F.greatest(a, F.floor((a + drawn * (b - a)) * 1e12) / 1e12)
    return F.concat(key, F.lit(VARIABLE_SHARD + "_"), F.format_string("%.12f", at))


def to_shards(keys: DataFrame, shards: DataFrame, route_col: str, buckets: int = 0) -> DataFrame:
    """Keys joined with the shards ``(a, b, ...)`` that own their route."""
    inside = (F.col(route_col) >= F.col("a")) & (F.col(route_col) < F.col("b"))
    if not buckets:
        return keys.join(shards, inside)
    own = shards.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("a") * buckets), F.floor(F.col("b") * buckets))))
    return keys.withColumn("_bucket", F.floor(F.col(route_col) * buckets)).join(own, "_bucket").where(inside).drop("_bucket")


def islands(windows: DataFrame, start: str, end: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``windows`` with ``island``, a number for each run of windows that overlap or touch."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = windows.withColumn("_reach", reach).withColumn("_new", F.when(F.col("_reach") >= F.col(start), 0).otherwise(1))
    return marked.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_reach", "_new")


def coverage(routes: DataFrame, a: str = "a", b: str = "b", by: list[str] = []) -> DataFrame:  # noqa: B006
    """How far [0, 1) is covered from 0 without a gap: ``covered`` for each group."""
    found = islands(routes, a, b, by)
    reach = found.groupBy(*by, "island").agg(F.min(a).alias("_a"), F.max(b).alias("_b"))
    return reach.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("_a") <= 0, F.col("_b"))), F.lit(0.0)).alias("covered"))


def conflicts(windows: DataFrame, identity: str, start: str, end: str) -> DataFrame:
    """Windows of one identity that begin before an earlier one ends."""
    order = Window.partitionBy(identity).orderBy(start, end)
    return windows.withColumn("_reach", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("_reach") > F.col(start)).drop("_reach")


def _best_entry(probes: DataFrame, entries: DataFrame, columns: list[str], rank: Callable[[Column], Column]) -> DataFrame:
    """``probes`` with the ``entry`` of the least ``rank(entry struct)``.

    The entries travel as one array that Spark computes once, so probes are neither joined
    nor shuffled. Entries are configuration; more than ENTRY_BLOCK of them are taken in
    blocks, the best of which counts."""
    ordered = entries.select(F.struct("entry", *columns).alias("x")).withColumn("block", F.floor((F.row_number().over(Window.orderBy("x")) - 1) / ENTRY_BLOCK))
    blocks = max(1, -(-entries.count() // ENTRY_BLOCK))
    best = []
    for block in range(blocks):
        known = ordered.where(F.col("block") == block).agg(F.collect_list("x").alias("x")).scalar()
        probes = probes.withColumn(f"_known{block}", known)
        best.append(F.array_min(F.transform(f"_known{block}", lambda x: F.struct(rank(x).alias("r"), x["entry"].alias("entry")))))
    found = probes.withColumn("entry", (F.least(*best) if blocks > 1 else best[0])["entry"])
    return found.drop(*(f"_known{block}" for block in range(blocks)))


def pick_entry(probes: DataFrame, entries: DataFrame, time: str, route_col: str | None = None) -> DataFrame:
    """``probes`` with the ``entry`` (of entry, s, e[, a, b]) whose window holds its time,
    else the nearest one; entries that cover the probe's route come before all others, the
    first entry wins ties."""
    t = F.col(time)

    def rank(x: Column) -> Column:
        inside = (t >= x["s"]) & (t < x["e"])
        apart = F.when(inside, 0).otherwise(F.least(F.abs(t - x["s"]), F.abs(t - x["e"])))
        covers = F.when((F.col(route_col) >= x["a"]) & (F.col(route_col) < x["b"]), 0).otherwise(1) if route_col else F.lit(0)
        return F.struct(covers.alias("c"), F.when(inside, 0).otherwise(1).alias("i"), apart.alias("d"))

    return _best_entry(probes, entries, ["s", "e", *(["a", "b"] if route_col else [])], rank)


def current_entry(probes: DataFrame, entries: DataFrame, time: str) -> DataFrame:
    """``probes`` with the entry whose window holds the time, else the next to begin, else
    the last to end."""
    t = F.col(time)

    def rank(x: Column) -> Column:
        inside, ahead = (t >= x["s"]) & (t < x["e"]), x["s"] > t
        return F.struct(F.when(inside, 0).when(ahead, 1).otherwise(2).alias("k"), F.when(inside, 0).when(ahead, x["s"]).otherwise(-x["e"]).cast("double").alias("d"))

    return _best_entry(probes, entries, ["s", "e"], rank)


def intersections(left: DataFrame, right: DataFrame) -> DataFrame:
    """``id, other, a, b``: the parts that ranges ``(id, a, b)`` share with ``(other, a, b)``."""
    l, r = left.alias("l"), right.alias("r")  # noqa: E741
    return l.join(r, (F.col("l.a") < F.col("r.b")) & (F.col("r.a") < F.col("l.b"))).select(F.col("l.id"), F.col("r.other"), F.greatest("l.a", "r.a").alias("a"), F.least("l.b", "r.b").alias("b"))


def subtract(ranges: DataFrame, holes: DataFrame) -> DataFrame:
    """``id, a, b``: what is left of each range ``(id, a, b)`` without all ``holes (a, b)``:
    the gaps between the holes that overlap it."""
    h = holes.select(F.col("a").alias("ha"), F.col("b").alias("hb"))
    met = ranges.join(h, (F.col("a") < F.col("hb")) & (F.col("ha") < F.col("b")), "left").where("ha is null or ha < hb")
    edges = met.groupBy("id", "a", "b").agg(F.array_sort(F.collect_list(F.struct("ha", "hb"))).alias("_h"))
    order = Window.partitionBy("id", "a", "b").orderBy("ha", "hb")
    cut = met.withColumn("_from", F.greatest(F.col("a"), F.coalesce(F.max("hb").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("a"))))
    gaps = cut.select("id", F.col("_from").alias("a"), F.coalesce(F.least("ha", "b"), "b").alias("b"))
    last = edges.select("id", F.greatest(F.col("a"), F.coalesce(F.array_max(F.transform("_h", lambda x: x["hb"])), F.col("b"))).alias("a"), "b")
    return gaps.unionByName(last).where("a < b").distinct()


def handover(entries: DataFrame, at: str = "s") -> DataFrame:
    """Who owned each slice of a window's route just before the window begins.

    ``entries``: ``entry`` (order of configuration), ``store``, s, e, a, b. The slices are cut
    at all route ends; the owner is the first entry by configuration whose window reaches
    the beginning from before. Neighbouring slices with one owner are put together again.
    """
    w = entries.select(F.col("entry").alias("window"), F.col(at).alias("t"), F.col("a").alias("wa"), F.col("b").alias("wb"))
    old = entries.select("entry", "store", "s", "e", "a", "b")
    met = w.join(old, (F.col("s") < F.col("t")) & (F.col("e") >= F.col("t")) & (F.col("a") < F.col("wb")) & (F.col("wa") < F.col("b")))
    points = met.select("window", "t", F.explode(F.array(F.greatest("a", "wa"), F.least("b", "wb"))).alias("p")).distinct()
    slices = points.withColumn("q", F.lead("p").over(Window.partitionBy("window").orderBy("p"))).where("q is not null")
    owned = slices.join(met.select("window", "entry", "store", "a", "b"), "window").where("a <= p and b >= q").groupBy("window", "p", "q").agg(F.min_by("store", "entry").alias("owner"))
    return islands_by_owner(owned)


def islands_by_owner(slices: DataFrame) -> DataFrame:
    """``window, owner, a, b``: slices (window, p, q, owner) that touch and share an owner, as one."""
    order = Window.partitionBy("window").orderBy("p")
    fresh = F.when((F.lag("q").over(order) == F.col("p")) & (F.lag("owner").over(order) == F.col("owner")), 0).otherwise(1)
    return slices.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(order)).groupBy("window", "owner", "_run").agg(F.min("p").alias("a"), F.max("q").alias("b")).drop("_run")


def inject_window(windows: DataFrame, s, e) -> DataFrame:
    """Windows ``(id, s, e)`` with [s, e) taken out, split where it lies inside, and a row
    ``intermediate`` for it."""
    pieces = F.array(F.struct(F.col("s").alias("s"), F.least("e", F.lit(s)).alias("e")), F.struct(F.greatest("s", F.lit(e)).alias("s"), F.col("e").alias("e")))
    left = windows.select("id", F.explode(pieces).alias("p")).select("id", "p.s", "p.e").where("s < e").withColumn("kind", F.lit("kept"))
    fresh = windows.sparkSession.range(1).select(F.lit(None).cast(windows.schema["id"].dataType).alias("id"), F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit("intermediate").alias("kind"))
    return left.unionByName(fresh)


def rejoin_windows(windows: DataFrame) -> DataFrame:
    """Pieces ``(id, s, e)`` of one id that touch again, as one window."""
    cut = islands(windows, "s", "e", ["id"])
    return cut.groupBy("id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def accepts_writes(windows: Column, now: Column) -> Column:
    """Whether one of an array of windows {s, e} is not over; windows to come accept too."""
    return F.exists(windows, lambda w: w["e"] > now)


def write_targets(sources: DataFrame) -> DataFrame:
    """Of ``(route_id, config_order, latency, url)`` the first writable source of each route
    by configuration, ordered by latency with ``rank``."""
    first = sources.groupBy("route_id").agg(F.min_by(F.struct("config_order", "latency", "url"), "config_order").alias("_f")).select("route_id", "_f.*")
    return numbered(first, [F.col("latency"), F.col("route_id")], "rank", 1)


def source_order(sources: DataFrame, now=None) -> DataFrame:
    """``file, urls`` of sources ``(file, config_order, latency, url, public, s, e, covers)``
    that may serve a file: public ones (null: public) that cover its route and whose window
    holds ``now``. The first of these by configuration, which takes the writes, leads; the
    others follow by latency; none comes twice."""
    able = sources.where(F.coalesce("public", F.lit(True)) & F.col("covers"))
    able = able if now is None else able.where((F.col("s") <= F.lit(now)) & (F.col("e") > F.lit(now)))
    listed = able.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("config_order", "latency", "url"))).alias("_by_config"))
    rest = F.array_sort(F.transform(F.slice(F.col("_by_config"), F.lit(2), F.size("_by_config")), lambda x: F.struct(x["latency"], x["config_order"], x["url"])))
    urls = F.concat(F.array(F.col("_by_config")[0]["url"]), F.transform(rest, lambda x: x["url"]))
    return listed.select("file", F.array_distinct(urls).alias("urls"))


def cover_routes(sources: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Sources ``(source, a, b, latency)`` that are needed to cover [0, 1): from the point
    reached so far always the one that reaches furthest, the quicker one of equals. A fold
    over the sorted sources of a configuration, which is small by nature."""
    items = sources.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("a", (-F.col("b")).alias("nb"), "latency", "source"))).alias("items"))
    zero = F.struct(F.lit(0.0).alias("at"), F.array().cast("array<string>").alias("out"))

    def pick(acc: Column, _: Column) -> Column:
        able = F.filter("items", lambda x: (x["a"] <= acc["at"]) & (-x["nb"] > acc["at"]))
        best = F.array_min(F.transform(able, lambda x: F.struct(x["nb"].alias("nb"), x["latency"].alias("l"), x["source"].alias("s"))))
        return F.when((F.size(able) == 0) | (acc["at"] >= 1), acc).otherwise(F.struct((-best["nb"]).alias("at"), F.concat(acc["out"], F.array(best["s"])).alias("out")))

    return items.select(*by, F.aggregate("items", zero, pick).alias("r")).select(*by, F.col("r.at").alias("covered"), F.col("r.out").alias("sources"))


def unique_times(rows: DataFrame, time: str, order: list[str]) -> DataFrame:
    """``rows`` with ``stamp``: the smallest strictly increasing times that are not below
    ``time``, in the given (total) order."""
    by = [F.col(c) for c in order]
    placed = running(in_ranges(rows, by), by, sums={"_n": F.lit(1)})
    return running(placed, by, largest={"_top": F.col(time) - F.col("_n")}).withColumn("stamp", F.col("_top") + F.col("_n")).drop("_n", "_top", RANGE)


def choose_config(configs: DataFrame, by: list[str]) -> DataFrame:
    """The newest version of each group (a missing version counts as -1); of equal versions
    the stored one; of those the one whose other columns are smallest. Versions are whole
    numbers."""
    rest = [c for c in configs.columns if c not in by]
    others = [c for c in rest if c not in ("version", "is_stored")]
    # a number's bits turned over sort it the other way round, for the least number too
    newest = F.bitwise_not(F.coalesce("version", F.lit(-1)))
    best = F.min_by(F.struct(*rest), F.struct(newest, F.coalesce(~F.col("is_stored"), F.lit(True)), *others))
    return configs.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def config_problems(sources: DataFrame) -> DataFrame:
    """``problem, name`` for a configuration ``(name, store, immutable, s, e, a, b)``: a time
    at which the routes leave a gap, one store under two overlapping windows, one name with
    both kinds of immutability."""
    spans = islands(sources, "s", "e")
    gaps = coverage(spans.select(F.col("island").alias("g"), "a", "b"), by=["g"]).where("covered < 1").select(F.lit("coverage").alias("problem"), F.col("g").cast("string").alias("name"))
    twice = conflicts(sources, "store", "s", "e").select(F.lit("overlap").alias("problem"), F.col("store").alias("name")).distinct()
    mixed = sources.groupBy("name").agg(F.count_distinct("immutable").alias("n")).where("n > 1").select(F.lit("immutable").alias("problem"), "name")
    return gaps.unionByName(twice).unionByName(mixed)
