"""Numbers, running sums and greedy cuts along an order, at any size.

Rows are dealt into ranges of their order. Each task works within its range, and a small
table of the ranges' totals (one row a range) gives what went before. No window goes over
all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.sources.shared import checkpointed

RANGE = "_range"
#: Bits of a row's place in its range where range and place are one number.
_PLACE_BITS = 40


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with the number of its range; it is written, so numbers do not change."""
    return checkpointed(df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()))


def _same(a: str, b: str, columns: list[str]) -> Column:
    return reduce(and_, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns))


def running(ranged: DataFrame, order: list[Column], by: list[str] = [], *, sums: dict[str, Column] = {}, largest: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    """Rows of ``in_ranges`` (over ``by`` and ``order``) with running sums and maxima up to
    and with each row, within ``by``."""
    keys = [*by, RANGE]
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys).agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()), *(F.max(c).alias(f"_t_{n}") for n, c in largest.items()))
    before = totals.select(*keys, *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums), *(F.max(f"_t_{n}").over(earlier).alias(f"_b_{n}") for n in largest))
    within = ranged.select("*", *(F.sum(c).over(own).alias(f"_o_{n}") for n, c in sums.items()), *(F.max(c).over(own).alias(f"_o_{n}") for n, c in largest.items()))
    both = within.alias("w").join(before.alias("b"), _same("w", "b", keys))
    return both.select("w.*", *(f"b._b_{n}" for n in [*sums, *largest])).select(
        *ranged.columns, *((F.col(f"_o_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums), *(F.greatest(f"_o_{n}", f"_b_{n}").alias(n) for n in largest)
    )


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``df`` with the place of each row in a total order, from ``start`` on."""
    ranged = in_ranges(df, [*map(F.col, by), *order])
    return running(ranged, order, by, sums={name: F.lit(1)}).withColumn(name, (F.col(name) + (start - 1)).cast("long")).drop(RANGE)


def _in_order(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows of ``in_ranges`` by ``(by, range)``, each with its place ``_i`` in its range, from
    1 on, standing in that order."""
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by, RANGE).orderBy(order)).cast("long"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of ``_in_order`` in tables of whole ranges, and where in these each begins
    (and the end)."""
    held, seen = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.column("_i").to_numpy()
        if not ((i == 1) | (i == np.concatenate(([seen], i[:-1])) + 1)).all():
            raise ValueError("the rows do not stand in order")
        seen, firsts = i[-1], np.flatnonzero(i == 1)
        if len(firsts) and (held or firsts[-1]):
            yield _cut([*held, batch.slice(0, firsts[-1])])
            held, batch = [], batch.slice(firsts[-1])
        held.append(batch)
    if held:
        yield _cut(held)


def _cut(batches: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches([b for b in batches if b.num_rows])
    return table, np.append(np.flatnonzero(table.column("_i").to_numpy() == 1), table.num_rows)


def _with(table: pa.Table, more: dict[str, np.ndarray]) -> list[pa.RecordBatch]:
    for name, values in more.items():
        table = table.append_column(name, pa.array(values))
    return table.to_batches()


def _next_starts(size: np.ndarray, bounds: np.ndarray, target: int, past: bool) -> tuple[np.ndarray, ...]:
    """For rows of whole ranges: (``value``, ``begun``, ``following``). A group that begins at
    row i is followed by the first row whose value reaches begun[i] + target, one that comes
    after i; if it is in the same range that is row following[i], else the range's end."""
    upto = np.cumsum(size)
    begun = upto - size
    value = upto - 1 if past else begun
    rows = np.arange(len(size))
    following = np.maximum(np.searchsorted(value, begun + target, "left"), rows + 1)
    return value, begun, np.minimum(following, np.repeat(bounds[1:], np.diff(bounds)))


def greedy_groups(items: DataFrame, by: list[str], order: str, size: str, target: int, *, past: bool) -> DataFrame:
    """``items`` with ``group_no`` (from 0 within ``by``): neighbours in order, whose sum
    starts anew with each group.

    With ``past`` a group ends before the item that would take it above ``target`` (an item
    above it is alone); else it ends with the item that makes it reach ``target``. Sizes are
    whole numbers, not negative; order is unique within ``by``; target is above 0.

    Each range of the order is gone through on its own, once to learn where the groups lead
    that begin at its first row or at one within ``target`` of it (no other row can be the
    first beginning in it), and once more to number the groups when the right one of those is
    known. From range to range it is found by search in the running sums of these rows alone,
    doubling the steps, in as many rounds as the number of ranges has bits. Ranges that hold
    less than ``target`` send all their rows to that search.
    """
    rows = items.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    ranged = in_ranges(rows, [*map(F.col, by), F.col(order)])
    keys, columns, node = [*by, RANGE], items.columns, lambda r, i: F.shiftleft(F.col(r).cast("long"), _PLACE_BITS) + i
    longs = lambda fields, names: T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in names)])

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows at which a range's first group can begin, with their value, what comes
        before the last group that begins in the range then, and how many do."""
        for table, bounds in _segments(batches):
            value, begun, following = _next_starts(table.column("_size").to_numpy(), bounds, target, past)
            first, ends = (np.repeat(b, np.diff(bounds)) for b in (bounds[:-1], bounds[1:]))
            rows, base, before = np.arange(len(value)), begun[first], np.concatenate(([0], value[:-1]))
            at = rows[(rows == first) | ((before - base < target) & (value > before))]
            last, starts = at.copy(), np.ones(len(at), np.int64)
            on = np.flatnonzero(following[last] < ends[last])
            while len(on):
                last[on] = following[last[on]]
                starts[on] += 1
                on = on[following[last[on]] < ends[last[on]]]
            yield from _with(table.select([*keys, "_i"]).take(at), {"_value": (value - base)[at], "_begun": begun[last] - base[at], "_starts": starts})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _segments(batches):
            following = _next_starts(table.column("_size").to_numpy(), bounds, target, past)[2]
            entry, before = table.column("_entry").to_numpy(), table.column("_before").to_numpy()
            numbers = np.zeros(table.num_rows, np.int64)
            for lo, hi in zip(bounds.tolist(), bounds[1:].tolist()):
                row = lo + int(entry[lo]) - 1 if entry[lo] else hi
                while row < hi:
                    numbers[row] = 1
                    row = int(following[row])
                numbers[lo:hi] = np.cumsum(numbers[lo:hi]) + (before[lo] - 1)
            yield from _with(table.select(columns), {"group_no": numbers})

    slim = _in_order(ranged.select(*dict.fromkeys([*keys, order, "_size"])), by, order).select(*keys, "_i", "_size")
    leads = checkpointed(slim.mapInArrow(lead, longs([ranged.schema[k] for k in keys], ["_i", "_value", "_begun", "_starts"])))
    along = Window.partitionBy(*by).orderBy(RANGE)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys).agg(F.sum("_size").alias("_total"))
    totals = checkpointed(totals.select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"), F.lead(RANGE).over(along).alias("_next")))
    # from each of those rows to the first row that can follow in a later range
    nodes = leads.alias("l").join(totals.alias("t"), _same("l", "t", keys)).select(
        *(F.col(f"l.{k}").alias(k) for k in by), node(f"l.{RANGE}", F.col("l._i")).alias("_n"), node("t._next", 1).alias("_next"),
        (F.col("_base") + F.col("_value")).alias("_at"), (F.col("_base") + F.col("_begun") + target).alias("_wanted"),
    )
    nodes, none = checkpointed(nodes), F.lit(None).cast("long")
    both = nodes.select(*by, "_at", F.col("_n").alias("_row"), none.alias("_from"), none.alias("_next")).unionByName(nodes.select(*by, F.col("_wanted").alias("_at"), none.alias("_row"), F.col("_n").alias("_from"), "_next"))
    both = both.withColumn("_bucket", F.floor(F.col("_at") / target).cast("long"))
    # in falling order, the rows that come before a wanted value reach it
    falling = Window.partitionBy(*by, "_bucket").orderBy(F.desc("_at"), F.col("_row").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*by).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = both.groupBy(*by, "_bucket").agg(F.min("_row").alias("_first"))
    firsts = firsts.withColumn("_next_first", F.min("_first").over(later)).drop("_first")
    found = both.withColumn("_hit", F.min("_row").over(falling)).where("_from is not null").alias("w").join(firsts.alias("b"), _same("w", "b", [*by, "_bucket"]))
    hit = F.coalesce(F.col("w._hit"), F.col("b._next_first"))
    step = F.when(hit.isNotNull() & F.col("w._next").isNotNull(), F.greatest(hit, F.col("w._next")))
    jump = checkpointed(found.select(*(F.col(f"w.{c}").alias(c) for c in by), F.col("w._from").alias("_n"), step.alias("_to")).where("_to is not null"))
    starts = totals.groupBy(*by).agg(F.min(RANGE).alias(RANGE)).select(*by, node(RANGE, 1).alias("_n"))
    while True:
        fresh = starts.alias("s").join(jump.alias("j"), _same("s", "j", [*by, "_n"])).select(*(F.col(f"j.{c}").alias(c) for c in by), F.col("j._to").alias("_n"))
        fresh = checkpointed(fresh)
        if fresh.isEmpty():
            break
        starts = starts.unionByName(fresh)
        far = jump.alias("a").join(jump.alias("c"), reduce(and_, [*(F.col(f"a.{k}").eqNullSafe(F.col(f"c.{k}")) for k in by), F.col("a._to") == F.col("c._n")]))
        jump = checkpointed(far.select(*(F.col(f"a.{k}").alias(k) for k in by), F.col("a._n").alias("_n"), F.col("c._to").alias("_to")))
    entries = starts.select(*by, F.shiftright("_n", _PLACE_BITS).cast("int").alias(RANGE), F.col("_n").bitwiseAND((1 << _PLACE_BITS) - 1).alias("_i"))
    entries = entries.alias("e").join(leads.alias("l"), _same("e", "l", [*keys, "_i"])).select(*(F.col(f"l.{k}").alias(k) for k in [*keys, "_i", "_starts"]))
    per_range = totals.alias("t").join(entries.alias("e"), _same("t", "e", keys), "left").select(*(F.col(f"t.{k}").alias(k) for k in keys), F.coalesce("e._i", F.lit(0)).alias("_entry"), F.coalesce("e._starts", F.lit(0)).alias("_starts"))
    per_range = checkpointed(per_range.select(*keys, "_entry", F.coalesce(F.sum("_starts").over(earlier), F.lit(0)).alias("_before")))
    whole = ranged.alias("w").join(per_range.alias("p"), _same("w", "p", keys)).select("w.*", "p._entry", "p._before")
    return _in_order(whole, by, order).mapInArrow(number, longs(items.schema.fields, ["group_no"]))
