"""Mixing sources to target weights by repeating documents.

Sizes are summed per source, targets follow from weights by water filling, and each
document is taken floor(rate) times plus once more where a seeded hash of its id falls
under the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwood.llm.common import WORD, written

#: Weights of the sources in order, over and over.
WEIGHTS = (5, 2, 1)


def sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, source, size)``: words of each text, 0 for a null one."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``(source, source_size, target, rate)`` for each source, null being one.

    Sources by code point, null last, get ``weights`` in turn and share all words by them.
    A source whose share is above ``most`` times its size stops there and the excess goes
    to the others by weight, until none is above. In order of size / weight the sources
    that stop are a prefix: each whose ``most * size`` is below its share of what the ones
    before it leave. Only one row a source is sorted here; sizes are summed map-side first.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    every = Window.partitionBy(F.lit(0))
    rest_size = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest_weight = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    stops = most * F.col("source_size") * F.col("rest_weight") <= F.col("weight") * F.col("rest_size")
    ranked = by_source.withColumn("weight", weight).withColumn("rest_size", rest_size).withColumn("rest_weight", rest_weight).withColumn("stops", stops)
    free = ~F.col("stops")
    share = F.col("weight") * F.max(F.when(free, F.col("rest_size"))).over(every) / F.max(F.when(free, F.col("rest_weight"))).over(every)
    target = F.when(F.col("stops"), (most * F.col("source_size")).cast("double")).otherwise(share)
    out = ranked.withColumn("target", target)
    return out.select("source", "source_size", "target", F.least(F.lit(float(most)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).alias("rate"))


def draw(id_col, seed: int):
    """A number in [0, 1) for each id: the first 8 hex digits of md5(seed:id)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def copies(rate, id_col, seed: int):
    """floor(rate), and one more with the fraction as its probability."""
    return (F.floor(rate) + F.when(draw(id_col, seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 2024) -> DataFrame:
    """``id, size, source_size, target, taken`` for each row; ``taken`` counts repeats.

    Null and empty texts have size 0. Rows that share an id are drawn alike; a null id is
    drawn as the word null. A source without words has target 0. Every text is read once.
    Sources join by hash, broadcast by Spark where they are few; a source that holds many
    rows is on the side that Spark can split.
    """
    sized = written(sizes(docs, id_col=id_col, text_col=text_col, source_col=source_col))
    by_source = written(targets(sized, weights=weights, most=most))
    joined = sized.alias("d").join(by_source.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies(F.col("rate"), F.col("id"), seed)).alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 2024) -> DataFrame:
    """The mixed documents: each row of ``docs``, all its columns, as many times as it is
    taken. Words are counted once, and the texts are then read again to be repeated."""
    by_source = written(targets(written(sizes(docs, id_col=id_col, text_col=text_col, source_col=source_col)), weights=weights, most=most))
    rates = by_source.select(F.col("source").alias("_mix_source"), F.col("rate").alias("_mix_rate"))
    joined = docs.join(rates, F.col(source_col).cast("string").eqNullSafe(F.col("_mix_source")))
    times = copies(F.col("_mix_rate"), F.col(id_col), seed).cast("int")
    return joined.select(*docs.columns, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))).alias("_mix_copy")).drop("_mix_copy")
