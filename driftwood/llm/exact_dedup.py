"""Exact duplicates by deterministic naming of blocks and of pairs of names.

Texts are cut into blocks of a fixed number of bytes. All distinct blocks, sorted by
(hash, content), are named by an integer pair: the hash and the content's rank among the
contents with that hash. Names of adjacent blocks are paired and the pairs named in the
same way until each text has one name. Two contents never share a name, because their
ranks differ; as good as always every rank is 0, which is proved on the distinct contents
of each level, and only where the proof fails are ranks looked up. So blocks of text are
shuffled once, without their repeats, and rows stay where they are.

Everything here is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.llm.common import written

_NAME = "array<struct<h:bigint,r:int>>"


def _rank_clashes(contents: DataFrame) -> DataFrame | None:
    """``(h, content, r)`` for the contents of every hash that several contents have, r
    from 0 in the order of contents; None if there are none."""
    distinct = contents.select("h", "content").distinct()
    shared = written(distinct.groupBy("h").count().where("count > 1").select("h"))
    if shared.isEmpty():
        return None
    ranked = contents.join(shared, "h", "left_semi").select("h", "content").distinct()
    return written(ranked.select("h", "content", (F.row_number().over(Window.partitionBy("h").orderBy("content")) - 1).alias("r")))


def _with_ranks(rows: DataFrame, names: str, contents: DataFrame, clashes: DataFrame) -> DataFrame:
    """``rows`` with the ranks of ``clashes`` put into the array column ``names``."""
    found = contents.join(clashes, ["h", "content"]).where("r > 0").select("rid", "at", F.col("r").alias("rank"))
    own = found.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("at", "rank"))).alias("ranks"))
    put = F.transform(names, lambda x, i: F.struct(x["h"].alias("h"), F.coalesce(F.col("ranks")[i], F.lit(0)).alias("r")))
    return rows.join(own, "rid", "left").withColumn(names, F.when(F.col("ranks").isNull(), F.col(names)).otherwise(put).cast(_NAME)).drop("ranks")


def name_texts(docs: DataFrame, *, id_col: str, text_col: str, block_bytes: int = 4096, digest: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """``(rid, id, sha, blocks, h, r)``: a text's name is (blocks, h, r). ``digest`` may
    clash as often as it likes; names stay free of collisions."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / block_bytes)).cast("int")
    cut = lambda i: F.substring(F.col("raw"), i * block_bytes + 1, F.lit(block_bytes))
    names = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(digest(cut(i)).cast("long").alias("h"), F.lit(0).alias("r")))
    keyed = rows.withColumn("blocks", blocks)
    level = written(keyed.select(F.monotonically_increasing_id().alias("rid"), "id", F.sha2("raw", 256).alias("sha"), "blocks", names.cast(_NAME).alias("names")))
    pieces = keyed.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), cut)).alias("content"))
    clashes = _rank_clashes(pieces.select(digest("content").cast("long").alias("h"), "content"))
    if clashes is not None:
        # the blocks again, with the row's number: texts are looked up by their digest
        whole = rows.withColumn("sha", F.sha2("raw", 256)).dropDuplicates(["sha"]).withColumn("blocks", blocks)
        at = whole.select("sha", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), cut)).alias("at", "content"))
        at = at.select("sha", "at", digest("content").cast("long").alias("h"), "content").join(clashes, ["h", "content"]).where("r > 0").select("sha", "at", F.col("r").alias("rank"))
        own = at.groupBy("sha").agg(F.map_from_entries(F.collect_list(F.struct("at", "rank"))).alias("ranks"))
        put = F.transform("names", lambda x, i: F.struct(x["h"].alias("h"), F.coalesce(F.col("ranks")[i], F.lit(0)).alias("r")))
        level = written(level.join(own, "sha", "left").select("rid", "id", "sha", "blocks", F.when(F.col("ranks").isNull(), F.col("names")).otherwise(put).cast(_NAME).alias("names")))
    most = level.agg(F.max("blocks")).first()[0] or 1
    while most > 1:
        last = F.struct(F.lit(0).cast("long").alias("h"), F.lit(-1).alias("r"))  # no name has rank -1
        pair = lambda i: F.struct(F.col("names")[2 * i].alias("a"), F.coalesce(F.get("names", 2 * i + 1), last).alias("b"))
        half = F.transform(F.sequence(F.lit(0), F.ceil(F.size("names") / 2).cast("int") - 1), pair)
        paired = level.withColumn("pairs", half)
        upper = F.transform("pairs", lambda p: F.struct(digest(p["a"]["h"], p["a"]["r"], p["b"]["h"], p["b"]["r"]).cast("long").alias("h"), F.lit(0).alias("r")))
        several = F.size("names") > 1
        contents = paired.where(several).select("rid", F.posexplode("pairs").alias("at", "content"))
        contents = contents.select("rid", "at", digest("content.a.h", "content.a.r", "content.b.h", "content.b.r").cast("long").alias("h"), "content")
        clashes = _rank_clashes(contents)
        level = paired.withColumn("names", F.when(several, upper).otherwise(F.col("names")).cast(_NAME)).drop("pairs")
        level = written(level if clashes is None else _with_ranks(level, "names", contents, clashes))
        most = (most + 1) // 2
    return level.select("rid", "id", "sha", "blocks", F.col("names")[0]["h"].alias("h"), F.col("names")[0]["r"].alias("r"))


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, digest: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``.

    Texts are equal when their bytes are; a null text equals an empty one. The row with the
    largest id stays (``keep_id`` is null if no row of the group has one); of several rows
    with that id, the first as numbered in reading order. Other columns are ignored; an
    empty table gives an empty result. Groups are counted map-side first and written, and
    only those of two rows or more are joined back: both sides of that join then come
    straight from a shuffle, so Spark can split a group that holds many rows.
    """
    named = name_texts(docs, id_col=id_col, text_col=text_col, block_bytes=block_bytes, digest=digest)
    best = F.max(F.struct("id", (-F.col("rid")).alias("first")))
    groups = named.groupBy("blocks", "h", "r").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    out = named.join(written(groups), ["blocks", "h", "r"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("rid") == -F.col("best.first"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )
