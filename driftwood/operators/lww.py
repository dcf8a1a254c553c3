"""Per-column last-write-wins over a mutation log, with tombstones.

The whole merge is one aggregation by key: the newest set value of every column, the newest
write and the newest delete. Spark combines it map-side, so a key with any number of
changes sends one row a task through the shuffle. Ties in time go to the larger seq; a
delete wins over writes of the same time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.model import META, value_columns


def _merged(log: DataFrame, columns: list[str]) -> DataFrame:
    wrote = F.col("op") == "write"
    at = F.struct("time", "seq")
    aggs = [F.max(F.when(~wrote, F.col("time"))).alias("_deleted"), F.max(F.when(wrote, at)).alias("_wrote")]
    for c in columns:
        sets = wrote & F.array_contains("set_cols", c)
        aggs.append(F.max_by(F.struct("time", "seq", F.col(c).alias("v")), F.when(sets, at)).alias(f"_c_{c}"))
    return log.groupBy("key").agg(*aggs)


def resolve(log: DataFrame, columns: list[str] | None = None, times: bool = False) -> DataFrame:
    """``key``, ``time`` of the newest write and the value of each column, for live keys.

    A key is live if its newest write is later than its newest delete. A value written at
    or before the delete is gone, whatever is written later. ``times`` adds ``<column>_time``
    and ``<column>_set``.
    """
    columns = value_columns(log) if columns is None else columns
    merged = _merged(log, columns).where("_wrote is not null and (_deleted is null or _wrote.time > _deleted)")
    out = [F.col("key"), F.col("_wrote.time").alias("time")]
    for c in columns:
        stands = F.col(f"_c_{c}").isNotNull() & (F.col("_deleted").isNull() | (F.col(f"_c_{c}.time") > F.col("_deleted")))
        out.append(F.when(stands, F.col(f"_c_{c}.v")).alias(c))
        if times:
            out += [F.when(stands, F.col(f"_c_{c}.time")).alias(f"{c}_time"), F.when(stands, F.col(f"_c_{c}.seq")).alias(f"{c}_seq"), stands.alias(f"{c}_set")]
    return merged.select(*out)


def get_column(log: DataFrame, column: str) -> DataFrame:
    """``key, value, time`` for every live key; time is that of the value where one is set."""
    found = resolve(log, [column], times=True)
    return found.select("key", F.col(column).alias("value"), F.coalesce(f"{column}_time", "time").alias("time"))


def get_row(log: DataFrame, key) -> DataFrame:
    return resolve(log.where(F.col("key") == F.lit(key)))


def get_single_field(log: DataFrame, key, column: str) -> DataFrame:
    """The one cell, or no row if the key is not live. The key filter goes below the
    aggregation and into the scan."""
    return get_column(log.where(F.col("key") == F.lit(key)), column)


def live_keys(log: DataFrame) -> DataFrame:
    return resolve(log, []).select("key")


def deleted_keys(log: DataFrame) -> DataFrame:
    """``key, delete_time`` of the keys whose newest delete is not older than any write."""
    return _merged(log, []).where("_deleted is not null and (_wrote is null or _wrote.time <= _deleted)").select("key", F.col("_deleted").alias("delete_time"))


def reader_cells(log: DataFrame, source_col: str, column: str) -> DataFrame:
    """Like ``get_column``, with the older rule that all cells of a key in one source bear
    the time of the key's newest write there (mode 'reader')."""
    wrote = F.col("op") == "write"
    by_source = log.where(wrote).groupBy("key", source_col).agg(F.max(F.struct("time", "seq")).alias("at"), F.max_by(F.struct(F.col(column).alias("v")), F.when(F.array_contains("set_cols", column), F.struct("time", "seq"))).alias("cell"))
    gone = log.where(~wrote).groupBy("key").agg(F.max("time").alias("dead"))
    best = by_source.groupBy("key").agg(F.max("at").alias("newest"), F.max_by(F.struct("cell", "at"), F.when(F.col("cell").isNotNull(), F.col("at"))).alias("best"))
    return best.join(gone, "key", "left").where("dead is null or newest.time > dead").select("key", F.when(F.col("dead").isNull() | (F.col("best.at.time") > F.col("dead")), F.col("best.cell.v")).alias("value"), F.coalesce("best.at.time", "newest.time").alias("time"))


def update_existing(log: DataFrame, updates: DataFrame) -> DataFrame:
    """Of the mutation rows ``updates`` those whose key is live in ``log``; others are void."""
    return updates.join(live_keys(log), "key", "left_semi")


def overlay_patch(snapshot: DataFrame, overlay: DataFrame) -> DataFrame:
    """A resolved snapshot (key, time, columns) with pending mutations laid over it: deletes
    take rows out, writes override the columns they set and add rows."""
    columns = [c for c in snapshot.columns if c not in ("key", "time")]
    merged = _merged(overlay, columns).withColumnRenamed("key", "_key")
    both = snapshot.join(merged, F.col("key") == F.col("_key"), "full_outer")
    live = F.coalesce(F.col("_wrote").isNotNull() & (F.col("_deleted").isNull() | (F.col("_wrote.time") > F.col("_deleted"))), F.lit(False))
    out = [F.coalesce("key", "_key").alias("key"), F.when(live, F.col("_wrote.time")).otherwise(F.col("time")).alias("time")]
    for c in columns:
        cell = F.col(f"_c_{c}")
        fresh = cell.isNotNull() & (F.col("_deleted").isNull() | (cell["time"] > F.col("_deleted")))
        out.append(F.when(fresh, cell["v"]).when(F.col("_deleted").isNull(), F.col(c)).alias(c))
    return both.where(live | F.col("_deleted").isNull()).select(*out)


def overlay_sweep(overlay: DataFrame, index: DataFrame) -> DataFrame:
    """Pending mutations that the index does not cover yet: later than the index's ``time``
    for the key."""
    at = index.select(F.col("key").alias("_key"), F.col("time").alias("_time"))
    return overlay.join(at, (F.col("key") == F.col("_key")) & (F.col("time") <= F.col("_time")), "left_anti")


def compacted(log: DataFrame) -> DataFrame:
    """The log rewritten so that reads give the same: a write a live key and column time,
    and the tombstones that still hide something older in files outside this log."""
    columns = value_columns(log)
    merged = _merged(log, columns)
    alive = "_wrote is not null and (_deleted is null or _wrote.time > _deleted)"
    cells = []
    for c in columns:
        stands = F.col(f"_c_{c}").isNotNull() & (F.col("_deleted").isNull() | (F.col(f"_c_{c}.time") > F.col("_deleted")))
        cells.append(F.when(stands, F.struct(F.col(f"_c_{c}.time").alias("time"), F.col(f"_c_{c}.seq").alias("seq"), F.array(F.lit(c)).alias("cols"))))
    base = F.struct(F.col("_wrote.time").alias("time"), F.col("_wrote.seq").alias("seq"), F.array().cast("array<string>").alias("cols"))
    live = merged.where(alive).withColumn("_at", F.explode(F.array_compact(F.array(base, *cells))))
    grouped = live.select("key", "_at.*", *(F.col(f"_c_{c}.v").alias(c) for c in columns))
    rows = grouped.groupBy("key", "time", "seq").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cols")))).alias("set_cols"), *(F.first(c).alias(c) for c in columns))
    rows = rows.select("key", "time", "seq", F.lit("write").alias("op"), "set_cols", *(F.when(F.array_contains("set_cols", c), F.col(c)).alias(c) for c in columns))
    tombs = merged.where("_deleted is not null").select("key", F.col("_deleted").alias("time"), F.lit(None).cast(log.schema["seq"].dataType).alias("seq"), F.lit("delete").alias("op"), F.array().cast("array<string>").alias("set_cols"))
    return rows.unionByName(tombs, allowMissingColumns=True).select(*META, *columns)


def last_per_key(batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows with one key the last by ``order``, whole."""
    rest = [c for c in batch.columns if c not in key]
    best = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*key, "_row.*")


def replay_transactions(log: DataFrame) -> DataFrame:
    """``key, value`` of a log ``(sequence, key, is_set, value)`` in order of sequence; a
    newest entry with is_set false removes the key, null and empty values are values."""
    best = log.groupBy("key").agg(F.max_by(F.struct("is_set", "value"), "sequence").alias("last"))
    return best.where("last.is_set").select("key", "last.value")
