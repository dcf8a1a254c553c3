"""The mutation log: one row a change, with which columns it sets.

``key``, ``time`` (ms since the epoch or any ordered type), ``seq`` (breaks ties, unique),
``op`` ('write' or 'delete'), ``set_cols`` (names of the columns that the row sets) and the
columns themselves. A column outside ``set_cols`` is absent: it leaves older values alone.
A null in a column inside ``set_cols`` is a clear. A null alone could not tell the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META = ("key", "time", "seq", "op", "set_cols")


def value_columns(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in META]


def writes(rows: DataFrame, key: str, time: Column, seq: Column, columns: list[str] | None = None) -> DataFrame:
    """Rows as writes that set all of ``columns`` (default: all but the key)."""
    columns = [c for c in rows.columns if c != key] if columns is None else columns
    return rows.select(F.col(key).alias("key"), time.alias("time"), seq.alias("seq"), F.lit("write").alias("op"), F.array(*map(F.lit, columns)).cast("array<string>").alias("set_cols"), *columns)


def deletes(keys: DataFrame, key: str, time: Column, seq: Column) -> DataFrame:
    return keys.select(F.col(key).alias("key"), time.alias("time"), seq.alias("seq"), F.lit("delete").alias("op"), F.array().cast("array<string>").alias("set_cols"))


def merged(*logs: DataFrame) -> DataFrame:
    """The union of logs with differing columns; what a log lacks is absent, not cleared."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out


def events_log(events: DataFrame) -> DataFrame:
    """The driver table ``events`` as a mutation log: an error deletes the user's row, a
    click or view sets ``value``, a purchase ``props``, a signup both."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("key"), F.col("ts").alias("time"), F.col("event_id").alias("seq"), F.when(kind == "error", "delete").otherwise("write").alias("op"),
        F.when(kind.isin("click", "view"), F.array(F.lit("value"))).when(kind == "purchase", F.array(F.lit("props"))).when(kind == "signup", F.array(F.lit("value"), F.lit("props"))).otherwise(F.array().cast("array<string>")).alias("set_cols"),
        "value", "props",
    )
