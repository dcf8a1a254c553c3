"""Figures about collections: rows, bytes, duplication, groups by size, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.model import value_columns
from driftwood.operators import lww
from driftwood.operators.ranges import greedy_groups


def value_bytes(column: str, kind: T.DataType) -> Column:
    """Estimated bytes of a value: 2 a UTF-16 unit for text, 8 a number or time, 1 a boolean,
    and 5 of index for each value."""
    if isinstance(kind, T.StringType):
        wide = F.length(F.regexp_replace(F.col(column), "[^\\x{10000}-\\x{10FFFF}]", ""))
        return F.coalesce(2 * (F.length(column) + wide), F.lit(0)) + 5
    if isinstance(kind, T.BooleanType):
        return F.when(F.col(column).isNull(), 0).otherwise(1) + 5
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.when(F.col(column).isNull(), 0).otherwise(8) + 5
    if isinstance(kind, T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 5
    return F.coalesce(2 * F.length(F.to_json(column)), F.lit(0)) + 5


def row_bytes(df: DataFrame) -> Column:
    out = F.lit(0)
    for f in df.schema.fields:
        out = out + value_bytes(f.name, f.dataType)
    return out.cast("long")


def column_info(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, byte_size``: a row a column, from one pass."""
    sums = df.agg(*(F.sum(value_bytes(c, df.schema[c].dataType)).cast("long").alias(c) for c in columns))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("byte_size")) for c in columns))).alias("x")).select("x.*")


def reader_info(log: DataFrame) -> DataFrame:
    """``row_count, total_bytes, key_count, sample_key, columns`` of the live rows."""
    live = lww.resolve(log)
    columns = value_columns(log)
    return live.agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(row_bytes(live.select(*columns))), F.lit(0)).cast("long").alias("total_bytes"),
        F.count("key").alias("key_count"), F.min("key").alias("sample_key"),
    ).withColumn("columns", F.lit(",".join(columns)))


def key_stats(slots: DataFrame, key: str = "key") -> DataFrame:
    """``raw_keys, final_keys, wasted, duplication`` of the slots (one a key and file)."""
    found = slots.groupBy(key).count().agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("raw_keys"), F.count(F.lit(1)).alias("final_keys"))
    return found.select("*", (F.col("raw_keys") - F.col("final_keys")).alias("wasted"), F.when(F.col("raw_keys") > 0, (F.col("raw_keys") - F.col("final_keys")) / F.col("raw_keys")).otherwise(0.0).alias("duplication"))


def file_info(rows: DataFrame, file: Column, key: str, time: str) -> DataFrame:
    """A row a file: rows, keys, bounds of key and time, bytes."""
    return rows.withColumn("file", file).groupBy("file").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct(key).alias("keys"), F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.min(time).alias("min_time"), F.max(time).alias("max_time"), F.sum(row_bytes(rows)).cast("long").alias("bytes"),
    )


def duplicate_key_groups(slots: DataFrame, key: str, size: str, target: int) -> DataFrame:
    """Groups of neighbouring keys, each closed by the key that makes it reach ``target``
    bytes, with the share of slots that repeat a key. Keys are summed first."""
    by_key = slots.groupBy(key).agg(F.count(F.lit(1)).alias("slots"), F.sum(size).cast("long").alias("bytes"))
    cut = greedy_groups(by_key, [], key, "bytes", target, past=False)
    repeats = (F.sum("slots") - F.count(F.lit(1))) / F.sum("slots")
    return cut.groupBy("group_no").agg(
        F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.sum("bytes").cast("long").alias("bytes"), F.sum("slots").cast("long").alias("slots"), repeats.alias("dup_fraction")
    )


def greedy_chunks(sorted_sizes: DataFrame, shard: str, order: str, size: str, target: int) -> DataFrame:
    """``sorted_sizes`` with ``chunk``, the number of its output file within the shard: a
    file is cut before the key that would take it above ``target``; a larger key is alone."""
    return greedy_groups(sorted_sizes, [shard], order, size, target, past=True).withColumnRenamed("group_no", "chunk")


def tier_split(files: DataFrame, limit: int) -> DataFrame:
    """Loose and combined files: ``tier, files, bytes``; combined ones reach ``limit``."""
    return files.withColumn("tier", F.when(F.col("bytes") >= limit, "combined").otherwise("loose")).groupBy("tier").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").cast("long").alias("bytes"))


def upper_median(df: DataFrame, by: list[str], column: str, last: int, order: str) -> DataFrame:
    """The upper median of the ``last`` newest values of each group: element floor(n/2) of
    the sorted ones. ``last`` bounds what is gathered."""
    newest = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_n") <= last)
    values = F.array_sort(F.collect_list(column))
    return newest.groupBy(*by).agg(F.element_at(values, (F.floor(F.count(column) / 2) + 1).cast("int")).alias("median"))
