"""Searching, pairing and counting log entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.functions.filters import search_all
from driftwood.functions.scalars import log_line, picker_rank
from driftwood.operators.pathsummary import prefixes


def search(lines: DataFrame, line: str, terms: list[str]) -> DataFrame:
    return lines.where(search_all(F.col(line), terms))


def auth_pairs(lines: DataFrame, line: str, seq: str) -> DataFrame:
    """Refusals by address with the key that the same process presented: every refusal of
    the log, with the last failed key of its process, before it or behind. Refusals without
    a key are left out."""
    parsed = lines.select(F.col(seq).alias("seq"), F.trim(F.col(line)).alias("line"), log_line(F.col(line)).alias("x")).select("seq", "line", "x.*").where("process is not null")
    refused = parsed.where("user is not null").select("seq", "process", "user", "ip", "required", "line")
    keys = parsed.where("fingerprint is not null").groupBy("process").agg(F.max_by(F.struct("fingerprint", "port"), "seq").alias("k"))
    return refused.join(keys, "process").select("seq", "process", "k.fingerprint", "ip", "user", "k.port", "required", "line")


def pick_options(options: DataFrame, column: str, typed: str, most: int = 10) -> DataFrame:
    """The best options that hold the typed text, with how many more there are. Nothing
    typed finds nothing."""
    want = typed.strip().lower()
    found = options.select(F.col(column).alias("option")).where(F.lower("option").contains(want) & F.lit(bool(want))).distinct()
    ranked = found.withColumn("rank", picker_rank(F.col("option"), typed))
    total = ranked.agg(F.count(F.lit(1))).scalar()
    return ranked.orderBy("rank", "option").limit(most).select("option", "rank", F.greatest(total - most, F.lit(0)).alias("more"))


def access_stats(events: DataFrame, by: list[str], size: Column) -> DataFrame:
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("size"))


def result_stats(calls: DataFrame, by: list[str], query_path: str, results: str) -> DataFrame:
    """``by, kind, path, n, size`` of calls that return lists of paths: as ``queries`` once a
    call at the path that was asked, sized by its results, and as ``results`` once for each
    path that came back."""
    asked = calls.groupBy(*by, F.col(query_path).alias("path")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.greatest(F.size(results), F.lit(0))), F.lit(0)).cast("long").alias("size"))
    found = calls.select(*by, F.explode(results).alias("path")).groupBy(*by, "path").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("size"))
    return asked.withColumn("kind", F.lit("queries")).unionByName(found.withColumn("kind", F.lit("results")))


def access_tree(events: DataFrame, by: list[str], path: str, size: Column) -> DataFrame:
    """``by, prefix, n, size``: accesses and their bytes below every path prefix; size is
    null where no access had one."""
    paths = events.groupBy(*by, F.col(path).alias("_path")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("size"))
    each = paths.select(*by, F.explode(prefixes(F.col("_path"))).alias("prefix"), "n", "size")
    return each.groupBy(*by, "prefix").agg(F.sum("n").alias("n"), F.sum("size").cast("long").alias("size"))


def write_amplification(writes: DataFrame, by: list[str]) -> DataFrame:
    """Writes asked for against writes that reached storage: counts, bytes and their quotient."""
    out = writes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("original"), F.count(F.when(F.col("flushed"), 1)).alias("written"), F.sum("size").cast("long").alias("original_bytes"), F.coalesce(F.sum(F.when(F.col("flushed"), F.col("size"))), F.lit(0)).cast("long").alias("written_bytes"),
    )
    return out.withColumn("share", F.col("written_bytes") / F.col("original_bytes"))


def tumbling_access(events: DataFrame, ts: str, seconds: int, by: list[str], size: Column) -> DataFrame:
    """Count and bytes of each window and key, the heaviest first within a window."""
    out = events.groupBy(F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds").alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("bytes"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *by, "n", "bytes")


def sliding_bytes(events: DataFrame, ts: str, size: str, seconds: int, by: list[str]) -> DataFrame:
    """Each event with the bytes of the last ``seconds`` seconds up to it."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    order = Window.partitionBy(*by).orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("_us", at).withColumn("recent", F.sum(size).over(order)).drop("_us")


def session_windows(events: DataFrame, ts: str, gap: str, by: list[str]) -> DataFrame:
    """Sessions of events that are less than ``gap`` apart (an extension)."""
    out = events.groupBy(F.session_window(F.col(ts).cast("timestamp"), gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")
