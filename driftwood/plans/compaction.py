"""When to compact a collection, and what: triggers and steps over figures of its files.

Files are rows ``(file, tier, bytes, min_key, max_key)``; tier is log or bulk. Bulk files
below LOOSE_BYTES are loose and worth rolling up, the others are combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.operators.ranges import in_ranges, running
from driftwood.sources.shared import checkpointed

MB = 1 << 20
# Thresholds of the policy.
FOLD_HARD_BYTES, FOLD_BYTES = 768 * MB, 64 * MB
COMBINE_BYTES, COMBINE_FILES = 1024 * MB, 20
DEDUP_BYTES, DEDUP_SHARE, GROUP_SHARE = 512 * MB, 0.5, 0.4
LOOSE_BYTES, FILE_BYTES, GROUP_BYTES = 128 * MB, 256 * MB, 800 * MB
#: name, metric, threshold of the triggers that need file sizes alone.
TRIGGERS = (("fold_hard", "log_bytes", FOLD_HARD_BYTES), ("fold", "log_bytes", FOLD_BYTES), ("combine_bytes", "loose_bytes", COMBINE_BYTES), ("combine_files", "loose_files", COMBINE_FILES), ("dedup_bytes", "combined_bytes", DEDUP_BYTES))


def tiers(files: DataFrame) -> DataFrame:
    """``files`` with bulk files told apart; one whose size is unknown counts as combined."""
    loose = F.coalesce(F.col("bytes") < LOOSE_BYTES, F.lit(False))
    return files.withColumn("tier", F.when(F.col("tier") == "log", "log").when(loose, "loose").otherwise("combined"))


def metrics(files: DataFrame) -> DataFrame:
    """One row of figures for files ``(tier, bytes)`` with tier log, loose or combined."""
    def of(tier: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("tier") == tier, value)), F.lit(0)).cast("long")

    one = F.lit(1)
    return files.agg(
        of("log", F.col("bytes")).alias("log_bytes"), of("log", one).alias("log_files"), of("loose", F.col("bytes")).alias("loose_bytes"), of("loose", one).alias("loose_files"),
        of("combined", F.col("bytes")).alias("combined_bytes"), of("combined", one).alias("combined_files"),
    )


def triggers(figures: DataFrame) -> DataFrame:
    """``trigger, value, threshold, fraction, met`` for each trigger."""
    rows = F.array(*(F.struct(F.lit(name).alias("trigger"), F.col(metric).cast("long").alias("value"), F.lit(limit).cast("long").alias("threshold")) for name, metric, limit in TRIGGERS))
    out = figures.select(F.explode(rows).alias("t")).select("t.*")
    return out.select("*", (F.col("value") / F.col("threshold")).alias("fraction"), (F.col("value") >= F.col("threshold")).alias("met"))


def steps(files: DataFrame, duplicates: DataFrame, groups: DataFrame) -> DataFrame:
    """``phase, step, ready, bytes, lo, hi, dup``: what the files call for, in order of phase.

    Phase 1 folds the log: all of it past the hard limit, else what may be folded past the
    trigger. Phase 2 combines loose files, two at least, past either trigger. Phase 3
    rewrites combined files that repeat keys: all of them, two at least, past both triggers;
    else each group ``(lo, hi, dup)`` of keys past its share that two files at least reach
    into. Without such a group the one with the largest share is listed, not ready.
    ``duplicates (dup)`` has the share of the whole tier in one row.
    """
    files = checkpointed(tiers(files))
    seen = metrics(files).crossJoin(F.broadcast(duplicates.select(F.coalesce("dup", F.lit(0.0)).alias("dup"))))  # one row with one row
    col = F.col
    hard = col("log_bytes") >= FOLD_HARD_BYTES
    all_ready = (col("combined_files") >= 2) & (col("combined_bytes") >= DEDUP_BYTES) & (col("dup") >= DEDUP_SHARE)
    seen = seen.withColumn("all_ready", all_ready)

    def step(phase: int, name: str, ready: Column, size: str) -> Column:
        return F.struct(F.lit(phase).alias("phase"), F.lit(name).alias("step"), ready.alias("ready"), col(size).alias("bytes"))

    plain = seen.select(F.explode(F.array(
        step(1, "fold_hard", hard & (col("log_files") > 0), "log_bytes"), step(1, "fold", ~hard & (col("log_bytes") >= FOLD_BYTES), "log_bytes"),
        step(2, "combine", (col("loose_files") >= 2) & ((col("loose_bytes") >= COMBINE_BYTES) | (col("loose_files") >= COMBINE_FILES)), "loose_bytes"),
        step(3, "dedup_all", col("all_ready"), "combined_bytes"),
    )).alias("s")).select("s.*", F.lit(None).cast(groups.schema["lo"].dataType).alias("lo"), F.lit(None).cast(groups.schema["hi"].dataType).alias("hi"), F.lit(None).cast("double").alias("dup"))
    most = groups.agg(F.max_by("lo", F.struct("dup", "lo")).alias("best"), F.max("dup").alias("top"))
    wanted = groups.crossJoin(F.broadcast(most)).where((col("dup") >= GROUP_SHARE) | ((col("top") < GROUP_SHARE) & (col("lo") == col("best"))))  # one row on the right
    met = reached(wanted, files.where("tier = 'combined'"))
    grouped = met.crossJoin(F.broadcast(seen.select("all_ready"))).select(  # one row on the right
        F.lit(3).alias("phase"), F.lit("dedup_group").alias("step"), (~col("all_ready") & (col("dup") >= GROUP_SHARE) & (col("n") >= 2)).alias("ready"), "bytes", "lo", "hi", "dup"
    )
    return plain.unionByName(grouped)


def reached(groups: DataFrame, files: DataFrame) -> DataFrame:
    """``groups (lo, hi, dup)``, each once, with ``bytes`` and ``n`` (those of known size) of
    the files that reach into it: their keys meet ``lo`` to ``hi``, or are unknown.

    Groups do not meet files one by one: the files that begin by ``hi``, less those that end
    before ``lo``, follow from sums along the keys. That needs keys in order; files and
    groups whose bounds are the wrong way round, of which there should be none, are compared.
    """
    groups = groups.select("lo", "hi", "dup").distinct()
    files = files.select(F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), F.col("bytes").isNotNull().cast("long").alias("n"), "min_key", "max_key")
    known, zero = files.where("min_key <= max_key"), F.lit(0).cast("long")
    keys = [F.col("at"), F.col("after")]

    def sums(key: str, bound: str, sign: int) -> DataFrame:
        """Of the files whose ``key`` is below each group's ``bound``; or equal, if the sign
        is plus."""
        ends = known.groupBy(F.col(key).alias("at")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        ends = ends.select("at", F.lit(sign < 0).alias("after"), "bytes", "n", F.lit(False).alias("asks"), *(F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in groups.columns))
        asked = groups.where("lo <= hi").select(F.col(bound).alias("at"), F.lit(sign > 0).alias("after"), zero.alias("bytes"), zero.alias("n"), F.lit(True).alias("asks"), *groups.columns)
        found = running(in_ranges(ends.unionByName(asked), keys), keys, sums={"up_bytes": F.col("bytes"), "up_n": F.col("n")}).where("asks")
        return found.select("lo", "hi", "dup", (sign * F.col("up_bytes")).alias("bytes"), (sign * F.col("up_n")).alias("n"))

    meet = (F.col("min_key") <= F.col("hi")) & (F.col("max_key") >= F.col("lo"))
    turned = groups.join(F.broadcast(files.where("min_key > max_key")), meet).unionByName(known.join(F.broadcast(groups.where("lo > hi")), meet))
    parts = groups.select("*", zero.alias("bytes"), zero.alias("n")).unionByName(sums("min_key", "hi", 1)).unionByName(sums("max_key", "lo", -1)).unionByName(turned.select("lo", "hi", "dup", "bytes", "n"))
    free = files.where("min_key is null or max_key is null").agg(F.coalesce(F.sum("bytes"), zero).alias("free_bytes"), F.coalesce(F.sum("n"), zero).alias("free_n"))
    met = parts.groupBy("lo", "hi", "dup").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).crossJoin(F.broadcast(free))  # one row on the right
    return met.select("lo", "hi", "dup", (F.col("bytes") + F.col("free_bytes")).alias("bytes"), (F.col("n") + F.col("free_n")).alias("n"))


def start_times(planned: DataFrame, begin: int, gap: int) -> DataFrame:
    """``steps`` with ``start_at``: ready ones ``gap`` apart in order of phase, the groups
    that repeat most first. A plan has a row a step, few enough for one task."""
    order = Window.orderBy("phase", "step", F.desc("dup"), "lo").rowsBetween(Window.unboundedPreceding, 0)
    nth = F.sum(F.col("ready").cast("int")).over(order)
    return planned.withColumn("start_at", F.when(F.col("ready"), F.lit(begin) + (nth - 1) * gap).cast("long"))


def output_files(total_bytes: int) -> int:
    return max(1, -(-total_bytes // FILE_BYTES))
