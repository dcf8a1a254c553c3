"""Blob indexes: folding their logs, listing, change feeds, reconciling, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.operators.ranges import RANGE, in_ranges, numbered, running
from driftwood.operators.routing import in_routes

#: Stamps later than now by more than so many ms are refused.
FUTURE_MS = 15 * 60 * 1000
#: Tombstones that nothing marks are kept so many ms.
TOMBSTONE_MS = 7 * 24 * 3600 * 1000
#: A short listing is asked for again so many times.
SCAN_RETRIES = 3


def fold_index(log: DataFrame) -> DataFrame:
    """``path, state, write_time, size, value_time, changed_at`` after a log of ``(path,
    time, seq, op, size)``, op one of set, delete (keeps the value if ``marked``), unmark,
    drop_value, purge.

    An op older than what the path has is refused; of equal times the later arrival wins. So
    only the newest set or delete counts, and of the ops after it: a purge removes the path,
    a drop_value removes a kept value, an unmark brings a marked value back. Each of these
    is a maximum, and the fold is one aggregation.
    """
    at = F.struct("time", "seq")
    main = F.col("op").isin("set", "delete")
    best = lambda c, cond: F.max_by(c, F.when(cond, at))
    newest = lambda cond: F.max(F.when(cond, at))
    folded = log.groupBy("path").agg(
        best(F.struct("op", "size", "marked", "time"), main).alias("main"), newest(main).alias("main_at"),
        best(F.struct("size", "time"), F.col("op") == "set").alias("last_set"), newest(F.col("op") == "unmark").alias("unmark_at"),
        newest(F.col("op") == "drop_value").alias("drop_at"), newest(F.col("op") == "purge").alias("purge_at"), F.max("time").alias("changed_at"),
    )
    after = lambda c: F.coalesce(F.col(c) > F.col("main_at"), F.lit(False))
    marked = (F.col("main.op") == "delete") & F.col("main.marked") & F.col("last_set").isNotNull() & ~after("drop_at")
    back = marked & after("unmark_at")
    live = (F.col("main.op") == "set") | back
    state = F.when(F.col("main.op") == "set", "live").when(back, "live").when(marked, "marked").otherwise("deleted")
    kept = folded.where(F.col("main").isNotNull() & ~after("purge_at"))
    return kept.select(
        "path", state.alias("state"), F.when(back, F.col("unmark_at.time")).otherwise(F.col("main.time")).alias("write_time"),
        F.when(live | marked, F.coalesce(F.when(F.col("main.op") == "set", F.col("main.size")), F.col("last_set.size"))).otherwise(0).cast("long").alias("size"),
        F.when(live | marked, F.when(F.col("main.op") == "set", F.col("main.time")).otherwise(F.col("last_set.time"))).alias("value_time"), "changed_at",
    )


def find(index: DataFrame, prefix: str, include_marked: bool = False) -> DataFrame:
    """``path, create_time, size`` below a prefix, in order of path; marked entries, if
    wanted, with the time and size of the value that is kept for them."""
    states = ["live", "marked"] if include_marked else ["live"]
    found = index.where(F.col("path").startswith(prefix) & F.col("state").isin(states))
    written = F.when(F.col("state") == "marked", F.coalesce("value_time", "write_time")).otherwise(F.col("write_time"))
    return found.select("path", written.alias("create_time"), "size").orderBy("path")


def shallow(listing: DataFrame, prefix: str) -> DataFrame:
    """Files directly under the prefix."""
    return listing.where(F.col("path").startswith(prefix) & ~F.substring(F.col("path"), len(prefix) + 1, 1 << 30).contains("/"))


def folders(listing: DataFrame, prefix: str, recursive: bool = False) -> DataFrame:
    """``path, create_time, size`` of folders: those directly under the prefix or, if
    recursive, the parents of files. Time and size are those of the last file in path order."""
    rest = F.substring(F.col("path"), len(prefix) + 1, 1 << 30)
    below = listing.where(F.col("path").startswith(prefix) & rest.contains("/"))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1) if recursive else F.concat(F.lit(prefix), F.substring_index(rest, "/", 1))
    return below.groupBy(folder.alias("folder")).agg(F.max_by(F.struct("create_time", "size"), "path").alias("_l")).select(F.col("folder").alias("path"), "_l.create_time", "_l.size")


def changes_after(index: DataFrame, time, routes: list[tuple[float, float]] | None = None) -> DataFrame:
    """``path, create_time, size`` of entries changed after a time, in the given routes;
    deletions have size 0."""
    found = index.where((F.col("changed_at") > F.lit(time)) & in_routes(F.col("path"), routes))
    return found.select("path", F.col("write_time").alias("create_time"), F.when(F.col("state") == "live", F.col("size")).otherwise(0).cast("long").alias("size"))


def filter_changes(listing: DataFrame, time, routes: list[tuple[float, float]] | None = None) -> DataFrame:
    """The change feed of a store that has none: a full listing, filtered by time and route."""
    return listing.where((F.col("create_time") > F.lit(time)) & in_routes(F.col("path"), routes))


def read_range(blobs: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Blobs with ``content`` cut to the bytes [start, stop)."""
    return blobs.withColumn("content", F.substring(F.col("content"), start + 1, stop - start))


def index_totals(index: DataFrame) -> DataFrame:
    """Files and bytes of live entries for each holder, and for all (holder null)."""
    return index.where("state = 'live'").rollup("holder").agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"))


def marked_totals(index: DataFrame) -> DataFrame:
    return index.where("state = 'marked'").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.min("write_time").alias("oldest"))


def store_totals(totals: DataFrame) -> DataFrame:
    """Figures of one bucket in several stores as one: sums, the oldest time, all names and
    whether every store is ready."""
    return totals.groupBy("bucket").agg(F.sum("files").cast("long").alias("files"), F.sum("bytes").cast("long").alias("bytes"), F.min("oldest").alias("oldest"), F.array_join(F.array_sort(F.collect_list("store")), ",").alias("stores"), F.bool_and("ready").alias("ready"))


def newest_across(listings: DataFrame, order: str) -> DataFrame:
    """Of listings of several sources the newest row of each path; of equal times the one of
    the first source."""
    best = F.max_by(F.struct("create_time", "size", order), F.struct("create_time", -F.col(order)))
    return listings.groupBy("path").agg(best.alias("_b")).select("path", "_b.*")


def reconcile_pull(theirs: DataFrame, index: DataFrame, accepted: Column | None = None, scan_start=None, local: DataFrame | None = None) -> DataFrame:
    """``path, outcome`` for their listing (path, create_time, size) against our index (path,
    write_time, size, from_them): filtered, tombstone, new, updated, unchanged.

    Of what they no longer list, entries that came from them go: ``repoint`` where ``local``
    (path) has a copy of our own, else ``purge``. What changed at or after ``scan_start``
    (``changed_at`` of the index) may be newer than the listing and stays: ``missing``, as is
    what came from others."""
    ours = index.select(F.col("path").alias("_path"), "write_time", F.col("size").alias("_size"), "from_them", *(["changed_at"] if scan_start is not None else []))
    both = theirs.join(ours, F.col("path") == F.col("_path"), "full_outer")
    if local is not None:
        copies = local.select(F.col("path").alias("_local")).distinct()
        both = both.join(copies, F.col("_path") == F.col("_local"), "left")
    there, here = F.col("path").isNotNull(), F.col("_path").isNotNull()
    theirs_alone = F.col("from_them") & (F.lit(True) if scan_start is None else F.col("changed_at") < F.lit(scan_start))
    outcome = F.when(there & ~(F.lit(True) if accepted is None else accepted), "filtered")
    outcome = outcome.when(there & here & (F.col("create_time") <= F.col("write_time")), "unchanged").when(there & (F.col("size") == 0), "tombstone")
    outcome = outcome.when(there & here, "updated").when(there, "new")
    if local is not None:
        outcome = outcome.when(theirs_alone & F.col("_local").isNotNull(), "repoint")
    return both.select(F.coalesce("path", "_path").alias("path"), outcome.when(theirs_alone, "purge").otherwise("missing").alias("outcome"))


def reconcile_push(index: DataFrame, theirs: DataFrame) -> DataFrame:
    """``path, action`` for what they should get: puts where ours is newer or they lack it,
    deletes where ours is a newer deletion of something that they have."""
    t = theirs.select(F.col("path").alias("_path"), F.col("create_time").alias("_time"), F.col("size").alias("_size"))
    both = index.join(t, F.col("path") == F.col("_path"), "left")
    newer = F.col("_path").isNull() | (F.col("write_time") > F.col("_time"))
    gone = F.col("size") == 0
    action = F.when(gone & F.col("_path").isNotNull() & newer & (F.col("_size") > 0), "delete").when(~gone & newer, "put")
    return both.select("path", action.alias("action")).where("action is not null")


def copy_if_newer(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of ``source`` to copy: those that the target lacks or has older."""
    t = target.select(F.col("path").alias("_path"), F.col("create_time").alias("_time"))
    return source.join(t, (F.col("path") == F.col("_path")) & (F.col("_time") >= F.col("create_time")), "left_anti")


def coalesce_writes(pending: DataFrame, now) -> DataFrame:
    """Of delayed writes (path, time, seq, due, size) the last of each path, with ``flush``:
    whether the earliest due time of the path has come."""
    last = F.max_by(F.struct("time", "seq", "size"), F.struct("time", "seq"))
    return pending.groupBy("path").agg(last.alias("_l"), F.min("due").alias("due"), F.count(F.lit(1)).alias("writes")).select("path", "_l.time", "_l.size", "due", "writes", (F.col("due") <= F.lit(now)).alias("flush"))


def evict_oldest(items: DataFrame, size: str, order: list[str], budget: int) -> DataFrame:
    """Items that go so that the rest, the newest, fits the budget: those whose own and
    later sizes together exceed it. ``order`` is total."""
    newest = [F.col(c).desc() for c in order]
    return running(in_ranges(items, newest), newest, sums={"_kept": F.col(size)}).where(F.col("_kept") > budget).drop("_kept", RANGE)


def evictable(candidates: DataFrame, holders: DataFrame) -> DataFrame:
    """Candidates that another holder has as new or newer."""
    h = holders.select(F.col("path").alias("_path"), F.col("holder").alias("_holder"), F.col("write_time").alias("_time"))
    return candidates.join(h, (F.col("path") == F.col("_path")) & (F.col("holder") != F.col("_holder")) & (F.col("_time") >= F.col("write_time")), "left_semi")


def expired_tombstones(index: DataFrame, now) -> DataFrame:
    """Deletions that nothing marks and that are older than a week: what clean-up drops."""
    return index.where((F.col("state") == "deleted") & (F.col("write_time") < F.lit(now) - F.expr(f"interval {TOMBSTONE_MS // 1000} seconds")))


def accepted_stamps(log: DataFrame, now) -> DataFrame:
    """Rows whose stamp is not from the future, a quarter of an hour of skew allowed."""
    return log.where(F.col("time") <= F.lit(now) + F.expr(f"interval {FUTURE_MS // 1000} seconds"))


def dedupe_oldest(items: DataFrame, origin: str, order: list[str]) -> DataFrame:
    """Of several results of one origin the oldest; the others are to be deleted."""
    rest = [c for c in items.columns if c != origin]
    return items.groupBy(origin).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(origin, "_r.*")


def source_ids(urls: DataFrame, url: str, seen: str) -> DataFrame:
    """An append-only numbering of sources by when they were first seen."""
    first = urls.groupBy(url).agg(F.min(seen).alias("first_seen"))
    return numbered(first, [F.col("first_seen"), F.col(url)], "source_id")


def pair_slots(left: DataFrame, right: DataFrame, identity: str, order: str) -> DataFrame:
    """Rows with one identity paired in order: first with first, second with second."""
    number = F.row_number().over(Window.partitionBy(identity).orderBy(order))
    a = left.select(F.col(identity), F.col(order).alias("left_slot"), number.alias("nth"))
    b = right.select(F.col(identity), F.col(order).alias("right_slot"), number.alias("nth"))
    return a.join(b, [identity, "nth"], "full_outer")


def set_diff(before: DataFrame, after: DataFrame, identity: str, items: str) -> DataFrame:
    """``identity, change, gained, lost`` where the array ``items`` of an identity differs."""
    b, a = before.select(F.col(identity).alias("_b"), F.col(items).alias("_old")), after.select(F.col(identity).alias("_a"), F.col(items).alias("_new"))
    both = b.join(a, F.col("_b") == F.col("_a"), "full_outer")
    empty = F.array().cast("array<string>")
    old, new = F.coalesce("_old", empty), F.coalesce("_new", empty)
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when((F.size(F.array_except(new, old)) > 0) | (F.size(F.array_except(old, new)) > 0), "changed")
    return both.select(F.coalesce("_a", "_b").alias(identity), change.alias("change"), F.array_sort(F.array_except(new, old)).alias("gained"), F.array_sort(F.array_except(old, new)).alias("lost")).where("change is not null")


def standing_revocations(revoked: DataFrame, unrevoked: DataFrame) -> DataFrame:
    """Revocations (pair, legacy_id, time) that no later entry takes back by pair or by id."""
    def latest(column: str, name: str) -> DataFrame:
        return unrevoked.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(name)).agg(F.max("time").alias("_t"))

    left = revoked.join(latest("pair", "_p"), (F.col("pair") == F.col("_p")) & (F.col("_t") >= F.col("time")), "left_anti")
    return left.join(latest("legacy_id", "_i"), (F.col("legacy_id") == F.col("_i")) & (F.col("_t") >= F.col("time")), "left_anti")


def accepted_machines(requests: DataFrame, trusted: DataFrame, addresses: DataFrame, revoked: DataFrame) -> DataFrame:
    """Requests (machine, ip) with ``accepted``: the machine is trusted, the address is
    listed, and the pair is not revoked."""
    ok = requests.join(trusted, "machine", "left_semi").join(addresses, "ip", "left_semi").join(revoked, ["machine", "ip"], "left_anti").distinct()
    return requests.join(ok.withColumn("accepted", F.lit(True)), ["machine", "ip"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def scan_tally(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def scan_verdict(found: DataFrame, expected: int, attempts: int) -> DataFrame:
    """``n, verdict`` of a listing: ``retry`` if it has less than half of what is expected
    (the last listing or what the index holds of it, the larger), but ``accept`` after
    SCAN_RETRIES attempts: then it is the truth."""
    short = (F.lit(expected) > 0) & (F.col("n") < F.lit(expected) / 2)
    return found.agg(F.count(F.lit(1)).alias("n")).withColumn("verdict", F.when(short & (F.lit(attempts) < SCAN_RETRIES), "retry").otherwise("accept"))


def conditional_writes(writes: DataFrame, index: DataFrame, now, immutable: bool, routes: list[tuple[float, float]] | None, window: tuple) -> DataFrame:
    """Writes ``(path, time, size)`` with ``verdict``: ``route`` outside the store's routes,
    ``window`` written outside its time [s, e), ``future`` with a stamp from the future,
    ``immutable`` where a live value may not be overwritten, ``stale`` where the index has a
    newer change, else ``ok``."""
    known = index.select(F.col("path").alias("_path"), F.col("write_time").alias("_time"), (F.col("state") == "live").alias("_live"))
    joined = writes.join(known, F.col("path") == F.col("_path"), "left")
    late = F.col("time") > F.lit(now) + F.expr(f"interval {FUTURE_MS // 1000} seconds")
    verdict = F.when(~in_routes(F.col("path"), routes), "route").when((F.col("time") < F.lit(window[0])) | (F.col("time") >= F.lit(window[1])), "window").when(late, "future")
    verdict = verdict.when(F.lit(immutable) & F.col("_live") & (F.col("size") > 0), "immutable").when(F.col("_time") > F.col("time"), "stale").otherwise("ok")
    return joined.select(*writes.columns, verdict.alias("verdict"))


def preserved_write_time(listing: DataFrame) -> DataFrame:
    return listing.withColumn("write_time", F.coalesce("source_time", "upload_time"))
