"""Near copies by exact Jaccard similarity of word shingles, found by SimHash and completed
through prefix filters.

SimHash's generalised pigeonhole index gives the pairs of few differing bits, which are
compared whole. At a similarity of 0.8 some ten of 64 bits differ, for which a pigeonhole
over bits would have to try a share of all pairs; what the fingerprints cannot tell is found
by a pigeonhole over the sets. All shingles have one order. Two sets whose similarity is ``share`` or more have at least
ceil(share n) shingles of either set in common, so by the pigeonhole their first
n - ceil(share n) + 1 shingles in that order meet. Each set is indexed under those alone;
sets that meet are compared whole, so no pair is missed and none is linked in error. The
order puts shingles that a sample shows to be common last: it changes the cost alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.llm import simhash
from driftwood.llm.common import free_name, in_arrow, slices, written
from driftwood.llm.components import components

#: About how many documents tell common shingles, and how many such may be broadcast.
_SAMPLE, _MOST_COMMON = 1 << 14, 1 << 20
#: Rounds of comparing with pivots go on while pairs left to compare exceed so many a set.
_PAIRS, _ROUNDS = 4, 12
#: So many digests and whole-number ids (8 bytes each) at most are broadcast to pick out rows.
_FEW = 1 << 18


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """The sorted, distinct XXH64 of the text's word shingles, as signed longs; a text of
    fewer words has one, a text without words none."""
    words = text.lower().split()  # bytes: A-Z alone, and \\x20 \\x09-\\x0D alone
    if not words:
        return np.zeros(0, np.int64)
    width, joined, digest = min(width, len(words)), b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    stops = (ends - 1)[width - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts, stops, strict=True)), np.uint64, len(starts)).view(np.int64))


def _sets(docs: DataFrame, width: int, prefix: tuple[int, int] | None = None, common: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``id, digest, n, tokens, fp`` of each row ``(id, text)``: all shingles of the set or,
    where ``prefix`` states the share as a fraction, the first ones in order and the set's
    SimHash."""
    shipped = docs.sparkSession.sparkContext.broadcast(common)

    def first(found: np.ndarray) -> np.ndarray:
        keys, counts = shipped.value
        n = len(found)
        at = np.minimum(np.searchsorted(keys, found), max(len(keys) - 1, 0))
        often = np.where(keys[at] == found, counts[at], 0) if len(keys) else np.zeros(n, np.int64)
        return found[np.argsort(often, kind="stable")[: n - -(-prefix[0] * n // prefix[1]) + 1]] if n else found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            sets = [shingles(t or b"", width) for t in batch.column("text").to_pylist()]
            digests = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            sizes = pa.array([len(s) for s in sets], pa.int32())
            tokens = [first(s) for s in sets] if prefix else sets
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens)))
            fps = np.array([simhash.of_hashes(s.view(np.uint64)) for s in sets] if prefix else [0] * len(sets), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digests), sizes, lists, pa.array(fps)], ["id", "digest", "n", "tokens", "fp"])

    kind = docs.schema["id"].dataType.simpleString()
    return in_arrow(docs, run, f"id {kind}, digest long, n int, tokens array<long>, fp long")


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that three or more sampled documents hold, sorted, and in how many."""
    sample = docs.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(max(1, docs.count() // _SAMPLE))) == 0)
    counts = _sets(sample, width).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c >= 3")
    found = counts.orderBy(F.desc("c"), "token").limit(_MOST_COMMON).toArrow()
    keys, often = found.column("token").to_numpy(), found.column("c").to_numpy()
    order = np.argsort(keys)
    return keys[order], often[order]


def _near_fingerprints(sets: DataFrame, k: int = 3) -> DataFrame:
    """Pairs ``(a, b)`` of digests of ``sets (digest, fp)`` that connect sets of one SimHash,
    and those of SimHashes that the pigeonhole index links at ``k`` bits or fewer."""
    first = written(sets.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("first")))
    same = sets.join(first, "fp").where("digest != first").select(F.col("digest").alias("a"), F.col("first").alias("b"))
    near = simhash.links(first.select("fp", "n"), k)
    a, b = (first.select(F.col("fp").alias(x), F.col("first").alias(f"f{x}")) for x in "ab")
    return same.unionByName(near.join(a, "a").join(b, "b").select(F.col("fa").alias("a"), F.col("fb").alias("b")))


def links(docs: DataFrame, sets: DataFrame, share: tuple[int, int] = (4, 5), width: int = 5) -> DataFrame:
    """Edges ``(a, b)`` between digests of ``sets (digest, low, n, tokens, fp)`` that connect
    all, and only, those which pairs of the similarity ``share`` connect.

    First come the pairs that SimHash's pigeonhole index links, as far as their whole sets
    are of the share; groups of copies are one component after that. While large buckets of the index hold many pairs of different components, every member
    of such a bucket is compared with the bucket's pivot, in rounds. Of the pairs that are
    left, those are compared whole whose common prefix shingles allow the share.
    """
    num, den = share
    index = sets.select(F.explode("tokens").alias("token"), "digest", "n")
    met = index.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    index = written(index.join(met, "token", "left_semi"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` whose whole sets are of the share; equal sets are one digest."""
        pairs = written(pairs)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
        few = 2 * pairs.count() <= _FEW  # else these are shuffled
        wanted = F.broadcast(wanted) if few else wanted
        ids = sets.select("digest", "low").join(wanted, "digest", "left_semi").select(F.col("low").alias("_low")).distinct()
        ids = F.broadcast(ids) if few and isinstance(ids.schema["_low"].dataType, T.IntegralType) else ids
        texts = docs.join(ids, F.col("id").eqNullSafe(F.col("_low")), "left_semi")
        whole = _sets(texts, width).join(wanted, "digest", "left_semi").dropDuplicates(["digest"]).select("digest", "tokens")
        whole = written(whole)
        a, b = (whole.select(F.col("digest").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
        both = F.size(F.array_intersect("ta", "tb"))
        return pairs.join(a, "a").join(b, "b").where(both * (num + den) >= num * (F.size("ta") + F.size("tb"))).select("a", "b")

    def sizes_allow(a: str, b: str) -> Column:
        return F.least(f"{a}.n", f"{b}.n") * den >= F.greatest(f"{a}.n", f"{b}.n") * num

    def joined(found: DataFrame) -> DataFrame:
        roots = written(components(found))
        return written(index.join(roots, F.col("digest") == F.col("node"), "left").select(*index.columns, F.coalesce("root", "digest").alias("root")))

    found, before, idle = written(verified(_near_fingerprints(sets.select("digest", "fp")))), None, 0
    labelled = joined(found)
    for _ in range(_ROUNDS):
        each = labelled.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("own"))
        left = each.agg(F.sum(F.col("c") * F.col("c") - F.col("own")), F.sum("c")).first()
        # rounds that link little are of buckets whose sets are unlike: two of them in a row end it
        idle = idle + 1 if before and (left[0] or 0) > 0.9 * before else 0
        if (left[0] or 0) <= 2 * _PAIRS * (left[1] or 0) or left[0] == before or idle == 2:
            break
        before = left[0]
        pivots = labelled.groupBy("token").agg(
            F.max_by(F.struct("digest", "root", "n"), F.xxhash64("root", "digest")).alias("pivot"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c")
        ).where(f"lo != hi and c > {2 * _PAIRS}").select("token", "pivot.*").alias("p")
        fresh = labelled.alias("x").join(pivots, "token").where((F.col("x.root") != F.col("p.root")) & sizes_allow("x", "p"))
        fresh = verified(fresh.select(F.col("x.digest").alias("a"), F.col("p.digest").alias("b")).distinct())
        found = written(found.unionByName(fresh).distinct())
        labelled = joined(found)
    # beyond their prefixes, two sets share at most all that the larger has left there
    reach = F.col("met") + F.ceil(F.greatest("na", "nb") * num / den) - 1
    pairs = labelled.alias("x").join(labelled.alias("y"), "token").where((F.col("x.root") < F.col("y.root")) & sizes_allow("x", "y"))
    pairs = pairs.groupBy(F.col("x.digest").alias("a"), F.col("y.digest").alias("b")).agg(F.count(F.lit(1)).alias("met"), F.first("x.n").alias("na"), F.first("y.n").alias("nb"))
    rest = verified(pairs.where(reach * (num + den) >= num * (F.col("na") + F.col("nb"))).select("a", "b"))
    return found.unionByName(rest)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: tuple[int, int] = (4, 5), width: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: of each group that pairs of the Jaccard similarity
    ``share`` (a fraction) or more connect, the document with the smallest id. Rows that
    repeat that id stay with it, and so do rows without an id. Texts without words are
    copies of one another."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    sets = written(_sets(rows, width, share, _common(rows, width)))
    distinct = written(sets.groupBy("digest").agg(F.min("id").alias("low")))
    one = sets.join(distinct.withColumnRenamed("digest", "_d"), (F.col("digest") == F.col("_d")) & F.col("id").eqNullSafe(F.col("low"))).select("digest", "low", "n", "tokens", "fp")
    roots = components(links(rows, one, share, width))
    joined = written(distinct.join(roots, F.col("digest") == F.col("node"), "left").select("digest", "low", F.coalesce("root", "digest").alias("root")))
    lowest = joined.groupBy("root").agg(F.min("low").alias("lowest"))
    classes = joined.join(lowest, "root").select("digest", "lowest")
    name = free_name("_go", docs.columns)
    go = sets.select("id", "digest").join(classes, "digest").where("id != lowest").select(F.col("id").alias(name)).distinct()
    return docs.join(go, F.col(id_col) == F.col(name), "left_anti")
