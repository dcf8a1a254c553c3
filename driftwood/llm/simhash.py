"""Near duplicates by 64-bit SimHash, linked through a generalised pigeonhole index.

The bits of a fingerprint are grouped into partitions and partition i gets a threshold
t_i >= -1 with sum(t_i + 1) = k + 1. Two fingerprints at k or fewer differing bits then
differ by t_i or fewer in some partition i (one with t_i = -1 needs no probe). Bits that
agree or disagree together share a partition; the number of partitions and the thresholds
come from dynamic programming on estimated candidate counts. Each fingerprint is indexed
under its own value in every probed partition and probes the values within t_i bits of it;
what a probe meets is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.llm.common import free_name, slices, written
from driftwood.llm.components import components

_STEP = 1 << 16
#: A partition whose threshold asks for more probes than this is not considered; four or
#: more partitions always have a plan of one probe each.
_MOST_PROBES = 4096


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of unsigned 64-bit hashes: a bit is set where over half have it."""
    set_bits = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _STEP):
        set_bits += np.unpackbits(hashes[lo : lo + _STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the text's word shingles; 0 for a text without words. A bit is set where
    over half of the shingles' XXH64 have it."""
    words = text.lower().split()  # bytes: A-Z alone, and \\x20 \\x09-\\x0D alone
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(width, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - np.array([len(w) + 1 for w in words]))[: len(words) - width + 1].tolist()
    stops = (ends - 1)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return of_hashes(np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts, stops, strict=True)), np.uint64, len(starts)))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)`` for each row; fp is the fingerprint as a signed long. Null: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t or b"", width) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())]))


def _bits(found: np.ndarray) -> np.ndarray:
    return np.unpackbits(found.astype(np.int64).view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups of like size; each group grows by the bit that
    correlates most with it. Bit 0 is the most significant."""
    bits = bits if len(bits) else np.zeros((1, 64), np.float32)
    spread = bits.std(axis=0)
    scaled = (bits - bits.mean(axis=0)) / np.where(spread, spread, 1)
    like = np.abs(scaled.T @ scaled) / max(len(bits), 1)
    free, out = list(range(64)), []
    for g in range(parts):
        want = 64 // parts + (g < 64 % parts)
        group = [max(free, key=lambda i: (round(float(like[i, free].sum()), 6), -i))]
        free.remove(group[0])
        while len(group) < want:
            best = max(free, key=lambda i: (round(float(like[i, group].sum()), 6), -i))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def allocate(costs: list[list[float]], k: int) -> list[int]:
    """Thresholds that minimise the summed cost. ``costs[i][t + 1]`` is that of threshold
    t in partition i; sum(t_i + 1) is k + 1."""
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * (k + 1)
    for cost in costs:
        best = [min(((best[s - u][0] + cost[u], [*best[s - u][1], u - 1]) for u in range(s + 1)), key=lambda x: x[0]) for s in range(k + 2)]
    return best[k + 1][1]


def plan(sample: np.ndarray, rows: int, k: int = 3, most_parts: int = 6) -> list[tuple[list[int], int]]:
    """``(bits, threshold)`` of the partitions to probe, for ``rows`` distinct fingerprints
    of which ``sample`` is a part. The plan changes the cost alone, never the result."""
    bits = _bits(sample[:2048])
    n, rows, chosen = len(bits), max(rows, 2), (float("inf"), [])
    pairs = max(n * (n - 1) / 2, 1)
    for parts in range(1, most_parts + 1):
        groups, costs = group_bits(bits, parts), []
        for group in groups:
            own = bits[:, group]
            apart = own @ (1 - own.T)
            near = np.bincount(np.rint(apart + apart.T)[np.triu_indices(n, 1)].astype(np.int64), minlength=k + 1) if n > 1 else np.zeros(k + 1)
            costs.append([0.0])
            for t in range(k + 1):
                ball = sum(comb(len(group), i) for i in range(t + 1))
                share = max(near[: t + 1].sum() / pairs, ball / 2.0 ** len(group))
                costs[-1].append(rows * (ball + 1.0) + share * rows * rows / 2 if ball <= _MOST_PROBES else float("inf"))
        at = allocate(costs, k)
        total = sum(c[t + 1] for c, t in zip(costs, at, strict=True))
        if total < chosen[0] and sum(t + 1 for t in at) == k + 1:  # else no allocation has a finite cost
            chosen = total, [(g, t) for g, t in zip(groups, at, strict=True) if t >= 0]
    return chosen[1]


def _mask(group: list[int] | tuple[int, ...]) -> int:
    value = sum(1 << (63 - b) for b in group)
    return value - (1 << 64) if value >> 63 else value


def _keyed(fps: DataFrame, parts: list[tuple[list[int], int]], probe: bool) -> DataFrame:
    """Rows ``(part, value, ...)``: each fingerprint under its own value in each partition
    or, as a probe, under each value within the partition's threshold."""

    def keys(i: int, group: list[int], most: int) -> Column:
        own = F.col("fp").bitwiseAND(F.lit(_mask(group)))
        flips = [_mask(c) for t in range(most + 1 if probe else 1) for c in combinations(group, t)]
        return F.transform(F.array(*map(F.lit, flips)), lambda flip: F.struct(F.lit(i).alias("part"), own.bitwiseXOR(flip.cast("long")).alias("value")))

    every = F.concat(*(keys(i, group, most) for i, (group, most) in enumerate(parts)))
    return fps.select("*", F.explode(every).alias("key")).select("*", "key.*").drop("key")


def links(fps: DataFrame, k: int = 3, rounds: int = 2, sample_rows: int = 2048) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fps (fp, n)`` that connect all, and
    only, those which pairs at ``k`` or fewer differing bits connect.

    First, ``rounds`` times, every member of an index bucket is compared with the bucket's
    pivot (of the members outside the component of the last pivot, that with most rows).
    Buckets that this leaves in one component need no more work; in the others, members of
    different components are compared by probing. So a bucket of many copies costs its size,
    and no pair within a component is made.
    """
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).select("fp").toArrow().column("fp").to_numpy()
    parts = plan(sample, fps.count(), k)
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= k
    index = _keyed(fps, parts, False)
    found, labelled = None, index.withColumn("root", F.col("fp"))
    for _ in range(rounds):
        pivots = labelled.groupBy("part", "value").agg(
            F.max_by(F.struct("fp", "root"), F.struct("n", "fp")).alias("pivot"), F.min("root").alias("lo"), F.max("root").alias("hi")
        ).where("lo != hi").select("part", "value", F.col("pivot.fp").alias("pivot"), F.col("pivot.root").alias("pivot_root"))
        fresh = labelled.join(pivots, ["part", "value"]).where((F.col("root") != F.col("pivot_root")) & near("fp", "pivot")).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
        found = written((fresh if found is None else found.unionByName(fresh)).distinct())
        roots = written(components(found))
        labelled = index.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "part", "value", F.coalesce("root", "fp").alias("root"))
    labelled = written(fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")))
    index = _keyed(labelled, parts, False)
    probes = _keyed(labelled, parts, True)
    if all(t == 0 for _, t in parts):
        open_ = index.groupBy("part", "value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("part", "value")
        index = index.join(open_, ["part", "value"], "left_semi")
        probes = probes.join(open_, ["part", "value"], "left_semi")
    a, b = index.alias("a"), probes.alias("b")
    rest = a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.root") < F.col("b.root")) & near("a.fp", "b.fp"))
    rest = rest.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    return found.unionByName(rest)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, k: int = 3) -> DataFrame:
    """``id``, ``fingerprint`` (16 hex digits), ``component_id`` for each row of ``docs``.

    The component id is the smallest id that links reach from the row, itself included
    (null if all of them are null). Texts without words, null ones too, have fingerprint
    zero and are linked like any other. Repeated rows give repeated rows; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = written(fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    distinct = written(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")))
    roots = components(links(distinct.select("fp", "n"), k))
    joined = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    joined = written(joined)
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = joined.join(lowest, "root").select("fp", "component_id")
    out = rows.join(classes, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    return out


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, k: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest id.
    Rows that repeat that id stay with it, and so do rows without an id."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, width=width, k=k)
    name = free_name("_go", docs.columns)
    go = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(go, F.col(id_col) == F.col(name), "left_anti")
