"""Embeddings: quantising, closeness, exact and inverted-file search.

An index is a table ``(vec_id, unit, cell)`` and a table of centroids. Vectors meet
centroids in matrix products of Arrow batches; centroids are configuration-sized (rows over
the cell size) and are broadcast only below a checked size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.operators.ranges import RANGE, in_ranges, running
from driftwood.sources.shared import checkpointed

#: Below so many vectors a search goes through all of them.
FLAT_LIMIT = 1024
#: Sizes at which an index is built anew, once each.
REBUILD_AT = (1024, 4096, 16384)
#: Rounds of the clustering.
ROUNDS = 4
#: Bytes of centroids that the driver may hold and broadcast.
CENTROID_BYTES = 64 << 20
#: Rows of the blocks that meet in a task: few copies of the rows are sent, and two blocks of
#: 64 dimensions take 64 MB.
VECTOR_BLOCK = QUERY_BLOCK = 1 << 16
#: Share of the cells that a search of many queries probes.
PROBE_SHARE = 0.75


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, not once an entry."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(v: Column) -> Column:
    return _let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of the two."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def closeness(a: Column, b: Column) -> Column:
    """1 minus the distance of two unit vectors: 1 for equal ones."""
    return closeness_of_dot(dot(a, b))


def closeness_of_dot(d: Column) -> Column:
    return 1 - F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * d))


def encode_q8(v: Column, group: int = 32, dims: int | None = None) -> Column:
    """{data array<int>, scales array<double>}: the vector (its first ``dims`` entries), of
    unit length, in groups of bytes with one scale each, rounded half up."""
    def scale(g: Column) -> Column:
        return F.aggregate(g, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x))) / 127

    def steps(g: Column) -> Column:
        return _let(scale(g), lambda s: F.transform(g, lambda x: F.when(s > 0, F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x / s + 0.5)))).otherwise(0).cast("int")))

    def encoded(u: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size(u) / group).cast("int") - 1), lambda g: F.slice(u, g * group + 1, F.lit(group)))
        return F.struct(F.flatten(F.transform(groups, steps)).alias("data"), F.transform(groups, scale).alias("scales"))

    return _let(unit(F.slice(v, 1, dims) if dims else v), encoded)


def decode_q8(q: Column, group: int = 32) -> Column:
    return F.transform(q["data"], lambda x, i: x * q["scales"][F.floor(i / group).cast("int")])


def half_scales(q: Column) -> Column:
    """Scales as the nearest 16-bit floats, for storing."""

    @F.pandas_udf("array<double>")
    def half(scales: pd.Series) -> pd.Series:
        flat = np.concatenate([np.zeros(0), *scales]).astype(np.float16).astype(np.float64)
        return pd.Series(np.split(flat, np.cumsum([len(s) for s in scales])[:-1]), dtype=object)[: len(scales)]

    known = F.coalesce(q["scales"], F.array().cast("array<double>"))
    return F.struct(q["data"].alias("data"), F.when(q["scales"].isNotNull(), half(known)).alias("scales"))


def mean_unit(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """The mean of each group's vectors, of unit length. Entries are averaged by (group,
    place), so a group of any size is summed map-side."""
    means = df.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    out = means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    return out.select(*by, unit(F.col("mean")).alias("mean"))


def knn_exact(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """``vec_id, closeness`` of the k nearest; ties by id."""
    q = np.asarray(query, float)
    q = (q / (np.linalg.norm(q) or 1)).tolist()
    return vectors.select("vec_id", closeness(unit(F.col("embedding")), F.array(*map(F.lit, q))).alias("closeness")).orderBy(F.desc("closeness"), "vec_id").limit(k)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _found(query_ids: np.ndarray, vec_ids: np.ndarray, close: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query_ids), pa.array(vec_ids), pa.array(close)], ["query_id", "vec_id", "closeness"])


def _close(d: np.ndarray) -> np.ndarray:
    return 1 - np.sqrt(np.maximum(0, 2 - 2 * d))


def _all_pairs(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """All pairs, at most about ``most`` at a time."""
    width = min(len(ids), 1 << 10)
    height = max(1, most // width)
    for lo in range(0, len(query_ids), height):
        for at in range(0, len(ids), width):
            d = q[lo : lo + height] @ v[at : at + width].T
            yield _found(np.repeat(query_ids[lo : lo + height], d.shape[1]), np.tile(ids[at : at + width], d.shape[0]), _close(d).ravel())


def _top(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Per query the ``k`` closest rows, ties by id. Products are made and compared with the
    closest so far some ``most`` at a time. What passes is computed anew, pair by pair, so
    that equal vectors are equally close wherever they stand in a matrix."""
    width = max(k, 1 << 11)
    height = max(1, most // width)
    for lo in range(0, len(query_ids), height):
        part = q[lo : lo + height]
        bar = np.full(len(part), -np.inf)
        rows, cols, close, fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0

        def pruned(rows: np.ndarray, cols: np.ndarray, close: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.lexsort((ids[cols], -close, rows))
            rows, cols, close = rows[order], cols[order], close[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            return rows[rank < k], cols[rank < k], close[rank < k]

        for at in range(0, len(ids), width):
            d = part @ v[at : at + width].T
            if d.shape[1] >= k:
                # not above the k-th largest so far; rounding may set equal ones apart
                bar = np.maximum(bar, np.partition(d, -k, axis=1)[:, -k] - 1e-9) if not at else bar
            r, c = np.nonzero(d >= bar[:, None])
            for i in range(0, len(r), most // 8):
                a, b = r[i : i + most // 8], c[i : i + most // 8] + at
                rows, cols, close = np.concatenate((rows, a)), np.concatenate((cols, b)), np.concatenate((close, _close((part[a] * v[b]).sum(axis=1))))
                fresh += len(a)
                if fresh >= most // 8 or not at:
                    (rows, cols, close), fresh = pruned(rows, cols, close), 0
                    last = np.searchsorted(rows, np.arange(len(part)), "right") - 1
                    full = (last >= k - 1) & (np.bincount(rows, minlength=len(part)) == k)
                    far = 1 - close[last[full]]
                    bar[full] = np.maximum(bar[full], 1 - far * far / 2 - 1e-9)
        rows, cols, close = pruned(rows, cols, close)
        yield _found(query_ids[lo + rows], ids[cols], close)


def _block_products(left: DataFrame, right: DataFrame, by: list[str], k: int | None) -> DataFrame:
    """``query_id, vec_id, closeness`` from matrix products of the blocks ``(vec_id, unit)``
    and ``(query_id, unit)`` that share the columns ``by``. A task holds one block of each
    and sends what it finds in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units = ([], []), ([], [])
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            found, m = batch.column("id").to_numpy(), _matrix(batch.column("unit"))
            for i in (0, 1):
                if (asks == i).any():
                    ids[i].append(found[asks == i])
                    units[i].append(m[asks == i])
        if ids[0] and ids[1]:
            joined = []
            for i in (0, 1):
                joined += [np.concatenate(ids[i]), np.concatenate(units[i])]
                units[i].clear()
            yield from _all_pairs(*joined) if k is None else _top(*joined, k)

    both = left.select(*by, F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "unit").unionByName(right.select(*by, F.lit(True).alias("asks"), F.col("query_id").alias("id"), "unit"))
    return both.groupBy(*by).applyInArrow(run, "query_id long, vec_id long, closeness double")


def _best(part: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query; each block has sent some ``k`` of its own."""
    top = part.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("closeness")).alias("d"), "vec_id"))), 1, k).alias("t"))
    return top.select("query_id", F.explode("t").alias("x")).select("query_id", "x.vec_id", (-F.col("x.d")).alias("closeness"))


def _dealt(c: str, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def knn_many(vectors: DataFrame, queries: DataFrame, k: int | None, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, vec_id, closeness``: the k nearest of each query, or all with ``k`` None.
    Vectors and queries are cut into blocks of about the given rows, or smaller ones of
    vectors where there would be fewer blocks than cores. A task holds one block of each
    whatever the tables' size; every vector meets every query once."""
    units = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), unit(F.col("embedding")).alias("unit"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), unit(F.col("embedding")).alias("unit"))
    n, cores = vectors.count(), vectors.sparkSession.sparkContext.defaultParallelism
    v, q = max(1, -(-n // vector_block), min(cores, n // 4096)), max(1, -(-queries.count() // query_block))
    left = units.withColumn("vb", _dealt("vec_id", v)).withColumn("qb", _every(q))
    right = asked.withColumn("qb", _dealt("query_id", q)).withColumn("vb", _every(v))
    part = _block_products(left, right, ["vb", "qb"], k)
    return part if k is None else _best(part, k)


def _nearest(units: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``units`` with the ``cell`` of the largest dot product, the first of equals."""
    shipped = units.sparkSession.sparkContext.broadcast(centroids.astype(np.float32))

    @F.pandas_udf("int")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = shipped.value
        for s in batches:
            yield pd.Series((np.stack(s).astype(np.float32) @ c.T).argmax(axis=1) if len(s) else [], dtype="int32")

    return units.withColumn("cell", cell("unit"))


def cluster(vectors: DataFrame, cell_size: int) -> tuple[DataFrame, np.ndarray]:
    """(``vec_id, unit, cell``, centroids): spherical k-means with k = rows / cell size, up
    to what CENTROID_BYTES hold; beyond, cells grow with the rows and nothing is left out.

    Seeds are the vectors at equal strides in order of id, then four rounds of assigning to
    the nearest centroid and averaging; cells without vectors go. The driver holds the
    centroids, never the vectors.
    """
    units = vectors.select("vec_id", F.transform(unit(F.col("embedding")), lambda x: x.cast("float")).alias("unit"))
    units = running(in_ranges(units, [F.col("vec_id")]), [F.col("vec_id")], sums={"_n": F.lit(1)}).drop(RANGE)
    units = checkpointed(units.withColumn("_n", F.col("_n") - 1))
    n = units.count()
    if not n:
        return units.drop("_n").withColumn("cell", F.lit(0)), np.zeros((0, 0), np.float32)
    dims = units.select(F.size("unit")).first()[0]
    k = max(1, min(int(n / cell_size + 0.5), CENTROID_BYTES // (4 * dims)))
    # place i * n // k for some i: where the quotient below changes
    seed = F.floor((F.col("_n") * k + k - 1) / n) != F.floor(((F.col("_n") - 1) * k + k - 1) / n)
    rows = units.where(seed).orderBy("vec_id").select("unit").collect()
    centroids = np.array([r.unit for r in rows], np.float32)
    units = units.drop("_n")
    for _ in range(ROUNDS):
        means = mean_unit(_nearest(units, centroids), ["cell"], "unit").orderBy("cell").collect()
        centroids = np.array([r.mean for r in means], np.float32)
    return _nearest(units, centroids), centroids


def insert(index: DataFrame, fresh: DataFrame, centroids: np.ndarray) -> DataFrame:
    """New or changed vectors in their nearest cells; old versions of their ids go."""
    units = fresh.select("vec_id", F.transform(unit(F.col("embedding")), lambda x: x.cast("float")).alias("unit"))
    return index.join(units.select("vec_id"), "vec_id", "left_anti").unionByName(_nearest(units, centroids))


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids, "vec_id", "left_anti")


def lookup(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids, "vec_id", "left_semi")


def search(index: DataFrame, centroids: np.ndarray, query: list[float], k: int, probe_budget: int, cell_size: int) -> DataFrame:
    """``vec_id, closeness`` of the k nearest in the cells nearest to the query: as many
    cells as the probe budget has cell sizes, one at least. The cells are known before the
    job, so a table partitioned by cell is read only there."""
    q = np.asarray(query, float)
    q = q / (np.linalg.norm(q) or 1)
    probes = max(1, -(-probe_budget // cell_size))
    cells = np.argsort(-(centroids @ q), kind="stable")[:probes].tolist()
    found = index.where(F.col("cell").isin(cells)) if len(cells) < len(centroids) else index
    # stored entries have 32 bits: made unit length again in 64, else a vector is off by 1e-4 from itself
    return found.select("vec_id", closeness(unit(F.col("unit")), F.array(*map(F.lit, q.tolist()))).alias("closeness")).orderBy(F.desc("closeness"), "vec_id").limit(k)


def rebuild_due(count: int, done: list[int]) -> int | None:
    """The threshold, if one is passed at which the index has not been built yet."""
    passed = [t for t in REBUILD_AT if count > t and t not in done]
    return max(passed, default=None)




def search_many(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, share: float = PROBE_SHARE, block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, vec_id, closeness``: the k nearest of each query ``(query_id, embedding)``
    in the share of cells whose centroids are nearest to it, four cells at least. Probed
    cells grow with the cells, so recall does not fall as a table grows. Cells are cut into
    blocks of about ``block`` vectors and queries into blocks of about ``query_block``."""
    probes = min(len(centroids), max(4, math.ceil(share * len(centroids))))
    shipped = index.sparkSession.sparkContext.broadcast(centroids.astype(np.float64))

    @F.pandas_udf("array<int>")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(np.argsort(-(np.stack(s) @ shipped.value.T), axis=1, kind="stable")[:, :probes].astype(np.int32)) if len(s) else [], dtype=object)

    sizes = checkpointed(index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), unit(F.col("embedding")).alias("unit")).withColumn("cell", F.explode(cells("unit")))
    q = max(1, -(-queries.count() // query_block))
    right = asked.join(F.broadcast(sizes), "cell").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("qb", _dealt("query_id", q))
    left = index.select(F.col("vec_id").cast("long").alias("vec_id"), unit(F.col("unit")).alias("unit"), "cell")
    left = left.join(F.broadcast(sizes), "cell").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("qb", _every(q))
    return _best(_block_products(left, right, ["cell", "b", "qb"], k), k)
