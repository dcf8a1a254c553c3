"""What only larger tables and rarer values show."""

import random
import tracemalloc
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from driftwood.functions import scalars
from driftwood.operators import ranges, routing, vectors
from driftwood.plans import compaction
from tests.oracle import connect, difference


def test_choose_config_decides_ties(spark):
    rows = [(1, 5, True, k) for k in (9, 4, 7)] + [(1, 5, False, 1), (2, None, False, 8), (2, -1, False, 3), (2, -1, None, 6), (3, -(1 << 63), True, 2)]
    configs = spark.createDataFrame(rows, "node long, version long, is_stored boolean, key long")
    for seed in range(6):
        mixed = configs.orderBy(F.rand(seed)).coalesce(1)
        assert {r.node: r.key for r in routing.choose_config(mixed, ["node"]).collect()} == {1: 4, 2: 3, 3: 2}


def test_choose_config_as_its_sql_at_sf01(spark):
    sf = "/root/testdata/sf0.1"
    assert difference(connect(sf), queries()["choose_config"](spark, sf), oracle_sql()["choose_config"]) is None


def test_guess_format_of_large_keys(spark, sf, tmp_path):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.withColumn("o_orderkey", F.col("o_orderkey") * 40_000 + F.col("o_orderkey") % 12).write.parquet(f"{tmp_path}/orders.parquet")
    con = connect("/nowhere")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert difference(con, queries()["guess_format"](spark, str(tmp_path)), oracle_sql()["guess_format"]) is None
    late = F.lit(datetime(2041, 1, 1, tzinfo=UTC).timestamp() * 1000)
    assert spark.range(1).select(scalars.format_number_cell(late)).first()[0] == "2,240,611,200,000"  # the default stays


def _peak_mb(blocks: list[tuple[list[int], np.ndarray]], k: int | None) -> tuple[int, float]:
    """Rows that a block of vectors and one of queries give, and the memory that takes."""
    (ids, v), (query_ids, q) = blocks
    tracemalloc.start()
    rows = sum(b.num_rows for b in (vectors._all_pairs(ids, v, query_ids, q) if k is None else vectors._top(ids, v, query_ids, q, k)))
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    return rows, peak


def test_products_of_large_blocks_take_little_memory():
    rng = np.random.default_rng(4)
    block = lambda n: (np.arange(n), rng.normal(size=(n, 8)))
    few, many = [block(20_000), block(500)], [block(20_000), block(2_000)]
    for k in (None, 5):
        (a, small), (b, large) = _peak_mb(few, k), _peak_mb(many, k)
        assert (a, b) == ((20_000 * 500, 20_000 * 2_000) if k is None else (2_500, 10_000))
        assert max(small, large) < 100  # all products of ``many`` take 320 MB


def test_nearest_with_many_copies(spark):
    rng = np.random.default_rng(9)
    kinds = rng.normal(size=(7, 5))
    rows = [(i, kinds[i % 7].tolist()) for i in rng.permutation(3000).tolist()]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = e.where("vec_id % 500 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    for size in (64, 1 << 16):
        got = {(r.query_id, r.vec_id) for r in vectors.knn_many(e, asked, 4, size, 4).collect()}
        assert got == {(a, a % 7 + 7 * i) for a in range(0, 3000, 500) for i in range(4)}
    assert vectors.knn_many(e, asked, None, 500, 4).count() == 18_000


def test_top_of_a_block_as_a_sort():
    rng = np.random.default_rng(3)
    made = lambda n: (lambda x: x / np.linalg.norm(x, axis=1)[:, None])(rng.normal(size=(n, 4)))
    ids, v, q = rng.permutation(9000), made(9000), made(40)
    for k, most in ((1, 1 << 12), (5, 1 << 14), (10_000, 1 << 20)):
        got = pa.Table.from_batches(vectors._top(ids, v, np.arange(40), q, k, most)).to_pylist()
        want = {(j, int(ids[i])) for j in range(40) for i in np.argsort(-(v @ q[j]))[:k]}
        assert {(r["query_id"], r["vec_id"]) for r in got} == want and len(got) == len(want)


def _rows_written(monkeypatch, job) -> tuple[object, int]:
    """What a job gives, and the rows of the tables it writes on its way."""
    rows, plain = [], ranges.checkpointed

    def counted(df):
        out = plain(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(ranges, "checkpointed", counted)
    return job(), sum(rows)


@pytest.mark.parametrize("past", [True, False])
def test_chunks_write_their_rows_once(spark, monkeypatch, past):
    items = spark.range(20_000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") * 7919 % 100).alias("size"))
    found, rows = _rows_written(monkeypatch, lambda: ranges.greedy_groups(items, ["g"], "id", "size", 300, past=past))
    assert rows < 25_000
    assert found.count() == 20_000 and found.agg(F.max("group_no")).first()[0] > 800


@pytest.mark.parametrize("past", [True, False])
@pytest.mark.parametrize("target", [1, 17, 100, 5_000, 100_000])
def test_chunks_by_fold_at_many_targets(spark, past, target):
    rng = random.Random(target)
    rows = [(g, i, rng.choice([0, 0, 1, 5, 30, 90, 400])) for g in (None, "a", "b", *map(str, range(30))) for i in range(rng.choice([1, 2, 400]))]
    want, total, group, some, now = {}, 0, 0, False, ()
    for g, i, n in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        if now != (g,):
            now, total, group, some = (g,), 0, 0, False
        if past and some and total + n > target:
            total, group = 0, group + 1
        total, some = total + n, True
        want[g, i] = group
        if not past and total >= target:
            total, group = 0, group + 1
    items = spark.createDataFrame(rows, "g string, i long, size long")
    assert {(r.g, r.i): r.group_no for r in ranges.greedy_groups(items, ["g"], "i", "size", target, past=past).collect()} == want


def test_groups_are_reached_as_by_comparing(spark):
    rng = random.Random(8)
    key = lambda: rng.choice([None, *range(60)])
    files = spark.createDataFrame([(rng.choice([None, 1, 5, 9]), key(), key()) for _ in range(300)], "bytes long, min_key long, max_key long")
    groups = spark.createDataFrame([(rng.choice([None, *range(60)]), rng.randrange(60), rng.random()) for _ in range(80)], "lo long, hi long, dup double")
    reach = F.col("min_key").isNull() | F.col("max_key").isNull() | ((F.col("min_key") <= F.col("hi")) & (F.col("max_key") >= F.col("lo")))
    want = groups.join(files, reach, "left").groupBy("lo", "hi", "dup").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("bytes").alias("n"))
    got = compaction.reached(groups, files)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
