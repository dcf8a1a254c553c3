"""Rules of the engine on small tables: logs, collections, filters, streams, archives."""

import itertools
import uuid

import pytest
from pyspark.sql import functions as F

from driftwood import model
from driftwood.functions import filters, scalars
from driftwood.operators import archive, lww, routing, vectors
from driftwood.sources import files
from driftwood.sources.collection import Collection
from driftwood.sources.shared import shared_dir

LOG = "key string, time long, seq long, op string, set_cols array<string>, a long, b string"
ROWS = [
    ("x", 1, 1, "write", ["a", "b"], 1, "one"), ("x", 2, 2, "write", ["a"], None, None), ("y", 1, 3, "write", ["a"], 5, None), ("y", 3, 4, "delete", [], None, None),
    ("y", 3, 5, "write", ["b"], None, "tie"), ("z", 1, 6, "write", ["a", "b"], 7, "old"), ("z", 2, 7, "delete", [], None, None), ("z", 4, 8, "write", ["b"], None, "new"), (None, 1, 9, "write", ["a"], 3, None),
]


def as_set(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(ROWS, LOG)


def test_absent_clear_and_delete(log):
    """A clear is a null that counts, an absent column leaves the older value; a delete wins
    ties and stays a barrier for what is older."""
    assert as_set(lww.resolve(log)) == {("x", 2, None, "one"), ("z", 4, None, "new"), (None, 1, 3, None)}
    assert as_set(lww.deleted_keys(log)) == {("y", 3)}


def test_order_of_rows_does_not_matter(spark):
    want = None
    for rows in itertools.islice(itertools.permutations(ROWS), 0, 300000, 60001):
        got = as_set(lww.resolve(spark.createDataFrame(rows, LOG).repartition(3)))
        want = want or got
        assert got == want


def test_compaction_changes_no_read(log):
    once = lww.compacted(log)
    assert as_set(lww.resolve(once)) == as_set(lww.resolve(log)) == as_set(lww.resolve(lww.compacted(once)))
    assert as_set(lww.resolve(once.unionByName(log))) == as_set(lww.resolve(log))


def test_empty_log(spark, log):
    assert lww.resolve(log.where("false")).count() == 0 and lww.compacted(log.where("false")).count() == 0


def test_collection(spark):
    c = Collection(spark, f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}", "a long, b string")
    rows = lambda *r: spark.createDataFrame(r, "key string, seq long, a long")
    assert c.get_keys().count() == 0
    c.write(rows(("x", 1, 10), ("y", 2, 20)), "2024-01-01 00:00:00", "seq")
    c.update(rows(("x", 3, 11), ("nobody", 4, 1)), "2024-01-02 00:00:00", "seq")
    before = as_set(c.get_column("a").select("key", "value"))
    assert before == {("x", 11), ("y", 20)}
    c.compact()
    assert as_set(c.get_column("a").select("key", "value")) == before
    c.delete(spark.createDataFrame([("y", 5)], "key string, seq long"), "2024-01-03 00:00:00", "seq")
    assert c.clean() == 2
    assert as_set(c.get_column("a").select("key", "value")) == {("x", 11)} and c.get_single_field("y", "a").count() == 0
    c.compact(size=10)
    assert as_set(c.rows().select("key", "a")) == {("x", 11)}


@pytest.mark.parametrize("text,want", [("", {0, 1, 2}), ("a|", {0, 1, 2}), ("apple", {0}), ("!apple", {1, 2}), ("pie & !apple", {1}), (" APPLE | tart ", {0, 2}), ("!", set())])
def test_match_filter(spark, text, want):
    df = spark.createDataFrame([(0, "Apple pie"), (1, " cherry PIE "), (2, "tart")], "i int, t string")
    assert {r.i for r in df.where(filters.match_filter(text, F.col("t"))).collect()} == want


def test_search_needs_a_term():
    with pytest.raises(ValueError):
        filters.search_all(F.lit("x"), [])


def test_paths(spark):
    df = spark.createDataFrame([("a/b",), ("a//b",), ("../a",), ("",), ("é" * 501,)], "p string")
    assert [r[0] for r in df.select(filters.valid_path(F.col("p"))).collect()] == [True, False, False, False, False]


def test_rounding_and_ranges(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (0.4,)], "x double")
    assert [r[0] for r in df.select(scalars.js_round(F.col("x"))).collect()] == [-2, 3, 0]
    ranges = spark.createDataFrame([(1, 0.0, 1.0)], "id long, a double, b double")
    assert as_set(routing.subtract(ranges, spark.createDataFrame([(0.2, 0.3), (0.25, 0.5), (0.9, 2.0)], "a double, b double"))) == {(1, 0.0, 0.2), (1, 0.5, 0.9)}
    assert as_set(routing.subtract(ranges, spark.createDataFrame([(-1.0, 2.0)], "a double, b double"))) == set()


def test_quantising(spark):
    df = spark.createDataFrame([([0.0] * 40,), ([float(i - 20) for i in range(40)],)], "v array<float>")
    for r in df.select(vectors.unit(F.col("v")).alias("u"), vectors.decode_q8(vectors.encode_q8(F.col("v"))).alias("d"), vectors.encode_q8(F.col("v")).alias("q")).collect():
        assert all(abs(x - y) <= r.q.scales[i // 32] / 2 + 1e-12 for i, (x, y) in enumerate(zip(r.u, r.d, strict=True)))


def test_index_life(spark):
    rows = [("p", 1, 1, "set", 5, None), ("p", 2, 2, "delete", 0, True), ("p", 3, 3, "unmark", 0, None), ("q", 1, 4, "set", 7, None), ("q", 2, 5, "delete", 0, True), ("q", 3, 6, "drop_value", 0, None), ("r", 1, 7, "set", 1, None), ("r", 2, 8, "purge", 0, None), ("s", 5, 9, "set", 3, None), ("s", 4, 10, "delete", 0, None)]
    index = archive.fold_index(spark.createDataFrame(rows, "path string, time long, seq long, op string, size long, marked boolean"))
    assert {(r.path, r.state, r.size) for r in index.collect()} == {("p", "live", 5), ("q", "deleted", 0), ("s", "live", 3)}


def test_log_files(spark):
    at = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    spark.createDataFrame([('{"kind": "a", "n": 1}',), ('{"kind": "b", "n"',), ("",)], "value string").coalesce(1).write.text(at)
    assert as_set(files.read_log(spark, at, "kind string, n long").select("kind", "n")) == {("a", 1)}
    names = spark.createDataFrame([("pid7_born1_threadm_from5_to9_count3_idx.jsonl",), ("pid8_born2_threadm_from6.jsonl.lz4",), ("other",)], "f string")
    assert as_set(files.log_catalog(names, "f").select("pid", "to_time", "count")) == {(7, 9, 3), (8, None, None)}


def test_writes_and_deletes_as_log(spark):
    df = spark.createDataFrame([("x", 1)], "key string, a long")
    made = model.merged(model.writes(df, "key", F.lit(1), F.lit(1)), model.deletes(df, "key", F.lit(2), F.lit(2)))
    assert lww.resolve(made).count() == 0
