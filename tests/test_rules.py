"""Rules with inputs and outputs worked out by hand."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwood.functions import filters, scalars
from driftwood.operators import archive, logs, pathsummary, ranges, routing, stats, vectors
from driftwood.plans import compaction
from driftwood.sources import files
from driftwood.sources.collection import Collection
from driftwood.sources.shared import shared_dir
from driftwood.streaming import streams


def one_by_one(spark, values, kind, f):
    """What ``f`` makes of each value."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def fresh(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def test_render_trimmed(spark):
    texts = ["short", "0123456789abc", "a\nb\nc", "a\nb\nc\nlong enough", None]
    assert one_by_one(spark, texts, "string", lambda x: scalars.render_trimmed(x, 10, 2)) == ["short", "0123456...", "a\nb...", "a\nb...", None]


def test_space_case(spark):
    names = ["camelCaseName", "snake_case_name", "URL", "first  letter", "a1B", "x_1 y", "", "_lead"]
    assert one_by_one(spark, names, "string", scalars.space_case) == ["Camel Case Name", "Snake Case name", "URL", "First letter", "A1B", "X_1 Y", "", " Lead"]


def test_nice_stringify(spark):
    texts = ["plain", "", "true", "null", "undefined", "7 pieces", "-5", "-a", "[x]", "[x", "{Undefined}", "{NaN}", '"', 'say "hi"', "nul", " 5", None]
    shown = ["plain", '""', '"true"', '"null"', "undefined", '"7 pieces"', '"-5"', "-a", '"[x]"', "[x", '"{Undefined}"', '"{NaN}"', '"\\""', 'say "hi"', "nul", " 5", "{Undefined}"]
    assert one_by_one(spark, texts, "string", lambda x: scalars.nice_stringify(x, "string")) == shown
    assert one_by_one(spark, [True, False, None], "boolean", lambda x: scalars.nice_stringify(x, "boolean")) == ["", "false", "{Undefined}"]
    numbers = [1.0, -2.5, 0.1, 1e21, 123456789012.0, 1e-7, float("nan"), float("inf"), None]
    assert one_by_one(spark, numbers, "double", lambda x: scalars.nice_stringify(x, "double")) == ["1", "-2.5", "0.1", "1e+21", "123456789012", "1e-7", "{NaN}", "null", "{Undefined}"]
    back = ["", "{Undefined}", "{NaN}", "plain", '"7"', "7x", "[1,2]", " 5", "false"]
    assert one_by_one(spark, back, "string", scalars.nice_parse) == ["true", None, '"NaN"', '"plain"', '"7"', '"7x"', "[1,2]", '" 5"', "false"]


def test_cells(spark):
    numbers = [9007199254740991.0, -9007199254740991.0, float("inf"), float("nan"), 1262304000000.0, 1262304000001.0, 1234567.0, 2.5, None]
    assert one_by_one(spark, numbers, "double", scalars.format_number_cell) == [
        "Number.MAX_SAFE_INTEGER", "Number.MIN_SAFE_INTEGER", "+Infinity", "", "1,262,304,000,000", "2010/01/01 12:00:00 AM", "1,234,567", "2.50", ""
    ]
    texts = ["Error: bad", "https://a.org<here>", "http://a.org<here>", "https://a.org", "plain", None]
    assert one_by_one(spark, texts, "string", scalars.format_text_cell) == [" bad", "here", "http://a.org<here>", "https://a.org", "plain", ""]


def test_names_and_addresses(spark):
    hosted = "https://S2.example.org:4445/file/acc/my%20bucket/storage/storagerouting.json"
    urls = [hosted, "https://h.org/file/a/b/storage/storagerouting.json", "http://h.org/file/a/b/storage/storagerouting.json", "https://h.org/file/a/b"]
    assert [r and tuple(r) for r in one_by_one(spark, urls, "string", scalars.hosted_url)] == [("s2.example.org", 4445, "acc", "my bucket"), ("h.org", 443, "a", "b"), (None,) * 4, (None,) * 4]
    assert one_by_one(spark, urls[:2], "string", scalars.derived_source_name) == ["s2.example.org-4445", "h.org-443"]
    routed = lambda a, b: one_by_one(spark, urls[1:2], "string", lambda x: scalars.derived_source_name(x, F.lit(a), F.lit(b)))[0]
    assert [routed(0.25, 0.5), routed(0.0, 1.0), routed(0.5, 0.25)] == ["h.org-443-route-0.25-0.5", "h.org-443", "h.org-443"]
    assert one_by_one(spark, ["https://f002.backblazeb2.com/file/b!k/storage/storagerouting.json"], "string", scalars.derived_source_name) == ["b-k"]
    assert one_by_one(spark, ["a b", "..", "", "x" * 70, "é.1"], "string", scalars.sanitize_source_name) == ["a-b", "source", "source", "x" * 64, "-.1"]
    assert one_by_one(spark, ["https://h.org:8/x", "https://h.org"], "string", lambda x: scalars.replace_port(x, F.lit(443))) == ["https://h.org/x", "https://h.org/"]
    assert one_by_one(spark, ["a b/c+d", "é!'()*~"], "string", lambda x: scalars.file_url(F.lit("https://h"), x)) == ["https://h/a%20b/c%2Bd", "https://h/%C3%A9!'()*~"]
    assert one_by_one(spark, ["account", "a.b", "", "a" * 65, "a\n"], "string", filters.valid_name) == [True, False, False, False, False]
    assert one_by_one(spark, ["a.b", "...", "a" * 65], "string", filters.valid_source_name) == [True, False, False]
    paths = ["a/b", "/a", "a/", "a//b", "a/./b", "a\\b", "a\0b", "", "é" * 501, "a.b/..c"]
    assert one_by_one(spark, paths, "string", filters.valid_path) == [True] + [False] * 8 + [True]


def test_versions(spark):
    assert one_by_one(spark, [2.0, -3.0, 0.0], "double", scalars.next_intermediate_version) == pytest.approx([2.000002, -2.999997, 0.000001], abs=1e-12)


def test_picker(spark):
    ranks = lambda typed: one_by_one(spark, ["Red", "red", "RED", "a red one"], "string", lambda x: scalars.picker_rank(x, typed))
    assert ranks("Re") == [-10, -9, -7, 9] and ranks("re") == [-8, -10, -8, 9] and ranks(" re") == [-7, -9, -7, 9]
    options = spark.createDataFrame([("red",), ("bored",), ("blue",)], "o string")
    assert [(r.option, r.more) for r in logs.pick_options(options, "o", "re", most=1).collect()] == [("red", 1)]
    assert logs.pick_options(options, "o", "  ").count() == 0


def test_auth_lines(spark):
    refusal = "sshd[7]: Authentication tried for bob with correct key but not from a permitted host (host=h.org, ip=1.2.3.4, required=10.0.0.0/8,11.0.0.0/8)."
    rows = [
        (1, "  Jan 1 " + refusal), (2, "Jan 1 sshd-session[7]: Failed publickey for bob from 1.2.3.4 port 5022 ssh2: ED25519 SHA256:aB3+/="),
        (3, refusal.replace("[7]", "[8]")), (4, "Failed publickey for x from y port 1 ssh2: RSA SHA256:zz"), (5, "sshd[8]: Accepted publickey for bob from 1.2.3.4 port 1 ssh2: RSA SHA256:zz"),
    ]
    found = logs.auth_pairs(spark.createDataFrame(rows, "seq long, line string"), "line", "seq").collect()
    assert [tuple(r) for r in found] == [(1, 7, "SHA256:aB3+/=", "1.2.3.4", "bob", "5022", "10.0.0.0/8,11.0.0.0/8", "Jan 1 " + refusal)]
    assert one_by_one(spark, ["SHA256:a"], "string", lambda x: scalars.pair_key(x, F.lit("1.2.3.4"))) == ["SHA256:a 1.2.3.4"]


def test_routes(spark):
    mark = routing.VARIABLE_SHARD
    keys = [f"a{mark}_0.25", f"{mark}_3x", f"{mark}{mark}_0.5", f"a{mark}_.5", f"a{mark}", "abc"]
    got = one_by_one(spark, keys, "string", routing.route)
    assert got[:2] == [0.25, 3.0] and all(0 <= x < 1 for x in got[2:])
    assert got[5] == 0xBA7816BF8F01 % 10**9 / 1e9  # the beginning of SHA-256 of abc


def test_listing_of_marked(spark):
    index = spark.createDataFrame([("p/a", "live", 9, 5, 9), ("p/b", "marked", 8, 7, 3), ("p/c", "deleted", 6, 0, None)], "path string, state string, write_time long, size long, value_time long")
    assert [tuple(r) for r in archive.find(index, "p/", include_marked=True).collect()] == [("p/a", 9, 5), ("p/b", 3, 7)]
    assert [r.path for r in archive.find(index, "p/").collect()] == ["p/a"]


def test_scans(spark):
    found = spark.range(40)
    assert [archive.scan_verdict(found, *x).first().verdict for x in ((81, 0), (81, 2), (81, 3), (80, 0), (0, 0))] == ["retry", "retry", "accept", "accept", "accept"]
    index = spark.createDataFrame([("a", 1, 1, True, 10), ("b", 1, 1, True, 10), ("c", 1, 1, True, 99), ("d", 1, 1, False, 10)], "path string, write_time long, size long, from_them boolean, changed_at long")
    theirs = spark.createDataFrame([], "path string, create_time long, size long")
    got = archive.reconcile_pull(theirs, index, scan_start=50, local=spark.createDataFrame([("a",)], "path string"))
    assert {tuple(r) for r in got.collect()} == {("a", "repoint"), ("b", "purge"), ("c", "missing"), ("d", "missing")}


def test_short_listing_is_accepted_in_the_end(spark):
    source, at = fresh(spark, "listing"), fresh(spark, "taken")
    spark.range(3).write.parquet(source)
    start = lambda: streams.checked_listing(spark.readStream.schema("id long").parquet(source), lambda: 10, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    for _ in range(archive.SCAN_RETRIES):
        with pytest.raises(Exception, match="less than half"):
            start()
    start()
    assert spark.read.parquet(f"{at}/out").count() == 3


def test_source_order(spark):
    rows = [("f", 2, 9, "w", None, 0, 10, True), ("f", 1, 1, "hidden", False, 0, 10, True), ("f", 3, 5, "slow", True, 0, 10, True), ("f", 4, 1, "quick", True, 0, 10, True), ("f", 5, 0, "over", True, 0, 5, True), ("f", 6, 0, "other", True, 0, 10, False), ("f", 7, 2, "w", True, 0, 10, True)]
    sources = spark.createDataFrame(rows, "file string, config_order long, latency long, url string, public boolean, s long, e long, covers boolean")
    assert routing.source_order(sources, 7).first().urls == ["w", "quick", "slow"]


def test_chunks_by_hand(spark):
    sizes = [3, 4, 5, 20, 1, 1, 1, 9, 2]
    items = spark.createDataFrame([("s", i, n) for i, n in enumerate(sizes)], "shard string, i long, size long")
    assert [r.chunk for r in stats.greedy_chunks(items, "shard", "i", "size", 10).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3, 3, 4, 5]
    reached = ranges.greedy_groups(items, [], "i", "size", 10, past=False)
    assert [r.group_no for r in reached.orderBy("i").collect()] == [0, 0, 0, 1, 2, 2, 2, 2, 3]
    assert stats.greedy_chunks(items.where("false"), "shard", "i", "size", 10).count() == 0


@pytest.mark.parametrize("past", [True, False])
def test_chunks_by_fold(spark, past):
    rng = random.Random(5)
    rows = [(g, i, rng.choice([0, 0, 1, 5, 30, 90])) for g in (None, "a", "b") for i in range(rng.choice([1, 40, 90]))]
    items = spark.createDataFrame(rows, "g string, i long, size long")
    want = {}
    for g in (None, "a", "b"):
        total, group, some = 0, 0, False
        for _, i, n in sorted(r for r in rows if r[0] == g):
            if past and some and total + n > 100:
                total, group = 0, group + 1
            total, some = total + n, True
            want[g, i] = group
            if not past and total >= 100:
                total, group = 0, group + 1
    assert {(r.g, r.i): r.group_no for r in ranges.greedy_groups(items, ["g"], "i", "size", 100, past=past).collect()} == want


def test_unique_times(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(60)) for i in range(200)]
    last, want = -1, {}
    for i, t in rows:
        last = want[i] = max(t, last + 1)
    got = routing.unique_times(spark.createDataFrame(rows, "i long, t long").repartition(5), "t", ["i"]).collect()
    assert {r.i: r.stamp for r in got} == want


def _plan(spark, rows, dup, groups):
    files_ = spark.createDataFrame(rows, "file long, tier string, bytes long, min_key long, max_key long")
    found = compaction.steps(files_, spark.createDataFrame([(dup,)], "dup double"), spark.createDataFrame(groups, "lo long, hi long, dup double"))
    return {(r.step, r.lo): r.ready for r in found.collect()}


def test_compaction_steps(spark):
    mb = 1 << 20
    log = lambda size: [(1, "log", size * mb, None, None)]
    assert _plan(spark, log(800), 0.0, []) == {("fold_hard", None): True, ("fold", None): False, ("combine", None): False, ("dedup_all", None): False}
    assert _plan(spark, log(64), 0.0, [])[("fold", None)] and not _plan(spark, log(63), 0.0, [])[("fold", None)]
    one, many = [(1, "bulk", 100 * mb, 1, 2)], [(i, "bulk", mb, 1, 2) for i in range(20)]
    assert not _plan(spark, one, 0.0, [])[("combine", None)] and _plan(spark, many, 0.0, [])[("combine", None)]
    big = [(1, "bulk", 300 * mb, 1, 50), (2, "bulk", 300 * mb, 40, 90), (3, "bulk", None, None, None)]
    assert _plan(spark, big, 0.5, [(1, 9, 0.6)]) == {("fold_hard", None): False, ("fold", None): False, ("combine", None): False, ("dedup_all", None): True, ("dedup_group", 1): False}
    groups = _plan(spark, big[:2], 0.45, [(1, 9, 0.6), (45, 46, 0.4), (60, 70, 0.1)])
    assert {k: v for k, v in groups.items() if k[0] == "dedup_group"} == {("dedup_group", 1): False, ("dedup_group", 45): True}
    assert _plan(spark, big, 0.1, [(1, 9, 0.2), (10, 20, 0.3)])[("dedup_group", 10)] is False  # the nearest to its share is listed


def test_collection_compacts_when_due(spark):
    c = Collection(spark, fresh(spark, "due"), "a long")
    row = spark.createDataFrame([("x", 1, 1)], "key string, seq long, a long")
    for _ in range(3):
        c.write(row, "2024-01-01 00:00:00", "seq")
    assert not c.due() and c.compact(only_if_due=True) is None and c.compact() is not None


def test_manifest_keeps_bytes(spark):
    content = [bytes([0xFF, 0, 13, 10, 13, 13, 10, 10]), b"", None]
    got = one_by_one(spark, content, "binary", scalars.manifest_digest)
    import hashlib

    want = bytes([0xFF, 0, 10, 13, 10, 10])
    assert (got[0].size, got[0].sha256) == (6, hashlib.sha256(want).hexdigest()) and got[1].size == 0 and got[2].size is None
    at = fresh(spark, "files")
    spark.createDataFrame([("one\r",)], "value string").coalesce(1).write.text(at)
    listed = {r.path: r.size for r in files.list_files(spark, at).collect()}
    made = {r.path: r.size for r in files.manifest(spark, at).collect()}
    assert set(listed) == set(made) and sum(listed.values()) == sum(made.values()) + 1


def test_log_tail(spark, tmp_path):
    at = tmp_path / "log"
    lines = lambda state: (lambda found, new: (sorted(r.line for r in found.collect()), new))(*files.log_tail(spark, str(at), state))
    at.write_text("old\n")
    got, state = lines({})
    assert got == []
    at.write_text("old\nnew one\nhalf")
    got, state = lines(state)
    assert got == ["new one"]
    at.write_text("old\nnew one\nhalf done\n")
    got, state = lines(state)
    assert got == ["half done"]
    at.write_text("rotated\nagain\n")
    assert lines(state)[0] == ["again", "rotated"]


def test_small_file_rules(spark):
    assert files.needs_compaction(1001, 10) and not files.needs_compaction(1000, 10) and not files.needs_compaction(2999, 1000)
    named = spark.createDataFrame([("a.json",), ("b.json",)], "file string")
    assert [r.file for r in files.without_deleted(named, spark.createDataFrame([(["a.json"],)], "delete_files array<string>")).collect()] == ["b.json"]
    deploys = spark.createDataFrame([("app_1.json", '{"releaseTime": 5}'), ("app_2.json", '{"releaseTime": 4}'), ("odd", "{}")], "f string, c string")
    assert [tuple(r) for r in files.newest_release(deploys, "f", "c").collect()] == [("app", "1", 5)]
    yaml = one_by_one(spark, ["text\n```yaml\na: 1\nb: 'x y'\n  nested: 2\n```\n", "k: v"], "string", files.parse_flat_yaml)
    assert yaml == [{"a": "1", "b": "x y"}, {"k": "v"}]
    at = fresh(spark, "written")
    files.write_log(spark.range(5).coalesce(1), at, most_rows=2)
    assert files.list_files(spark, at).where("path like '%.gz'").count() == 3


def test_vectors(spark):
    assert vectors.rebuild_due(5000, [1024]) == 4096 and vectors.rebuild_due(5000, [1024, 4096]) is None and vectors.rebuild_due(1024, []) is None
    q = spark.createDataFrame([(1, ([1, 2], [0.1, 0.30000001])), (2, None)], "i int, q struct<data: array<int>, scales: array<double>>")
    rows = {r.i: r.h for r in q.select("i", vectors.half_scales(F.col("q"))["scales"].alias("h")).collect()}
    assert rows[1] == [float(np.float16(0.1)), float(np.float16(0.30000001))] and rows[2] is None


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_probing(spark, sf):
    """Every fiftieth vector against all; at two sizes, so that cells grow."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index, centroids = vectors.cluster(e, 64)
    found = {(r.query_id, r.vec_id) for r in vectors.search_many(index, centroids, asked, 10).collect()}
    exact = {(r.query_id, r.vec_id) for r in vectors.knn_many(e, asked, 10).collect()}
    assert len(exact) == 10 * asked.count() and len(found & exact) >= 0.9 * len(exact)


def test_blocks_of_neighbours(spark):
    e = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    asked = e.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), "embedding")
    whole = {tuple(r)[:2] for r in vectors.knn_many(e, asked, 4).collect()}
    assert whole == {tuple(r)[:2] for r in vectors.knn_many(e, asked, 4, vector_block=11, query_block=2).collect()} and len(whole) == 36
    assert vectors.knn_many(e.where("false"), asked, 4).count() == 0


def test_flat_listing_fills_its_entries(spark):
    """Thousands of paths of like weight: there are as many entries as asked for."""
    rows = spark.range(5000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit("/x")).alias("path"), F.lit(1).alias("w"))
    out = pathsummary.top_partition(rows, "path", F.col("w"), 30).collect()
    assert len(out) == 30 and sum(r.n for r in out) == 5000 and sum(r.kind == "self" for r in out) == 29
    heavy = rows.unionByName(spark.createDataFrame([("hot/a/b", 5000), ("hot", 10)], "path string, w int"))
    by_path = {r.path: (r.kind, r.n, r.weight) for r in pathsummary.top_partition(heavy, "path", F.col("w"), 4).collect()}
    assert by_path["hot/a/b"] == ("self", 1, 5000) and by_path["hot"] == ("self", 1, 10) and len(by_path) == 4
    assert pathsummary.top_partition(rows.where("false"), "path", F.col("w"), 4).count() == 0


def test_config_problems_gap(spark):
    rows = [("n", "s1", True, 0, 10, 0.0, 0.5), ("m", "s2", True, 0, 10, 0.6, 1.0), ("k", "s3", True, 20, 30, 0.0, 1.0)]
    found = routing.config_problems(spark.createDataFrame(rows, "name string, store string, immutable boolean, s long, e long, a double, b double")).collect()
    assert [tuple(r) for r in found] == [("coverage", "1")]
