"""Near and exact dedup, line dedup, mixing, media and chat formatting against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftwood.llm import chat_format, components, exact_dedup, flac, line_dedup, media, mixing, queries, simhash
from driftwood.llm.common import table
from tests.llm.conftest import ODD


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=str)


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- SimHash -----------------------------------------------------------------------------


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, k=3):
    fps = [brute_fingerprint(t) for _, t in rows]
    values = np.array(fps, np.uint64)
    pairs = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(values[i:] ^ values[i]) <= k) + i]
    at = roots(len(fps), pairs)
    low = defaultdict(list)
    for r, (i, _) in zip(at, rows, strict=True):
        if i is not None:
            low[r].append(i)
    return [(i, f"{fp:016x}", min(low[r], default=None)) for (i, _), fp, r in zip(rows, fps, at, strict=True)]


def test_simhash_odd(odd):
    assert by_id(simhash.near_duplicates(odd).collect()) == by_id(brute_components(ODD))
    assert simhash.near_duplicates(odd.where("false")).count() == 0


def test_simhash_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = queries.queries()["op3_simhash"](spark, sf).collect()
    assert by_id((r.doc_id, r.fingerprint, r.component_id) for r in got) == by_id(brute_components(rows))


def dense(n, seed):
    """Fingerprints in a ball, in chains, and far apart."""
    rng = random.Random(seed)
    flip = lambda x, most: x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, most)))
    ball, out = rng.getrandbits(64), set()
    chain = rng.getrandbits(64)
    for _ in range(n):
        chain = flip(chain, 4)
        out |= {flip(ball, 5), chain, rng.getrandbits(64)}
    return sorted(out)


@pytest.mark.parametrize("parts", [None, "wide", "uneven"])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, parts):
    values = dense(250, 4)
    if parts == "wide":
        monkeypatch.setattr(simhash, "plan", lambda *a: [(list(range(32)), 1), (list(range(32, 64)), 1)])
    if parts == "uneven":
        monkeypatch.setattr(simhash, "plan", lambda *a: [(list(range(0, 64, 2)), 2), (list(range(1, 64, 2)), 0)])
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v, 1) for v in signed], "fp long, n long")
    got = {r.node: r.root for r in components.components(simhash.links(fps)).collect()}
    array = np.array(values, np.uint64)
    at = roots(len(values), [(i, j) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 3)])
    want = defaultdict(set)
    for i, r in enumerate(at):
        want[r].add(signed[i])
    made = defaultdict(set)
    for v in signed:
        made[got.get(v, v)].add(v)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, made.values()))


def test_plan_covers_every_pair():
    rng = np.random.default_rng(2)
    sample = rng.integers(-(1 << 63), 1 << 63, 500)
    for rows in (10, 10**6, 10**9):
        chosen = simhash.plan(sample, rows)
        assert sum(t + 1 for _, t in chosen) == 4 and len({b for g, _ in chosen for b in g}) == sum(len(g) for g, _ in chosen)
    assert simhash.allocate([[0, 5, 50, 500, 5000], [0, 1, 2, 3, 4]], 3) == [-1, 3]
    assert len(simhash.plan(sample[:0], 0)) > 0


def test_components_long_path_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, j) for j in range(1001, 1200)] + [(5, 5), (7, None), (3, 2)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1200)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- exact dedup -------------------------------------------------------------------------


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(i, keep[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]


@pytest.mark.parametrize("digest", [F.xxhash64, lambda *c: F.pmod(F.xxhash64(*c), F.lit(3))])
def test_exact_odd(make, digest):
    rows = [*ODD, (20, "ab" * 100), (21, "ab" * 100), (22, "ab" * 101), (23, "a" * 16), (24, "a" * 17), (25, "a" * 8), (26, "b" * 33), (27, "b" * 33)]
    got = exact_dedup.exact_duplicates(make(rows), block_bytes=8, digest=digest).collect()
    assert by_id((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == by_id(brute_exact(rows))
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_empty(odd):
    assert exact_dedup.exact_duplicates(odd.where("false")).count() == 0


# --- line dedup --------------------------------------------------------------------------

SPACE = " \t\n\x0b\f\r"


def brute_lines(rows, least=40, docs=5):
    holders = defaultdict(list)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(SPACE).translate(fold)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        goes = lambda x: len(k := key(x)) >= least and len(holders[k]) >= docs and max((j for j in holders[k] if j is not None), default=None) != i
        left = [x for x in lines if not goes(x)]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return out


LINES = [
    *ODD, *((100 + i, f"  {'É' + 'shared line ' * 4} \nown line {i} which is long enough to be a key of its own\nshort") for i in range(6)),
    *((200 + i, f"{'É' + 'SHARED line ' * 4}\r\n{'z' * 39}\n{'z' * 40}\n\n{'z' * 40}") for i in range(5)), (300, "z" * 40), (300, "z" * 40), (None, "z" * 40),
]


@pytest.mark.parametrize("broadcast", [1 << 21, 0])
def test_lines_with_equal_first_halves(make, monkeypatch, broadcast):
    """Keys that clash in the half of the hash that finds their place are told apart."""
    plain = line_dedup._halves
    monkeypatch.setattr(line_dedup, "_halves", lambda key: (7, plain(key)[1]))
    got = line_dedup.dedup_lines(make(LINES).coalesce(1), broadcast_keys=broadcast)
    index = line_dedup.Index([], 0)
    assert index.probe(np.array([7]), np.array([1]))[0].tolist() == [False]
    made = [(7, 10, 5, 100), (7, 11, 6, 200), (9, 12, 5, 300), (7, 9, 5, 400)]
    found, last = line_dedup.Index([line_dedup.shard_row(0, *map(np.array, zip(*made, strict=True)))], 0).probe(np.array([7, 7, 7, 9, 7]), np.array([10, 11, 9, 12, 13]))
    assert found.tolist() == [True] * 4 + [False] and last[:4].tolist() == [100, 200, 400, 300]
    assert by_id(got.select("doc_id", "text", "n_lines", "n_dropped").collect()) == by_id(brute_lines(LINES))


@pytest.mark.parametrize("broadcast", [1 << 21, 0])
@pytest.mark.parametrize("shard_keys", [1 << 16, 1])
def test_lines_odd(make, broadcast, shard_keys):
    got = line_dedup.dedup_lines(make(LINES), broadcast_keys=broadcast, shard_keys=shard_keys)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "fp" in got.columns
    assert by_id(got.select("doc_id", "text", "n_lines", "n_dropped").collect()) == by_id(brute_lines(LINES))
    assert sum(r.n_dropped for r in got.collect()) > 15


def test_lines_empty(odd):
    assert line_dedup.dedup_lines(odd.where("false")).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    made = line_dedup.PerfectHash.build(keys)
    assert sorted(made.places(keys)) == list(range(len(keys)))
    assert len(line_dedup.PerfectHash.build(keys[:0]).places(keys[:3])) == 3


# --- mixing ------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free = {}, set(order)
    while True:
        rest = sum(sizes.values()) - sum(out.values())
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total >= most * sizes[s]}
        if not over:
            return out | {s: rest * weight[s] / total for s in free}
        out |= {s: most * sizes[s] for s in over}
        free -= over
        if not free:
            return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1000, "b": 1, "c": 5, None: 7}, {"a": 1, "b": 1000, "é": 1000, "z": 3}, {"a": 5}, {"a": 0, "b": 4}, {"a": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "id long, source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in got)


def test_mix_odd(make):
    rows = [(i, t, None, [None, "a", "b"][k % 3]) for k, (i, t) in enumerate(ODD)]
    plan = mixing.plan_mix(make(rows)).collect()
    assert len(plan) == len(rows)
    assert all(r.taken in {n * r.size for n in range(4)} and 0 <= r.target <= 3 * r.source_size for r in plan)
    assert {(r.doc_id, r.size) for r in plan} == {(i, len((t or "").encode().split())) for i, t in ODD}
    mixed = mixing.mix(make(rows))
    assert mixed.columns == make(rows).columns
    assert mixed.select(F.sum(F.size(F.split(F.trim(F.regexp_replace(F.col("text"), r"[\x09-\x0D ]+", " ")), " ")))).first()[0] in (None, *range(10**6))
    assert mixing.plan_mix(make(rows).where("false")).count() == 0 and mixing.mix(make(rows).where("false")).count() == 0


def test_mix_plan_is_what_is_emitted_and_near_its_targets(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    plan = mixing.plan_mix(docs)
    taken = {r[0]: r[1] for r in plan.where("taken > 0").select("doc_id", (F.col("taken") / F.col("size")).cast("int")).collect()}
    mixed = {r[0]: r[1] for r in mixing.mix(docs).where("length(trim(text)) > 0").groupBy("doc_id").count().collect()}
    assert taken == {k: v for k, v in mixed.items() if k in taken} and not [k for k in mixed if k not in taken]
    part = F.col("target") / F.col("source_size") - F.floor(F.col("target") / F.col("source_size"))
    spread = F.sqrt(F.sum(F.col("size") * F.col("size") * part * (1 - part)))  # of independent draws
    sums = plan.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), spread.alias("spread")).collect()
    assert all(abs(r.taken - r.target) <= 4 * r.spread + 1 for r in sums)
    assert abs(sum(r.taken for r in sums) - sum(r.target for r in sums)) < 0.03 * sum(r.target for r in sums)


# --- media -------------------------------------------------------------------------------


def test_media_odd(odd):
    stored = media.store(odd, keep=["doc_id"])
    back = media.read_back(stored, keep=["doc_id", "n_bytes", "media"]).select("doc_id", "n_bytes", "pcm", media.tail_crc32("pcm").alias("tail"), "media", "feature").collect()
    want = []
    for i, t in ODD:
        raw = (t or "").encode()
        raw += bytes(-len(raw) % 64 if raw else 64)
        want.append((i, len((t or "").encode()), raw, zlib.crc32(raw[-64:])))
    assert by_id((r.doc_id, r.n_bytes, bytes(r.pcm), r.tail) for r in back) == by_id(want)
    assert len({(bytes(r.pcm), bytes(r.media), r.feature) for r in back}) == len({bytes(r.pcm) for r in back})
    assert media.store(odd.where("false"), keep=["doc_id"]).count() == 0


def test_media_query(spark, sf):
    want = []
    for d in table(spark, sf, "documents").collect():
        raw = (d.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stream = flac.encode_many([payload])[0]
        digests = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest()
        want.append((d.doc_id, len(raw), len(payload), *digests, media.feature(payload)))
    assert by_id(queries.queries()["op9_media"](spark, sf).collect()) == by_id(want)


def test_flac_of_other_makes_with_a_seek_table():
    """A stream with a full seek table but another kind of subframe is decoded all the same."""
    raw = bytes(range(100, 164))
    head = packed([(0x7FFC, 15), (0, 1), (6, 4), (0, 4), (0, 4), (1, 3), (0, 1), (0, 8), (63, 8)])
    frame = head + bytes([flac.crc8(head)]) + packed([(1 << 1, 8), *((x - 128, 8) for x in raw)])
    crc = int(flac.crc16_many(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    digest = hashlib.md5((np.frombuffer(raw, np.uint8) ^ 0x80).tobytes()).digest()
    info = (64).to_bytes(2, "big") * 2 + bytes(6) + ((8000 << 44) | (7 << 36) | 64).to_bytes(8, "big") + digest
    seek = bytes(16) + (64).to_bytes(2, "big")
    stream = b"fLaC" + len(info).to_bytes(4, "big") + info + (0x83000000 | len(seek)).to_bytes(4, "big") + seek + frame + crc.to_bytes(2, "big")
    ours = flac.encode_many([b"text " * 90])[0]
    assert flac.decode_many([stream, ours]) == [raw, b"text " * 90]


def test_pcm_blocks_seek(odd):
    blocks = media.pcm_blocks(media.store(odd, keep=["doc_id"]), keep=["doc_id"]).where("doc_id = 10").orderBy("block").collect()
    raw = ("wörd " * 3000).encode()
    raw += bytes(-len(raw) % 64)
    assert b"".join((np.frombuffer(b.pcm, np.int8).astype(int) + 128).astype(np.uint8).tobytes() for b in blocks) == raw
    stream = flac.encode_many([raw])[0]
    _, _, first = flac.metadata(stream)
    for b in blocks[3:5]:
        assert stream[first + b.byte_offset : first + b.byte_offset + 2] == b"\xff\xf8"
        info, samples = flac.decode_stream(stream, b.first_sample + 5)
        assert info["first_sample"] == b.first_sample and (samples[0][: b.samples] == np.frombuffer(b.pcm, np.int8)).all()


def test_flac_both_decoders():
    rng = random.Random(5)
    raw = [rng.randbytes(64 * rng.randint(1, 50)) for _ in range(20)] + [bytes(64), b"\xff" * 4096, bytes([0, 255] * 1000), b"the same words again " * 200]
    streams = flac.encode_many(raw)
    assert flac.decode_many(streams) == raw
    for stream, want in zip(streams, raw, strict=True):
        assert (flac.decode_stream(stream)[1][0] + 128).astype(np.uint8).tobytes() == want


def test_flac_damage_is_found():
    stream = bytearray(flac.encode_many([b"some text " * 300])[0])
    for at in (len(stream) - 1, len(stream) // 2, len(stream) - 40):
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode_many([bytes(bad)])
        with pytest.raises(ValueError):
            flac.decode_stream(bytes(bad))


def packed(fields):
    text = "".join(f"{v & ((1 << n) - 1):0{n}b}" if n else "" for v, n in fields)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def test_flac_stereo_16_bit_by_hand():
    """A frame of mid/side stereo: constant and verbatim subframes, as an encoder may write it."""
    left, right = [1000] * 16, [990] * 16
    head = packed([(0x7FFC, 15), (0, 1), (6, 4), (9, 4), (10, 4), (4, 3), (0, 1), (0, 8), (15, 8)])
    head += bytes([flac.crc8(head)])
    body = packed([(0, 8), (995, 16), (1 << 1, 8), *((10, 17) for _ in range(16))])
    frame = head + body
    crc = int(flac.crc16_many(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    samples = np.stack([left, right], axis=1).astype("<i2").tobytes()
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + ((44100 << 44) | (1 << 41) | (15 << 36) | 16).to_bytes(8, "big") + hashlib.md5(samples).digest()
    stream = b"fLaC" + (0x80000000 | len(info)).to_bytes(4, "big") + info + frame + crc.to_bytes(2, "big")
    got = flac.decode_stream(stream)[1]
    assert got[0].tolist() == left and got[1].tolist() == right


# --- chat formatting ---------------------------------------------------------------------


def test_chat_order_and_validation(spark):
    calls = spark.createDataFrame(
        [
            ("c", 0, "late", "sum", '{"y": 2.50, "x": 1}', ["early", "gone"]), ("c", 1, "early", "sum", '{"x": "1"}', []), ("c", 2, "x1", "sum", "[1]", ["x2"]), ("c", 3, "x2", "none", '{"x":1}', ["x1"]),
            ("c", 4, "behind", "sum", None, ["x2"]), ("c", 5, "after", "sum", '{"x":-1,"z":1,"mode":"q"}', ["late"]), ("d", 0, "late", "sum", '{"x":3,"x":4}', None), ("d", 1, None, "sum", '{"x":5}', [None]), ("d", 1, None, "sum", '{"x":5}', [None]),
        ],
        "conv_id string, seq long, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([("c", 9, "late", "second"), ("c", 8, "late", 'fi"rst\n'), ("c", 8, "nobody", "x"), ("d", 1, "late", None)], "conv_id string, seq long, call_id string, content string")
    params = spark.createDataFrame([("sum", "x", "integer", True, None, 0.0, None, None), ("sum", "y", "number", False, None, None, 9.0, None), ("sum", "mode", "string", False, None, None, None, ["p"])], chat_format.PARAMS)
    got = chat_format.format_calls(calls, results, params).collect()
    assert len(got) == 9
    one = {(r.conv_id, r.call_id): r for r in got}
    late = one["c", "late"]
    assert (late.ready, late.level, late.n_results, late.violations) == (1, 1, 2, [])
    assert late.message == '{"arguments":{"x":1,"y":2.5},"call_id":"late","name":"sum","result":"fi\\"rst\\n","valid":true}'
    assert one["c", "early"].violations == ["type:x"] and (one["c", "early"].ready, one["c", "early"].level) == (1, 0)
    assert one["c", "x1"].violations == ["object:"] and one["c", "x2"].violations == ["tool:"]
    assert [one["c", k].cyclic for k in ("x1", "x2", "behind", "after")] == [True, True, False, False]
    assert one["c", "after"].violations == ["enum:mode", "minimum:x", "unknown:z"]
    assert one["d", "late"].violations == ["object:"] and one["d", "late"].n_results == 1
    place = {r.call_id: i for i, r in enumerate(sorted((r for r in got if r.conv_id == "c"), key=lambda r: (r.ready, r.level if r.level is not None else 1 << 30, r.seq)))}
    assert place["early"] < place["late"] < place["after"]


def test_chat_odd_turns(spark):
    turns = [(1, 0, "user", None), (1, 1, "assistant", None), (1, 2, "user", ""), (1, 3, "assistant", "x"), (1, 3, "assistant", "x"), (None, 0, "user", "q"), (2, 0, None, "q"), (2, 1, "system", "é \x7f\x01\\"), (2, None, "user", "q")]
    rows = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, message string")
    got = chat_format.format_calls(*chat_format.derive_calls(rows), chat_format.conversation_tools(spark)).collect()
    assert sorted((str(r.call_id), r.n_results, ",".join(r.violations)) for r in got) == [
        ("1:0", 1, "missing:query,type:turn"), ("1:2", 2, "minLength:query,type:turn"), ("2:1", 0, ""), ("None", 0, "minLength:query,missing:turn"), ("None", 0, "object:")
    ]
    empty = rows.where("false")
    assert chat_format.format_calls(*chat_format.derive_calls(empty), chat_format.conversation_tools(spark)).count() == 0


def test_chat_query_orders_and_finds_faults(spark):
    """The registered query has late, tied and circular calls and every kind of fault."""
    rows = queries.queries()["op4_chat_format"](spark, "/root/testdata/sf0.01").collect()
    assert any(r.ready > r.turn for r in rows) and {r.level for r in rows} >= {None, 0, 1, 2} and {r.cyclic for r in rows} == {True, False}
    kinds = {v.split(":")[0] for r in rows for v in r.violations.split(",") if v}
    assert kinds >= {"enum", "minLength", "minimum", "missing", "type", "unknown", "object", "tool", "maximum"} and any(not r.violations for r in rows)


# --- queries against their SQL -----------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    shown = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    assert sorted(map(shown, got.select(*want.columns).collect()), key=str) == sorted(map(shown, want.fetchall()), key=str)
