"""Line dedup through sharded minimal perfect hashes.

Line keys that enough documents hold are dealt into shards by hash. Each shard has a
minimal perfect hash, built level by level from bit arrays, that gives every key of the
shard its own place in compact arrays of fingerprints, counts and largest ids. Documents
are not joined with lines: each hashes its lines and probes the arrays, and a line that is
not indexed is told by its 64-bit fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.llm.common import SPACE, free_name, in_arrow, slices, written

_SPACE = SPACE.encode()
_INDEX = "shard int, levels array<int>, bits binary, prints binary, counts binary, ids binary, rest binary"


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each key, another for each level."""
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys to the places 0 to n - 1. A key takes its place at the first
    level where it is alone on its bit; the place is the number of bits before it."""

    def __init__(self, levels: list[int], bits: np.ndarray):
        self.levels = levels
        self.bits = bits
        self.rank = np.cumsum(bits, dtype=np.int32) - 1

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels, parts = [], []
        while len(keys):
            width = max(64, int(gamma * len(keys)))
            at = (_mixed(keys, len(levels)) % np.uint64(width)).astype(np.int64)
            alone = np.bincount(at, minlength=width) == 1
            levels.append(width)
            parts.append(alone)
            keys = keys[~alone[at]]
        return cls(levels, np.concatenate(parts) if parts else np.zeros(0, bool))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; for a key that was not built in, some place or -1."""
        out, left, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, width in enumerate(self.levels):
            at = start + (_mixed(keys[left], level) % np.uint64(width)).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, start = left[~hit], start + width
        return out


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip(_SPACE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _halves(key: bytes) -> tuple[int, int]:
    """The 128-bit hash of a key as two signed longs."""
    h = xxhash.xxh3_128_intdigest(key)
    return ((h >> 64) ^ (1 << 63)) - (1 << 63), ((h & (2**64 - 1)) ^ (1 << 63)) - (1 << 63)


def _digests(lines: list[bytes], least: int) -> tuple[list[int], list[int], list[int]]:
    """For the lines that are long enough: their numbers, and the two halves of the
    128-bit hashes of their keys as signed longs."""
    at, high, low = [], [], []
    for i, line in enumerate(lines):
        if len(line) >= least and _long_enough(key := line_key(line), least):
            h, p = _halves(key)
            at.append(i)
            high.append(h)
            low.append(p)
    return at, high, low


def line_holders(docs: DataFrame, *, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """``(h, p, id)``: the key hash of every long line, once a row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                _, high, low = _digests((text or b"").split(b"\n"), least_chars)
                rows.extend((h, p, i) for h, p in set(zip(high, low, strict=True)))
            h, p, i = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(p, pa.int64()), pa.array(i, batch.schema.field("id").type)], ["h", "p", "id"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return in_arrow(texts, run, T.StructType([T.StructField("h", T.LongType()), T.StructField("p", T.LongType()), T.StructField("id", texts.schema["id"].dataType)]))


def shard_row(shard: int, h: np.ndarray, p: np.ndarray, n: np.ndarray, last: np.ndarray) -> dict:
    """A shard of the index. ``h`` places a key and ``p`` tells it from others; of keys with
    one ``h`` the first has the place, and the others are kept whole in ``rest``."""
    order = np.lexsort((p, h))
    h, p, n, last = (x[order].astype(np.int64) for x in (h, p, n, last))
    first = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    keys = h[first].view(np.uint64)
    made = PerfectHash.build(keys)
    by_place = np.argsort(made.places(keys))
    packed = lambda x, kind: x[first][by_place].astype(kind).tobytes()
    rest = np.stack([x[~first] for x in (h, p, last)], axis=1).tobytes()
    return {"shard": shard, "levels": made.levels, "bits": np.packbits(made.bits).tobytes(), "prints": packed(p, np.int64), "counts": packed(n, np.int32), "ids": packed(last, np.int64), "rest": rest}


def build_index(repeated: DataFrame, shard_bits: int) -> DataFrame:
    """A row for each of 2**shard_bits shards of ``repeated (h, p, n, last)``: the levels
    and bits of its perfect hash and, by place, fingerprints, counts and largest ids."""

    def shard(key, group):
        import pandas as pd

        return pd.DataFrame([shard_row(key[0], *(group[c].to_numpy(dtype=np.int64) for c in ("h", "p", "n", "last")))])

    return repeated.withColumn("shard", F.shiftrightunsigned("h", 64 - shard_bits).cast("int") if shard_bits else F.lit(0)).groupBy("shard").applyInPandas(shard, _INDEX)


class Index:
    """The shards' arrays, as a worker holds them."""

    def __init__(self, rows: list, shard_bits: int):
        self.shift, self.shards = np.uint64(64 - shard_bits), {}
        self.bits = shard_bits
        for row in rows:
            made = PerfectHash(list(row["levels"]), np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(row["levels"])].astype(bool))
            rest = np.frombuffer(row["rest"], np.int64).reshape(-1, 3).tolist()
            self.shards[row["shard"]] = made, np.frombuffer(row["prints"], np.int64), np.frombuffer(row["ids"], np.int64), {(h, p): last for h, p, last in rest}

    def probe(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is indexed, and the largest id that holds it."""
        keys = high.view(np.uint64)
        found, last = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        shard = (keys >> self.shift).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        for s in np.unique(shard):
            if s in self.shards:
                made, prints, ids, rest = self.shards[s]
                own = np.flatnonzero(shard == s)
                place = made.places(keys[own])
                hit = (place >= 0) & (prints[place] == low[own])
                found[own[hit]], last[own[hit]] = True, ids[place[hit]]
                if rest:
                    for i in own[~hit].tolist():
                        known = rest.get((int(high[i]), int(low[i])))
                        if known is not None:
                            found[i], last[i] = True, known
        return found, last


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5, shard_keys: int = 1 << 16, broadcast_keys: int = 1 << 21) -> DataFrame:
    """The rows of ``docs``, all their columns, with the text that stays and the columns
    ``n_lines`` (before) and ``n_dropped``.

    Texts are split at newlines; a null or empty one is one empty line, and a null text
    becomes empty. Keys of ``least_chars`` code points or more that ``least_docs`` rows or
    more hold lose all their lines but those in the row with the largest id that holds
    them; ids are integers, and rows without an id count but keep no line unless all have
    none. Rows that repeat an id count as documents of their own and share its rights.

    The index has about 25 bytes a repeated key. Up to ``broadcast_keys`` keys (about 50 MB)
    it goes to the workers whole. Beyond, line hashes (16 bytes each, without text) are
    dealt to the shards to be probed there and the answers go back by row; the result is
    the same.
    """
    spark = docs.sparkSession
    least_id = -(1 << 63)
    held = line_holders(docs, id_col=id_col, text_col=text_col, least_chars=least_chars)
    counted = held.groupBy("h", "p").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("id").cast("long"), F.lit(least_id)).alias("last"))
    repeated = written(counted.where(F.col("n") >= least_docs).withColumn("n", F.least("n", F.lit(2**31 - 1)).cast("int")))
    keys = repeated.count()
    shard_bits = min(30, max(0, (max(keys, 1) // shard_keys).bit_length()))
    index = written(build_index(repeated, shard_bits))
    clash = [c for c in ("n_lines", "n_dropped") if c in docs.columns]
    kept = [c for c in docs.columns if c not in clash]
    if keys <= broadcast_keys:
        shipped = spark.sparkContext.broadcast([row.asDict() for row in index.collect()])
        return _clean(docs.select(*kept), id_col, text_col, least_chars, lambda: Index(shipped.value, shard_bits))
    return _clean_by_shuffle(docs.select(*kept), id_col, text_col, least_chars, index, shard_bits)


def _clean(docs: DataFrame, id_col: str, text_col: str, least: int, load, dropped_col: str | None = None) -> DataFrame:
    schema = T.StructType([f for f in docs.schema.fields if f.name != dropped_col])
    schema = T.StructType([*schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = load() if load else None
        for batch in slices(batches, text_col):
            texts = [(t or "").encode().split(b"\n") for t in batch.column(text_col).to_pylist()]
            if index:
                owners, at, high, low = [], [], [], []
                for d, lines in enumerate(texts):
                    a, h, p = _digests(lines, least)
                    owners.extend([d] * len(a))
                    at.extend(a)
                    high.extend(h)
                    low.extend(p)
                found, last = index.probe(np.array(high, np.int64), np.array(low, np.int64))
                ids = np.array([-(1 << 63) if i is None else i for i in batch.column(id_col).to_pylist()], np.int64)
                go = found & (last != ids[np.array(owners, np.int64)])
                drop = [set() for _ in texts]
                for k in np.flatnonzero(go).tolist():
                    drop[owners[k]].add(at[k])
            else:
                drop = [set(x or ()) for x in batch.column(dropped_col).to_pylist()]
            left = [b"\n".join(x for i, x in enumerate(lines) if i not in d) if d else b"\n".join(lines) for lines, d in zip(texts, drop, strict=True)]
            columns = {c: batch.column(c) for c in batch.schema.names if c != dropped_col}
            columns[text_col] = pa.array(left, pa.binary()).cast(pa.string())
            columns |= {"n_lines": pa.array([len(x) for x in texts], pa.int64()), "n_dropped": pa.array([len(d) for d in drop], pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return in_arrow(docs, run, schema)


def _clean_by_shuffle(docs: DataFrame, id_col: str, text_col: str, least: int, index: DataFrame, shard_bits: int, chunk_rows: int = 500_000) -> DataFrame:
    """Line hashes go to the shards: a shard with many probes is copied for each chunk of
    ``chunk_rows`` of them, so a line that many documents hold fills no task."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = {"id": [], "r1": [], "r2": [], "at": [], "h": [], "p": []}
            for i, r1, r2, text in zip(*(batch.column(c).to_pylist() for c in ("id", "r1", "r2", "text")), strict=True):
                at, high, low = _digests((text or b"").split(b"\n"), least)
                for c, values in zip(out, ([i] * len(at), [r1] * len(at), [r2] * len(at), at, high, low), strict=True):
                    out[c].extend(values)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c == "at" else pa.int64()) for c, v in out.items()})

    def probe(key, probes, shard):
        if not len(shard):
            return probes[["r1", "r2", "at"]].iloc[:0]
        found, last = Index(shard.to_dict("records"), shard_bits).probe(probes["h"].to_numpy(np.int64), probes["p"].to_numpy(np.int64))
        own = probes["id"].fillna(-(1 << 63)).to_numpy(np.int64) if probes["id"].isna().any() else probes["id"].to_numpy(np.int64)
        return probes.loc[found & (last != own), ["r1", "r2", "at"]]

    # a row is known by 128 bits of its id and text; rows that share both lose the same lines
    row = {"r1": F.xxhash64(F.col(id_col), F.col(text_col)), "r2": F.xxhash64(F.col(text_col), F.lit(1), F.col(id_col))}
    texts = docs.select(F.col(id_col).cast("long").alias("id"), *(c.alias(r) for r, c in row.items()), F.col(text_col).cast("binary").alias("text"))
    shard = F.shiftrightunsigned("h", 64 - shard_bits).cast("int") if shard_bits else F.lit(0)
    probes = written(in_arrow(texts, hashes, "id long, r1 long, r2 long, at int, h long, p long").withColumn("shard", shard))
    chunks = probes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks"))
    dealt = probes.join(chunks, "shard").withColumn("chunk", F.pmod(F.xxhash64("r1", "at"), F.col("chunks")).cast("int"))
    copied = index.join(chunks, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    dropped = dealt.groupBy("shard", "chunk").cogroup(copied.groupBy("shard", "chunk")).applyInPandas(probe, "r1 long, r2 long, at int")
    r1, r2, lines = (free_name(c, docs.columns) for c in ("_r1", "_r2", "_dropped_lines"))
    by_row = dropped.groupBy(F.col("r1").alias(r1), F.col("r2").alias(r2)).agg(F.collect_set("at").alias(lines))
    joined = docs.join(by_row, (row["r1"] == F.col(r1)) & (row["r2"] == F.col(r2)), "left").drop(r1, r2)
    return _clean(joined, id_col, text_col, least, None, lines)
