"""Media columns: texts and PCM stored as FLAC, verified when read, cut into PCM blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.llm import flac
from driftwood.llm.common import slices

#: Payloads are padded to a positive multiple of so many bytes.
UNIT = 64
_BYTES = 1 << 20


def _mapped(df: DataFrame, keep: list[str], binary_col: str, fields: list[T.StructField], work, most: int = _BYTES) -> DataFrame:
    """``keep`` and the columns that ``work(list of bytes) -> dict of lists`` adds."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = df.select(*(F.col(c).alias(x) for x, c in zip(names, keep, strict=True)), F.col(binary_col).cast("binary").alias("raw"))
    schema = T.StructType([*rows.schema.fields[:-1], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "raw", most):
            made = work([x or b"" for x in batch.column("raw").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *(pa.array(v) for v in made.values())], [*names, *made])

    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(x).alias(c) for x, c in zip(names, keep, strict=True)), *(f.name for f in fields))


def store(docs: DataFrame, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` with ``n_bytes`` of the UTF-8 text and ``media``, a FLAC stream of its bytes,
    padded with zeros, as 8-bit samples. A null text is stored like an empty one. Equal texts
    give equal streams; rows are kept as they are, and an empty table gives none."""

    def work(raw: list[bytes]) -> dict[str, list]:
        return {"n_bytes": [len(x) for x in raw], "media": flac.encode_many([x + bytes(-len(x) % UNIT if x else UNIT) for x in raw])}

    return _mapped(docs, keep, text_col, [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())], work)


def feature(pcm: bytes) -> str:
    """What a loader sorts clips by: samples, blocks, mean, energy, peak and sign changes
    around the middle level; integers, so equal samples give equal features."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    blocks = -(-len(x) // flac.BLOCK)
    changes = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"samples={len(x)};blocks={blocks};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max(initial=0))};changes={changes}"


def _cut(streams: list[bytes]) -> list[list[dict]]:
    """The PCM blocks of each stream; see ``pcm_blocks``. Streams of 8-bit mono samples are
    decoded together."""
    metas = [flac.metadata(s) if s else None for s in streams]
    plain = [i for i, m in enumerate(metas) if m and m[0]["channels"] == 1 and m[0]["bits"] == 8]
    packed = {i: (np.frombuffer(x, np.uint8) ^ 0x80).reshape(-1, 1) for i, x in zip(plain, flac.decode_many([streams[i] for i in plain]), strict=True)}
    out = []
    for i, (stream, meta) in enumerate(zip(streams, metas, strict=True)):
        if meta is None:
            out.append([])
            continue
        info, points, _ = meta
        if i not in packed:
            _, channels = flac.decode_stream(stream)
            width = (info["bits"] + 7) // 8
            packed[i] = np.frombuffer(np.stack(channels, axis=1).astype("<i8").tobytes(), np.uint8).reshape(-1, 8)[:, :width].reshape(-1, width * len(channels))
        samples = packed.pop(i)
        if not len(points):
            points = np.array([[0, 0, len(samples)]])
        ends = [*points[1:, 0].tolist(), len(samples)]
        out.append([{"block": b, "first_sample": s, "byte_offset": o, "samples": e - s, "pcm": samples[s:e].tobytes()} for b, ((s, o, _), e) in enumerate(zip(points.tolist(), ends, strict=True))])
    return out


def read_back(stored: DataFrame, *, keep: list[str], media_col: str = "media") -> DataFrame:
    """``keep`` with what the stored streams of 8-bit mono samples hold: ``pcm``, their
    verified PCM blocks put together in order of first sample, as unsigned bytes, and its
    ``feature``. A stream that is damaged fails the job with the reason; a null or empty one
    has no samples. Rows are kept as they are, repeated or not; an empty table gives none."""

    def work(raw: list[bytes]) -> dict[str, list]:
        joined = [b"".join(b["pcm"] for b in sorted(blocks, key=lambda b: b["first_sample"])) for blocks in _cut(raw)]
        pcm = [(np.frombuffer(x, np.uint8) ^ 0x80).tobytes() for x in joined]
        return {"pcm": pcm, "feature": [feature(x) for x in pcm]}

    return _mapped(stored, keep, media_col, [T.StructField("pcm", T.BinaryType()), T.StructField("feature", T.StringType())], work)


def pcm_blocks(media: DataFrame, *, keep: list[str], media_col: str = "media") -> DataFrame:
    """``keep`` with a row for each block of a FLAC stream of one or two channels:
    ``block``, ``first_sample``, ``byte_offset`` of its frame among the frames, ``samples``
    and ``pcm`` (little-endian, channels interleaved). With the offsets a reader starts at
    any sample. Null and empty media have no blocks."""
    fields = [T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("block", T.IntegerType()), T.StructField("first_sample", T.LongType()), T.StructField("byte_offset", T.LongType()), T.StructField("samples", T.IntegerType()), T.StructField("pcm", T.BinaryType())])))]

    def work(raw: list[bytes]) -> dict[str, pa.Array]:
        kind = pa.list_(pa.struct([("block", pa.int32()), ("first_sample", pa.int64()), ("byte_offset", pa.int64()), ("samples", pa.int32()), ("pcm", pa.binary())]))
        return {"blocks": pa.array(_cut(raw), kind)}

    return _mapped(media, keep, media_col, fields, work).select(*keep, F.explode("blocks").alias("b")).select(*keep, "b.*")


def tail_crc32(column: str):
    """crc32 of the last 64 bytes."""
    return F.crc32(F.substring(F.col(column), F.greatest(F.lit(1), F.octet_length(column) - UNIT + 1), F.lit(UNIT)))
