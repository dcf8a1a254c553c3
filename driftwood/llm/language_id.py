"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector is the product of its
letters' vectors, each rotated by its place; a text's vector is the sum over its n-grams, a
language's prototype the sum over its training texts. A text gets the language whose
prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.llm.common import in_arrow, slices

#: Stands for every run of characters that are not letters.
_GAP = 32
_CHARS = 1 << 20


@cache
def _folded() -> np.ndarray:
    """For each code point its lower-case letter, or the gap."""
    out = np.full(0x110000, _GAP, np.int64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


#: So many letters' vectors are kept, 8 MB at 1024 dimensions; others are drawn again.
_KEPT = 8192


class Model(NamedTuple):
    """Languages in order and a prototype each, with what their vectors were made by."""

    langs: list[str]
    prototypes: np.ndarray
    n: int
    seed: int


class Space:
    """The random vectors: ``dim`` entries for each letter, drawn from its code point."""

    def __init__(self, dim: int, n: int, seed: int):
        self.dim, self.n, self.seed, self._letters = dim, n, seed, {}

    def _letter(self, code: int) -> np.ndarray:
        found = self._letters.get(code)
        if found is None:
            if len(self._letters) >= _KEPT:
                self._letters.clear()
            found = self._letters[code] = 2 * np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, dtype=np.int8) - 1
        return found

    def letters(self, codes: np.ndarray, rotation: int) -> np.ndarray:
        rows = [self._letter(c) for c in codes.tolist()]
        return np.roll(np.stack(rows), rotation, axis=1).astype(np.float32) if rows else np.zeros((0, self.dim), np.float32)

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """A row for each n-gram code: rotated letter vectors multiplied together."""
        out = np.ones((len(codes), self.dim), np.float32)
        for place in range(self.n):
            own, at = np.unique((codes >> (21 * (self.n - 1 - place))) & 0x1FFFFF, return_inverse=True)
            out *= self.letters(own, self.n - 1 - place)[at]
        return out


def gram_codes(text: str, n: int) -> Iterator[np.ndarray]:
    """Codes of the n-grams (n is 2 or more) of the text's letters and the gaps between
    them, in pieces of bounded length. A text without letters has none."""
    carry = np.array([_GAP])
    for start in range(0, len(text), _CHARS):
        points = _folded()[np.frombuffer(text[start : start + _CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)]
        points = np.concatenate((carry, points, [_GAP] if start + _CHARS >= len(text) else []))
        points = points.astype(np.int64)[np.concatenate(([True], (points[1:] != _GAP) | (points[:-1] != _GAP)))]
        carry = points[1 - n :]
        if len(points) < n:
            continue
        codes = np.zeros(len(points) - n + 1, np.int64)
        for place in range(n):
            codes = (codes << 21) | points[place : place + len(codes)]
        yield codes


def vectors(texts: list[str], space: Space, step: int = 4096) -> np.ndarray:
    """A row for each text: the sum of its n-grams' vectors. Exact integers as float64."""
    out = np.zeros((len(texts), space.dim))

    def flush(parts: list[tuple[int, np.ndarray]]) -> None:
        rows = np.concatenate([np.full(len(c), i, np.int64) for i, c in parts])
        grams, at = np.unique(np.concatenate([c for _, c in parts]), return_inverse=True)
        first, last = rows[0], rows[-1] + 1
        for lo in range(0, len(grams), step):
            own = (at >= lo) & (at < lo + step) if len(grams) > step else slice(None)
            width = min(step, len(grams) - lo)
            counts = np.bincount((rows[own] - first) * width + at[own] - lo, minlength=(last - first) * width)
            out[first:last] += counts.reshape(last - first, width).astype(np.float32) @ space.grams(grams[lo : lo + step])

    parts, size = [], 0
    for i, text in enumerate(texts):
        for codes in gram_codes(text, space.n):
            parts.append((i, codes))
            size += len(codes)
            if size >= _CHARS or i - parts[0][0] >= 255:
                flush(parts)
                parts, size = [], 0
    if parts:
        flush(parts)
    return out


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", dim: int = 1024, n: int = 3, seed: int = 11) -> Model:
    """The model of all rows whose language is not null.

    Each task sums its own rows by language, so what is shuffled is a vector for each task
    and language; the driver gets one for each language. Sums are of integers, hence the
    same in any order.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dim, n, seed), {}
        for batch in slices(batches, "text"):
            langs, found = batch.column("lang").to_pylist(), vectors(batch.column("text").to_pylist(), space)
            for lang in set(langs):
                own = found[[i for i, x in enumerate(langs) if x == lang]].sum(axis=0)
                sums[lang] = sums.get(lang, 0) + own
        for lang, total in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dim, "place": np.arange(dim, dtype=np.int32), "total": total})

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("lang is not null")
    sums = in_arrow(rows, partial, "lang string, place int, total double").groupBy("lang", "place").agg(F.sum("total").alias("total")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    out, at = np.zeros((len(langs), dim)), {x: i for i, x in enumerate(langs)}
    for lang, place, total in zip(*(sums.column(c).to_pylist() for c in ("lang", "place", "total")), strict=True):
        out[at[lang], place] = total
    return Model(langs, out, n, seed)


def predict(docs: DataFrame, model: Model, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score``, the cosine (0 where it is
    negative). A null text, one without letters, or a model without languages gives ``und``
    and 0. Equal cosines: the first language in code-point order."""
    langs, prototypes, n, seed = model
    length = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = (prototypes / np.where(length, length, 1)).T
    dim = prototypes.shape[1]
    shipped = docs.sparkSession.sparkContext.broadcast((langs, unit))
    names = [f"k{i}" for i in range(len(keep))]
    schema = T.StructType([*(T.StructField(name, docs.schema[c].dataType) for name, c in zip(names, keep, strict=True)), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, to = shipped.value
        space = Space(dim, n, seed)
        for batch in slices(batches, "text"):
            found = vectors([t or "" for t in batch.column("text").to_pylist()], space)
            size = np.linalg.norm(found, axis=1)
            if known:
                cosine = (found @ to) / np.where(size, size, 1)[:, None]
                best = cosine.argmax(axis=1)
                score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                names_ = [known[b] if s else "und" for b, s in zip(best.tolist(), size.tolist(), strict=True)]
            else:
                names_, score = ["und"] * len(found), np.zeros(len(found))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(names_, pa.string()), pa.array(np.where(size > 0, score, 0.0))], schema.names)

    rows = docs.select(*(F.col(c).alias(name) for name, c in zip(names, keep, strict=True)), F.col(text_col).alias("text"))
    return in_arrow(rows, run, schema).select(*(F.col(name).alias(c) for name, c in zip(names, keep, strict=True)), "lang_pred", "score")
