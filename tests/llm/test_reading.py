import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from driftwood.llm import lm_scoring
from driftwood.llm.log_bilinear import _SHORT, LogBilinear, _order, _runs, _sums

ODD = [
    None, "", " ", "\t\n\x0b\x0c\r ", "a", " a", "a ", "  a \n\n B\tc\x0bD\x0cE\rF  ", "ÀÉ x\u0085y z İ", "\x1ca\x1d \x1e\x1f", "end. end.. END! ...,;:!? a.b. 12,5 x", "\x00 a\x00b \x00",
    "日本語 日本語。 ｗｉｄｅ", "abc" * 50 + " " * 40 + "Z" * 300, "a b " * 30,
]


def as_bytes(texts):
    return [None if t is None else t.encode() for t in texts] + [b"\xff\xfe A \x80b", b"A\xc3 \xa9"]


class Asked(lm_scoring.Symbols):
    """Counts how often Python is asked for the class of a word."""

    asked = 0

    def class_of(self, word):
        self.asked += 1
        return super().class_of(word)


def plain(rows, symbols):
    contexts, found = [], []
    for row in rows:
        before = [symbols.of(lm_scoring.END)] * 3
        for w in row:
            found.append(symbols.of(w))
            contexts.append(before[::-1])
            before = [*before[1:], found[-1]]
    return contexts, found


def test_words_of_batches_are_those_of_each_text():
    """White space at either end, empty and null texts, bytes that are no UTF-8, slices."""
    for texts in (as_bytes(ODD), as_bytes(ODD)[3:7], [None], [b""], [b"x"], []):
        for kind in (pa.binary(), pa.large_binary()):
            for array in (pa.array(texts, kind), pa.array([b"not this", *texts, b"nor this"], kind)[1:-1]):
                words, sizes = lm_scoring.words_of(array)
                want = [lm_scoring.tokens(t or b"")[:-1] for t in texts]
                assert sizes.tolist() == [len(x) for x in want] and words.to_pylist() == [w for x in want for w in x]


def test_reading_words_is_reading_each_token():
    texts = as_bytes(ODD)
    symbols = lm_scoring.Symbols([b"a", b"b", b"end.", b"x"], 7)
    symbols.placed(np.random.default_rng(1).integers(0, 50, symbols.size))
    rows = [lm_scoring.tokens(t or b"") for t in texts]
    want = plain(rows, symbols)
    for got in (lm_scoring.Reader(symbols).read(rows), lm_scoring.Reader(symbols).read_words(*lm_scoring.words_of(pa.array(texts, pa.binary())))):
        assert got[0].tolist() == want[0] and got[1].tolist() == want[1]


def test_classes_are_asked_for_once_for_each_ending():
    """And not for each of 5,000 words with 40 endings."""
    symbols = Asked([b"a"], 9)
    rows = [[*(b"w%d" % i + b"e%02d" % (i % 40) for i in range(5_000)), lm_scoring.END]]
    found = lm_scoring.Reader(symbols).read(rows)[1]
    assert symbols.asked <= 40
    assert found.tolist() == [symbols.of(w) for w in rows[0]]


def test_reading_takes_half_the_time_of_a_look_at_each_word():
    rng = random.Random(4)
    words = [f"Word{i}" for i in range(20_000)]
    texts = [" ".join(words[min(int(20_000 ** rng.random()), 19_999)] for _ in range(300)).encode() for _ in range(500)]
    symbols = lm_scoring.Symbols([w.lower().encode() for w in words[:4_000]], 500)
    array, known, took = pa.array(texts, pa.binary()), dict(symbols.known), ([], [])
    reader = lm_scoring.Reader(symbols)
    for _ in range(5):
        began = time.thread_time()
        found = np.array([n if (n := known.get(w)) is not None else symbols.class_of(w) for t in texts for w in lm_scoring.tokens(t)])
        took[0].append(time.thread_time() - began)
        began = time.thread_time()
        got = reader.read_words(*lm_scoring.words_of(array))[1]
        took[1].append(time.thread_time() - began)
    assert np.array_equal(got, found) and min(took[1]) < 0.5 * min(took[0])


def test_counts_that_are_sent_before_the_end(spark):
    """The sums are those of all words, however often a task sends what it has."""
    texts = [*as_bytes(ODD), *(b" ".join(b"w%d" % (k * i % 97) for k in range(60)) for i in range(200))]
    docs = spark.createDataFrame([(None if t is None else bytearray(t),) for t in texts], "text binary").repartition(3)
    want = Counter(w for t in texts for w in lm_scoring.tokens(t or b""))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        for flush in (0, 40, 400_000):
            rows = lm_scoring.word_counts(docs, flush=flush).collect()
            assert len(rows) == len(want) and {bytes(r.word): r.n for r in rows} == dict(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert lm_scoring.word_counts(docs.where(F.lit(False))).count() == 0


def test_sums_of_runs_short_and_long():
    rng = np.random.default_rng(2)
    for most in (1, 2, _SHORT, _SHORT + 1, 300):
        sizes = rng.integers(1, most + 1, 50)
        at = np.repeat(rng.permutation(50), sizes)
        for rows in (rng.normal(size=(len(at), 6)).astype(np.float32), rng.normal(size=(len(at), 3)).astype(np.float32), rng.normal(size=(len(at), 2, 2)).astype(np.float32)):
            order = _order(at)
            starts = _runs(at[order])[:-1]
            runs, got = _sums(rows, order, starts)
            assert sorted(runs.tolist()) == list(range(50))
            assert all(np.allclose(got[i], rows[at == at[order[starts[k]]]].sum(axis=0), atol=1e-3) for i, k in enumerate(runs.tolist()))


def test_numbers_of_32_bits_train_as_those_of_64():
    rng = np.random.default_rng(3)
    symbols, counts = rng.integers(0, 400, 3_000), np.sort(rng.integers(1, 90, 400))[::-1]
    contexts = np.stack([np.roll(symbols, i + 1) for i in range(3)], axis=1)
    models = LogBilinear(counts, dim=7), LogBilinear(counts, dim=7)
    for model, kind in zip(models, (np.int32, np.int64), strict=True):
        model.step(contexts.astype(kind), symbols.astype(kind), np.random.default_rng(0))
    assert all(np.array_equal(models[0].tables[n], models[1].tables[n]) for n in models[0].tables)
    assert np.array_equal(*(m.log_probs(contexts.astype(k), symbols.astype(k)) for m, k in zip(models, (np.int32, np.int64), strict=True)))
