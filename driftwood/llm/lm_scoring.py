"""Scores of texts by a log-bilinear language model trained with noise-contrastive
estimation.

Words go to symbols: the most frequent words have their own, all others share classes by
their last letters. How many there are of both grows with the square root of the distinct
words. The model (``log_bilinear``) gives a symbol's probability after the three before it;
a word of a class has the share (count + 1) / (words + kinds + 1) of its class, so that the
words, the unseen ones of each class taken as one, have probability one in sum.

All training documents are counted, and each of their tokens is learned from, at least once:
in each round every task runs through its own documents in mini-batches, larger ones where
there are many tokens. What the tasks learned is put together by weight of their slopes.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.llm.common import slices, written
from driftwood.llm.log_bilinear import LogBilinear

#: Stands for the end of a text; no word holds a blank.
END = b" "
_CONTEXT = 3
#: Numbers of a weight vector that travel in one row.
_PIECE = 1 << 14


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words, then the end."""
    return [*text.lower().split(), END]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (binary; null is empty), one after another, and how many each
    text has: ``tokens`` for a whole batch, but for the ends."""
    as_text = pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null(b"").view(as_text)))
    words, upto = lists.flatten().cast(texts.type).cast(pa.binary()), np.cumsum(np.asarray(pc.list_value_length(lists)), dtype=np.int64)
    there = np.asarray(pc.binary_length(words)) > 0  # where white space begins or ends a text, the split leaves an empty word
    if not there.all():
        words, upto = words.filter(pa.array(there)), np.concatenate(([0], np.cumsum(there)))[upto]
    return words, np.diff(upto, prepend=0)


def word_counts(docs: DataFrame, *, text_col: str = "text", flush: int = 400_000) -> DataFrame:
    """``(word binary, n)`` over the rows of ``docs``, summed by each task first: a task sums
    what it has at one and a half times ``flush`` rows, and sends it if over ``flush`` are left."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = [], 0
        summed = lambda: pa.Table.from_batches(held, schema).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks().to_batches()
        for batch in slices(batches, "text", 4 << 20):
            words, sizes = words_of(batch.column("text"))
            ends += len(sizes)
            held.append(pa.RecordBatch.from_arrays(words.value_counts().flatten(), schema=schema))
            if sum(map(len, held)) > 1.5 * flush:
                held = summed()
                if sum(map(len, held)) > flush:
                    yield from held
                    held = []
        if ends:
            held.append(pa.RecordBatch.from_pydict({"word": [END], "n": [ends]}, schema))
            yield from summed()

    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Symbols:
    """Words to symbols. Unplaced, 0 is the end, then come the words ``own``, then ``classes``
    classes; ``placed`` renumbers them, the most frequent first."""

    def __init__(self, own: list[bytes], classes: int):
        self.known = {END: 0} | {w: i + 1 for i, w in enumerate(own)}
        self.first, self.classes = len(own) + 1, classes
        self.size = self.first + classes
        self.shared = list(range(self.first, self.size))

    def placed(self, totals: np.ndarray) -> np.ndarray:
        """Renumbers symbols by falling totals and returns the old number of each place."""
        order = np.argsort(-totals, kind="stable")
        place = np.empty(self.size, np.int64)
        place[order] = np.arange(self.size)
        self.known = {w: int(place[i]) for w, i in self.known.items()}
        self.shared = place[self.first :].tolist()
        return order

    def class_of(self, word: bytes) -> int:
        return self.shared[zlib.crc32(word.rstrip(b".,;:!?")[-3:]) % self.classes]

    def of(self, word: bytes) -> int:
        found = self.known.get(word)
        return self.class_of(word) if found is None else found

    def classes_of(self, words: pa.Array) -> np.ndarray:
        """``class_of`` each word; asks it once for the last letters that words share."""
        ends = pc.binary_slice(pc.ascii_rtrim(words.view(pa.string()), characters=".,;:!?").view(pa.binary()), -3).dictionary_encode()
        return np.array([self.class_of(w) for w in ends.dictionary.to_pylist()], np.int32)[np.asarray(ends.indices)]

    def reader(self) -> Numbers:
        return Numbers(self.known, self.classes_of)


class Numbers:
    """The numbers of words: those of ``known``, and for all others what ``of`` says."""

    def __init__(self, known: dict[bytes, int], of: Callable[[pa.Array], np.ndarray]):
        self.words, self.numbers, self.others = pa.array(known.keys(), pa.binary()), np.array([*known.values()], np.int32), of

    def of(self, words: pa.Array) -> np.ndarray:
        at = pc.index_in(words, value_set=self.words)
        there, out = np.asarray(at.is_valid()), np.empty(len(words), np.int32)
        out[there] = self.numbers[np.asarray(at.drop_null())]
        if at.null_count:
            out[~there] = self.others(words.filter(at.is_null()))
        return out


class Reader:
    """Texts as numbers with their contexts, those of symbols or other ``numbers``."""

    def __init__(self, symbols: Symbols, numbers: Numbers | None = None):
        self.numbers = numbers or symbols.reader()
        self.end = self.numbers.of(pa.array([END], pa.binary()))[0]

    def read(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """``read_words`` of texts as ``tokens`` has them."""
        return self.read_words(pa.array(chain.from_iterable(x[:-1] for x in texts), pa.binary()), np.array([len(x) - 1 for x in texts], np.int64))

    def read_words(self, words: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(contexts, symbols)`` of all tokens of all texts, one after another. Before a
        text there are ends, and after it one."""
        text = np.arange(len(sizes))
        flat = np.full(len(words) + (_CONTEXT + 1) * len(sizes), self.end, np.int32)
        flat[np.arange(len(words)) + np.repeat((_CONTEXT + 1) * text + _CONTEXT, sizes)] = self.numbers.of(words)
        at = np.arange(len(words) + len(sizes)) + np.repeat(_CONTEXT * (text + 1), sizes + 1)
        return np.stack([flat[at - i - 1] for i in range(_CONTEXT)], axis=1), flat[at]


def train(docs: DataFrame, symbols: Symbols, model: LogBilinear, *, rounds: list[str], text_col: str = "text", batch: int = 4096, trainers: int = 512) -> LogBilinear:
    """Trains ``model`` on ``docs`` and returns it. Each of ``rounds`` is a condition that
    says which documents it takes; it learns from all their tokens, ``batch`` at a time.

    In a round, at most ``trainers`` tasks start from the same weights and learn from their
    own documents. A weight becomes the mean of the tasks', each with the growth of its sum
    of squared slopes as weight, so tasks that never met a word do not hold its vector
    back. Tasks send their weights in pieces, which are summed piece by piece.
    """
    spark = docs.sparkSession
    reader_of = spark.sparkContext.broadcast(symbols)
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    for number, condition in enumerate(rounds):
        shipped = spark.sparkContext.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], number: int = number, shipped=shipped) -> Iterator[pa.RecordBatch]:
            own, reader, task = copy.deepcopy(shipped.value), Reader(reader_of.value), TaskContext.get().partitionId()
            rng = np.random.default_rng([number, task])
            contexts, found = np.zeros((0, _CONTEXT), np.int32), np.zeros(0, np.int32)
            for part in slices(batches, "text", 1 << 20):
                more = reader.read_words(*words_of(part.column("text")))
                contexts, found = np.concatenate((contexts, more[0])), np.concatenate((found, more[1]))
                whole = len(found) - len(found) % batch
                for lo in range(0, whole, batch):
                    own.step(contexts[lo : lo + batch], found[lo : lo + batch], rng)
                contexts, found = contexts[whole:], found[whole:]
            if len(found):
                own.step(contexts, found, rng)
            weights, squares = own.flat()
            grown = squares - shipped.value.flat()[1]
            if grown.any():
                for lo in range(0, len(weights), _PIECE):
                    w, g = weights[lo : lo + _PIECE], grown[lo : lo + _PIECE]
                    yield pa.RecordBatch.from_pydict({"piece": pa.array([lo // _PIECE], pa.int32()), "task": pa.array([task], pa.int32()), "weighted": [(w * g).astype(np.float32).tobytes()], "grown": [g.tobytes()]})

        def together(pieces: pa.Table) -> pa.Table:
            order = np.argsort(pieces.column("task").to_numpy())  # the same sum in every run
            total = {c: sum(np.frombuffer(pieces.column(c)[i].as_py(), np.float32).astype(np.float64) for i in order.tolist()) for c in ("weighted", "grown")}
            return pa.table({"piece": pieces.column("piece")[:1], **{c: [v.tobytes()] for c, v in total.items()}})

        learned = texts.where(condition).coalesce(trainers).mapInArrow(learn, "piece int, task int, weighted binary, grown binary")
        sums = learned.groupBy("piece").applyInArrow(together, "piece int, weighted binary, grown binary").toArrow()
        weights, squares = model.flat()
        for piece, weighted, grown in zip(*(sums.column(c).to_pylist() for c in ("piece", "weighted", "grown")), strict=True):
            at, g, w = slice(piece * _PIECE, (piece + 1) * _PIECE), np.frombuffer(grown), np.frombuffer(weighted)
            weights[at] = np.where(g > 0, w / np.where(g > 0, g, 1), weights[at])
            squares[at] += g.astype(np.float32)
        model.load(weights, squares)
    return model


def score(
    docs: DataFrame, train_on, *, id_col: str = "doc_id", text_col: str = "text", own_words: int | None = None, classes: int | None = None,
    frequent: int = 1 << 16, dim: int = 24, least_tokens: int = 6_000_000, seed: int = 5,
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score``, ``score`` (log10 probabilities of the whole text).

    ``train_on`` is a boolean column of ``docs``: whether a row is learned from. Null and
    empty texts are one end. Without training rows nothing is known and scores are those of
    uniform symbols. Rows are kept as they are, repeated or not; other columns are ignored.

    With V distinct training words, 3 sqrt(V) have symbols of their own and a quarter as many
    classes take the rest, unless they are given; the driver and each worker hold 30 sqrt(V)
    dim bytes of weights and twice that in training (46 MB for a thousand million words).
    Training learns from every token of all training documents; it goes over them again, at
    most twelve times in all, until it has learned from ``least_tokens``. The counts of the
    ``frequent`` most frequent words are broadcast; for others a row per document and word
    joins the count table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(train_on, F.lit(False)).alias("train"))
    learn = rows.where("train").select("text")
    counts = written(word_counts(learn))
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    own_words = 3 * math.isqrt(v_all) if own_words is None else own_words
    classes = max(16, own_words // 4) if classes is None else classes
    top = counts.orderBy(F.desc("n"), "word").limit(max(frequent, own_words + 1)).toArrow().to_pydict()
    table = dict(zip(top["word"], top["n"], strict=True))  # of all words with symbols of their own, at least
    symbols = Symbols([w for w in top["word"] if w != END][:own_words], classes)
    shipped_symbols = spark.sparkContext.broadcast(copy.copy(symbols))

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words and kinds of each symbol, from the whole table."""
        size, numbers = shipped_symbols.value.size, shipped_symbols.value.reader()
        total, kinds = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            at = numbers.of(batch.column("word").cast(pa.binary()))
            np.add.at(total, at, batch.column("n").to_numpy())
            np.add.at(kinds, at, 1)
        yield pa.RecordBatch.from_pydict({"symbol": np.arange(size), "total": total, "kinds": kinds})

    sums = counts.mapInArrow(by_class, "symbol long, total long, kinds long").groupBy("symbol").agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds")).toArrow()
    totals, kinds = np.zeros(symbols.size, np.int64), np.zeros(symbols.size, np.int64)
    totals[sums.column("symbol").to_numpy()], kinds[sums.column("symbol").to_numpy()] = sums.column("total").to_numpy(), sums.column("kinds").to_numpy()
    if totals[0]:
        table[END] = int(totals[0])  # with few long texts, it may not be among the frequent
    share = np.where(np.arange(symbols.size) < symbols.first, 0.0, np.log10(totals + kinds + 1.0))
    order = symbols.placed(totals)
    totals, share = totals[order], share[order]
    # a word's number is its place in the table, for others that of their symbol, after these
    known, place = {w: i for i, w in enumerate(table)}, np.array([*map(symbols.of, table), *range(symbols.size)], np.int32)
    log_counts = np.concatenate((np.log10(np.array([*table.values()], np.float64) + 1), np.zeros(symbols.size)))
    own = np.array([w in symbols.known for w in table] + [False] * symbols.size, bool)
    weighed = np.where(own, 0.0, log_counts - share[place])
    lbl = LogBilinear(totals, dim=dim, context=_CONTEXT, seed=seed)
    if n_all:
        part = "pmod(xxhash64(text), 8)"  # first an eighth, so that tasks then start from weights that know something
        passes = max(1, min(12, -(-least_tokens // n_all)))
        batch = 4096 * max(1, min(2, n_all // least_tokens))  # with many tokens there are updates enough
        lbl = train(learn, symbols, lbl, rounds=[f"{part} = 0", f"{part} != 0", *["true"] * (passes - 1)], batch=batch)
    lbl.squares = {}
    model = spark.sparkContext.broadcast((symbols, known, place, log_counts, weighed, lbl))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What needs no rare count, and the words that do."""
        symbols, known, place, log_counts, weighed, lbl = model.value
        others, one = symbols.reader(), pa.struct([("word", pa.binary()), ("n", pa.int64())])
        reader = Reader(symbols, Numbers(known, lambda words: len(known) + others.of(words)))
        for batch in slices(batches, "text", 4 << 20):
            words, sizes = words_of(batch.column("text"))
            contexts, found = reader.read_words(words, sizes)
            starts = np.cumsum(sizes + 1) - sizes - 1
            each = lambda x: np.add.reduceat(x, starts)
            logs = lbl.log_probs(place[contexts], place[found]) / math.log(10) + weighed[found]
            rare = found >= len(known)
            n_known = each((~rare).astype(np.int64))
            # a row for each text and rare word; ends are no words, and rare only where nothing is known
            rare = np.delete(rare, starts + sizes)
            kinds = words.filter(pa.array(rare)).dictionary_encode()
            text, many = np.repeat(np.arange(len(sizes)), sizes)[rare], max(1, len(kinds.dictionary))
            pairs, times = np.unique(text * many + np.asarray(kinds.indices), return_counts=True)
            upto = np.searchsorted(pairs, np.arange(len(sizes) + 1) * many)
            rare = pa.StructArray.from_arrays([kinds.dictionary.take(pa.array(pairs % many)), pa.array(times, pa.int64())], fields=list(one))
            numbers = sizes + 1, n_known, each(log_counts[found]), each(logs)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("train"), *map(pa.array, numbers), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), rare)], ["id", "train", "n_tokens", "n_known", "base", "model", "rare"])

    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "text"), *T._parse_datatype_string("n_tokens long, n_known long, base double, model double, rare array<struct<word:binary,n:long>>").fields])
    scored = written(rows.mapInArrow(local, schema).withColumn("row", F.monotonically_increasing_id()))
    tf = scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", F.col("x.n").alias("tf"))
    found = tf.join(counts, "word").groupBy("row").agg(F.sum("tf").alias("rare_known"), F.sum(F.col("tf") * F.log10(F.col("n") + F.lit(1.0))).alias("rare_log"))
    whole = scored.drop("rare").join(found, "row", "left")
    log_all = math.log10(n_all + v_all + 1)
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return whole.select(
        F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), (F.col("model") + rare_log).alias("score"),
    )
