"""Token counts of a SentencePiece model by a two-tier look-up of pre-token lengths.

A pre-token is a blank run with what follows it. No piece of a whitespace-split BPE model
has a blank after another character, so the tokens of a text are those of its pre-tokens
and their counts add up. Tier one is a broadcast table of the lengths of frequent
pre-tokens; tier two encodes what that table lacks and keeps it in a cache of the worker.
Nothing but documents passes through Spark: there is no shuffle of pre-tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.llm.common import slices

#: A run of blanks and the characters up to the next one.
_RUN = re.compile(" *[^ ]+| +")
#: Longer pre-tokens are encoded but not cached.
_LONG = 64
_models: dict = {}


def _model(path: str):
    """The worker's model, loaded once. The rule above is checked on its pieces."""
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces) or model.encode("a  b　A ", out_type=str)[1:3] != ["▁", "▁b"]:
            raise ValueError("the model merges across blanks or changes white space; pre-token lengths do not add up")
        _models[path] = model, len(model.encode("x y ")) - len(model.encode("x y"))
    return _models[path]


def pre_tokens(text: str) -> list[str]:
    """The text's pre-tokens, each without the one blank (or the prefix) that opens it."""
    text = text.replace("▁", " ")
    if text == "":
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [run[1:] for run in _RUN.findall(" " + text)]


def _lengths(path: str, words: list[str]) -> list[int]:
    model, blank = _model(path)
    found = model.encode(words, num_threads=1) if words else []
    return [len(ids) if word else blank for word, ids in zip(words, found, strict=True)]


def frequent_lengths(texts: DataFrame, path: str, entries: int, sample_rows: int, seed: int) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a sample of about ``sample_rows`` rows.
    The table only saves time: what it lacks is encoded, so counts do not depend on it."""
    rows = texts.count()
    sample = texts if rows <= sample_rows else texts.sample(False, sample_rows / rows, seed)
    words = (
        sample.select(F.explode(F.split(F.col("text"), " ")).alias("word"))
        .where(F.length("word").between(1, _LONG) & ~F.col("word").contains("▁"))
        .groupBy("word").count().orderBy(F.desc("count"), "word").limit(entries)
    )
    found = [row.word for row in words.select("word").collect()]
    return dict(zip(found, _lengths(path, found), strict=True))


def _counter(path: str, table, cache_entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, cache = table.value, {}
        for batch in slices(batches, "text"):
            counts, counted, missing = [], [], set()
            for text in batch.column("text").to_pylist():
                words = Counter(pre_tokens(text or ""))
                counted.append(words)
                missing.update(w for w in words if w not in frequent and w not in cache)
            if len(cache) + len(missing) > cache_entries:
                cache.clear()
                missing = {w for words in counted for w in words if w not in frequent}
            fresh = list(missing)
            own = dict(zip(fresh, _lengths(path, fresh), strict=True))
            for words in counted:
                total = 0
                for word, n in words.items():
                    length = frequent.get(word)
                    if length is None:
                        length = cache.get(word)
                        if length is None:
                            length = own[word]
                    total += n * length
                counts.append(total)
            cache.update((w, n) for w, n in own.items() if len(w) <= _LONG)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def token_counts(
    docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096,
    entries: int = 32768, sample_rows: int = 4096, cache_entries: int = 200_000, seed: int = 7,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    A null text counts as empty: no bytes, no tokens. Texts are counted whole. Rows are
    kept as they are, repeated or with a null id; other columns are ignored; an empty
    table gives an empty result. ``model_path`` must exist on every executor. ``entries``
    bounds the broadcast table and ``cache_entries`` each worker's cache.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    frequent = frequent_lengths(texts, model_path, entries, sample_rows, seed)
    table = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    counted = texts.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(_counter(model_path, table, cache_entries), schema)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
