import functools
import os

from pyspark.sql import functions as F

from driftwood.llm import lm_scoring
from driftwood.llm.log_bilinear import LogBilinear


class Counting(LogBilinear):
    """Notes how many tokens each mini-batch has and learns nothing."""

    def __init__(self, *args, folder, **kwargs):
        super().__init__(*args, **kwargs)
        self.folder = folder

    def step(self, contexts, symbols, rng):
        with open(f"{self.folder}/{os.getpid()}", "a") as f:
            f.write(f"{len(symbols)}\n")


def test_every_token_is_learned_from(spark, monkeypatch, tmp_path):
    """Mini-batches have all tokens of the training documents, also where there are more of
    them than are asked for at least."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.col("id") % 90 + 1), lambda i: F.concat(F.lit("w"), (i % 7).cast("string")))).alias("text"))
    monkeypatch.setattr(lm_scoring, "LogBilinear", functools.partial(Counting, folder=str(tmp_path)))
    rows = lm_scoring.score(docs, F.col("doc_id") % 3 != 0, least_tokens=2_000).select("train_tokens").first()
    learned = sum(int(n) for f in tmp_path.iterdir() for n in f.read_text().split())
    assert learned == rows.train_tokens > 10_000
