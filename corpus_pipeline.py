"""From raw documents to token ids in five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.llm import bpe, language_id, line_dedup, mixing, near_copies
from driftwood.llm.common import held_out, table, written
from driftwood.llm.queries import tokenizer_path

#: A text without letters is rejected, as is one of so many n-grams or more that is below
#: this cosine with every language. Shorter texts have too few of a language's n-grams.
LEAST_SCORE, LEAST_GRAMS = 0.1, 128


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language stay; those without letters (null and empty texts
    too), or unlike every language, go. Profiles come from the rows with a label that are not
    held out; without such rows all go. Rows that repeat an id are judged each; columns stay
    as they are, and an empty table gives an empty one."""
    model = language_id.train(docs.where(~held_out("doc_id", 4) & F.col("lang").isNotNull()))
    narrow = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = language_id.predict(narrow, model, keep=["row"])
    grams = F.length(F.trim(F.regexp_replace("row.text", r"\P{L}+", " ")))
    known = (F.col("lang_pred") != "und") & ((F.col("score") >= LEAST_SCORE) | (grams < LEAST_GRAMS))
    return found.where(known).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more hold stay in one. Documents that lose all of their
    text, but for white space, go; n_chars follows the text. Null texts become empty and
    stay. Rows that repeat an id share its rights to lines."""
    out = line_dedup.dedup_lines(docs).where(r"n_dropped = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that pairs of a five-word Jaccard similarity of 0.8 or more connect,
    the document with the smallest id stays. Pairs come from SimHash's pigeonhole index and,
    where fingerprints do not tell, from prefix filters; each is compared whole. Texts without
    words, null ones too, are copies of one another; rows without an id stay, and so do
    repeats of the row that stays."""
    return near_copies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources (null is one) come near their target
    weights. Texts without words follow their source's rate; rows that share an id are drawn
    alike."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to; a row a row, null
    texts like empty ones."""
    path = tokenizer_path("word_bpe_49k.json")
    encoded = bpe.encode(docs, path, keep=["doc_id", "source"], decoded_col="decoded")
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("mix", mix_sources),
    ("bpe", encode_tokens),
]

#: Language profiles, fingerprints and merges are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each one keeps is written and read again. The
    tables stay until ``sources.shared.purge`` is called, as the result is read from them."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
