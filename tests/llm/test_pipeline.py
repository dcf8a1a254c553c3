"""The pipeline's stages against plain Python."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from driftwood.llm import mixing
from driftwood.llm.common import table
from driftwood.llm.queries import tokenizer_path
from tests.llm.conftest import ODD
from tests.llm.test_corpus_operators import brute_lines, roots


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(spark.createDataFrame(stage(spark, out[-1], sf).toArrow()))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    assert all(set(stages[0].columns) == set(s.columns) for s in stages[1:5])


def test_language_keeps_clean_documents(stages):
    kept = {i for i, _ in rows(stages[1])}
    gone = [t for i, t in rows(stages[0]) if i not in kept]
    assert len(kept) >= 0.95 * stages[0].count()
    assert all(sum(c.isalpha() for c in t) < 0.9 * len(t) for t in gone)


def test_lines_then_near_duplicates(stages):
    want = {i: t for i, t, _, n in brute_lines(rows(stages[1])) if n == 0 or t.strip(" ")}
    assert dict(rows(stages[2])) == want
    assert {i for i, _ in rows(stages[3])} == brute_kept(rows(stages[2]))


def brute_kept(docs):
    """Smallest ids of the groups that pairs of five-word Jaccard 0.8 or more connect."""
    sets, held = [], defaultdict(list)
    for n, (_, t) in enumerate(docs):
        words = (t or "").encode().lower().split()
        sets.append(frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
        for s in sets[-1] or [None]:
            held[s].append(n)
    near = {(a, b) for group in held.values() for i, a in enumerate(group) for b in group[i + 1 :]}
    pairs = [(a, b) for a, b in near if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    low = {}
    for (i, _), r in zip(docs, roots(len(docs), pairs), strict=True):
        low[r] = min(i, low.get(r, i))
    return set(low.values())


def test_stages_on_odd_rows(spark, make):
    """Nulls, empty and repeated rows, clashing columns and empty tables in every stage."""
    learned = [(40 + i, t, lang, "s") for i, (t, lang) in enumerate([("the cat and the dog went home", "en"), ("der Hund und die Katze gehen", "de")] * 3)]
    docs = make([*((i, t, None, "s") for i, t in ODD), *learned]).withColumn("_go", F.lit(1)).withColumn("_r1", F.lit(2)).withColumn("row", F.lit("x"))
    sizes = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, "")
        sizes[name] = out.count()
        assert stage(spark, docs.where("false"), "").count() == 0
        if name != "bpe":
            assert out.columns == docs.columns
    kept = {r.doc_id for r in cp.keep_languages(spark, docs, "").collect()}
    assert kept >= {5, 6, 40, 45} and not kept & {1, 2, 3, 4}
    assert sizes["line_dedup"] == sizes["bpe"] == docs.count() and sizes["language_id"] < docs.count()
    stay = sorted(r.doc_id for r in cp.drop_near_duplicates(spark, docs, "").collect() if r.doc_id is not None)
    assert set(stay) & {1, 2, 3, 4} == {1} and set(stay) & {5, 6} == {5} and set(stay) & set(range(40, 46)) == {40, 41}


def test_mix_and_tokens(stages, spark):
    plan = {r.doc_id: r.taken // r.size if r.size else None for r in mixing.plan_mix(stages[3]).collect()}
    found = {}
    for i, _ in rows(stages[4]):
        found[i] = found.get(i, 0) + 1
    assert all(found.get(i, 0) == n for i, n in plan.items() if n is not None)
    ref = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = dict(rows(stages[4]))
    assert stages[5].count() == stages[4].count()
    assert all(list(r.ids) == ref.encode(texts[r.doc_id], add_special_tokens=False).ids for r in stages[5].limit(10**6).collect())


def test_run(spark, sf):
    assert cp.run(spark, sf).count() > 100 and [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash", "mix", "bpe"]
