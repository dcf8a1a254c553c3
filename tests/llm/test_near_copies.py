"""Near copies against all pairs in plain Python."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from driftwood.llm import near_copies
from driftwood.llm.common import table
from tests.llm.conftest import ODD


def brute_sets(rows):
    out = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        out.append(frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    return out


def brute_pairs(sets):
    """All pairs of a similarity of 0.8 or more, and of equal sets."""
    held, both = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s or [()]:
            both.update((j, i) for j in held[x])
            held[x].append(i)
    return [(a, b) for (a, b), n in both.items() if sets[a] == sets[b] or 5 * n >= 4 * len(sets[a] | sets[b])]


def brute_keep(rows):
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in brute_pairs(brute_sets(rows)):
        at[root(a)] = root(b)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[root(i)] = min(low.get(root(i), doc_id), doc_id)
    go = {doc_id for i, (doc_id, _) in enumerate(rows) if doc_id is not None and doc_id != low[root(i)]}
    return Counter(r for r in rows if r[0] not in go)


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stage_keeps_one_of_all_pairs_at_080(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    want = brute_keep([(r.doc_id, r.text) for r in docs.collect()])
    assert kept(cp.drop_near_duplicates(spark, docs, sf)) == want and sum(want.values()) < docs.count()


def test_odd_rows(odd):
    assert kept(near_copies.keep_one(odd)) == brute_keep(ODD)
    assert near_copies.keep_one(odd.where("false")).count() == 0


@pytest.mark.parametrize("pairs", [4, -1])
def test_group_around_and_below_the_bar(make, monkeypatch, pairs):
    """Copies of one text with up to eight words changed, some too far from all others."""
    monkeypatch.setattr(near_copies, "_PAIRS", pairs)
    monkeypatch.setattr(near_copies, "_ROUNDS", 3)
    rng, rows = random.Random(5), []
    base = [f"w{i}" for i in range(200)]
    for i in range(120):
        own = list(base)
        for at in rng.sample(range(200), rng.randrange(9)):
            own[at] = f"x{rng.random()}"
        rows.append((i, " ".join(own)))
    assert kept(near_copies.keep_one(make(rows))) == brute_keep(rows)
