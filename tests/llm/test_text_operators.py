"""Token counts, language ID, BPE and LM scores against the libraries and plain Python."""

import hashlib
import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftwood.llm import bpe, language_id, lm_scoring, token_counts
from driftwood.llm.common import held_out, slices, table
from driftwood.llm.queries import queries, tokenizer_path
from tests.llm.conftest import ODD

PIECE, WORD = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")
REF = Tokenizer.from_file(WORD)


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_token_counts_odd(odd):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for entries, cached in ((5, 3), (1000, 1000)):
        got = token_counts.token_counts(odd, PIECE, limit=100, entries=entries, sample_rows=4, cache_entries=cached).collect()
        want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 100) for i, t in ODD]
        assert by_id(got) == by_id(want)


def test_token_counts_table(spark, sf):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r.doc_id: r.n_tokens for r in queries()["op1_token_counts"](spark, sf).collect()}
    assert got == {r.doc_id: len(model.encode(r.text)) for r in table(spark, sf, "documents").collect()}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(" ▁ab\n\té日\x00<s>"), max_size=30))
def test_pre_tokens_add_up(text):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert sum(token_counts._lengths(PIECE, token_counts.pre_tokens(text))) == len(model.encode(text))


def test_bpe_odd(odd):
    ref = Tokenizer.from_file(WORD)
    got = bpe.decode(bpe.encode(odd, WORD, keep=["doc_id", "id"]), WORD, keep=["doc_id", "ids"]).collect()
    want = []
    for i, t in ODD:
        ids = ref.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, ref.decode(ids, skip_special_tokens=False)))
    assert by_id(got) == by_id(want)
    both = bpe.encode(odd, WORD, keep=["doc_id"], decoded_col="ids2").collect()
    assert by_id(both) == by_id(want)


def test_bpe_table(spark, sf):
    ref = Tokenizer.from_file(WORD)
    got = {r.doc_id: list(r.ids) for r in bpe.encode(table(spark, sf, "documents"), WORD, keep=["doc_id"]).collect()}
    docs = table(spark, sf, "documents").collect()
    assert got == {d.doc_id: e.ids for d, e in zip(docs, ref.encode_batch([d.text for d in docs], add_special_tokens=False), strict=True)}


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=25))
def test_bpe_any_text(text):
    ref = REF
    ids = [i for c in bpe.chunks(text) for i in bpe.codec(WORD).chunk(c)]
    assert ids == ref.encode(text, add_special_tokens=False).ids
    assert bpe.decode_ids(pa.array([ids], pa.list_(pa.int32())), bpe.labels(WORD)).to_pylist() == [ref.decode(ids, skip_special_tokens=False)]


def test_bpe_query(spark, sf):
    """The query's digests are those of what the library gives; an empty table gives none."""
    docs = table(spark, sf, "documents")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for d in docs.collect():
        ids = REF.encode(d.text or "", add_special_tokens=False).ids
        want.append((d.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(REF.decode(ids, skip_special_tokens=False))))
    assert by_id(queries()["op8_bpe"](spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == by_id(want)
    empty = bpe.encode(docs.where("false"), WORD, keep=["doc_id"])
    assert empty.count() == 0 and bpe.decode(empty, WORD, keep=["doc_id"]).count() == 0
    assert token_counts.token_counts(docs.where("false"), PIECE).count() == 0


def test_table_is_compiled_once():
    """There is a table after loading, and encoding changes nothing in it."""
    made = bpe.WordCodec(WORD).automaton
    tables = lambda: tuple(map(bytes, (made.bounds, made.class_start, made.class_of, made.column)))
    before, kept = tables(), set(vars(made))
    assert len(made.bounds) > 100_000 and len(made.class_start) > 1000
    for word in ("internationalisation", "xqzjkv", "aaaaaaaaaa", "déjà".encode().decode("latin-1")):
        made.encode(word.replace("\xa0", "x").replace("\xc3", "x").replace("\xa9", "x"))
    assert tables() == before and set(vars(made)) == kept


def test_bpe_decode_odd():
    ids = pa.array([[320, None, -5, 10**6, 321], None, [], [49406, 320]], pa.list_(pa.int32()))
    known = bpe.labels(WORD)
    names = [known[i].as_py() for i in (320, 321, 49406)]
    assert bpe.decode_ids(ids, known).to_pylist() == [f"{names[0]} {names[1]}", "", "", f"{names[2]} {names[0]}"]
    assert bpe.decode_ids(ids.slice(3), known).to_pylist() == [f"{names[2]} {names[0]}"] and bpe.decode_ids(ids[:0], known).to_pylist() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=12), st.text(alphabet="abc", min_size=1, max_size=14))
def test_automaton_is_bpe(picks, word):
    """Any list of merges: the automaton gives what merging by rank gives."""
    vocab, merges = {c: i for i, c in enumerate("abc")}, []
    for a, b in picks:
        names = list(vocab)
        u, v = names[a % len(names)], names[b % len(names)]
        if u + v not in vocab:
            vocab[u + v] = len(vocab)
            merges.append((u, v))
    rank, parts = {m: i for i, m in enumerate(merges)}, list(word)
    while len(parts) > 1:
        best = min((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
        if best[0] == 1 << 30:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    assert bpe.Automaton(vocab, merges).encode(word) == [vocab[p] for p in parts]


def test_language_held_out_accuracy(spark):
    rows = queries()["op2_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: (r.lang, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(held) > 100
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) / len(held) > 0.97


def test_language_vectors_brute_force(make):
    space = language_id.Space(128, 3, 11)
    text = "Ab, c\n\nÉd 12 x"
    letters = " ab c éd x "
    want = np.zeros(128)
    for i in range(len(letters) - 2):
        want += np.prod([np.roll(space.letters(np.array([ord(c)]), 0)[0], 2 - k) for k, c in enumerate(letters[i : i + 3])], axis=0)
    assert (language_id.vectors([text, "", "123 .", text], space)[[0, 3]] == want).all()
    assert not language_id.vectors(["", "1 2", "\n"], space).any()


def test_language_predictions_by_brute_force(spark, sf):
    """Every row's language and score, from trigram counts and vectors in plain numpy."""
    rows = [(r.doc_id, r.text, r.lang) for r in table(spark, sf, "documents").collect()]
    space = language_id.Space(1024, 3, 11)
    cached = {}

    def gram(g):
        if g not in cached:
            cached[g] = np.prod([np.roll(space.letters(np.array([ord(c)]), 0)[0], 2 - k) for k, c in enumerate(g)], axis=0)
        return cached[g]

    def vector(text):
        letters = " " + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "") + " "
        letters = " " + " ".join(letters.split()) + " " if letters.strip() else ""
        out = np.zeros(1024)
        for g, n in Counter(letters[i : i + 3] for i in range(len(letters) - 2)).items():
            out += n * gram(g)
        return out

    found = {i: vector(t) for i, t, _ in rows}
    sums = {}
    for i, _, lang in rows:
        if lang is not None and crc32(str(i).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + found[i]
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries()["op2_language_id"](spark, sf).collect()}
    for i, _, _ in rows:
        size = np.linalg.norm(found[i])
        close = {k: float(found[i] @ v) / np.linalg.norm(v) / size for k, v in sums.items()} if size else {}
        best = max(sorted(close), key=close.get) if close else "und"
        assert got[i][0] == best and math.isclose(got[i][1], max(close.get(best, 0.0), 0.0), abs_tol=1e-9)


def test_language_kept_letters_do_not_matter(monkeypatch):
    space, few = language_id.Space(64, 3, 1), language_id.Space(64, 3, 1)
    text = "".join(chr(0x4E00 + i * 7 % 500) for i in range(900))
    whole = language_id.vectors([text], space)
    monkeypatch.setattr(language_id, "_KEPT", 3)
    assert (language_id.vectors([text], few) == whole).all() and len(few._letters) <= 3


def test_language_pieces_do_not_matter(monkeypatch):
    space = language_id.Space(64, 3, 1)
    text = "".join(random.Random(1).choice("ab c,é\n") for _ in range(500))
    whole = language_id.vectors([text], space)
    monkeypatch.setattr(language_id, "_CHARS", 7)
    assert (language_id.vectors([text], space, step=5) == whole).all()


def test_language_odd(make, odd):
    docs = make([*((i, t, "aa" if (i or 0) % 2 else None, None) for i, t in ODD), (30, "the cat and the dog", "en"), (31, "der Hund und die Katze", "de")])
    model = language_id.train(docs)
    assert model[0] == ["aa", "de", "en"]
    got = language_id.predict(docs, model, keep=["doc_id", "text"]).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    empty = language_id.train(docs.where("false"))
    assert {r.lang_pred for r in language_id.predict(docs, empty, keep=["doc_id"]).collect()} == {"und"}
    assert language_id.predict(docs.where("false"), model, keep=["doc_id"]).count() == 0


def brute_base(rows, train):
    counts = Counter(w for i, t in rows if train(i) for w in [*(t or "").encode().lower().split(), b" "])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), b" "]
        out.append((i, not train(i), len(words), sum(counts[w] > 0 for w in words), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 6)))
    return out


@pytest.mark.parametrize("frequent", [3, 1000])
def test_lm_base_odd(make, frequent):
    rows = ODD + [(100 + i, f"the cat {i} sat on the mat") for i in range(30)]
    learned = lambda i: i is None or crc32(str(i).encode()) % 7 != 2
    got = lm_scoring.score(make(rows), ~held_out("doc_id", 7), own_words=5, classes=4, frequent=frequent, dim=4).collect()
    assert by_id((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == by_id(brute_base(rows, learned))


def bigram_on_held_out(docs):
    """log10 per held-out token of an absolutely discounted bigram over the same symbols."""
    learned, held = [], []
    for d in docs:
        (held if crc32(str(d.doc_id).encode()) % 7 == 2 else learned).append(lm_scoring.tokens((d.text or "").encode()))
    counts = Counter(w for x in learned for w in x)
    own = 3 * math.isqrt(len(counts))
    symbols = lm_scoring.Symbols([w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if w != lm_scoring.END][:own], own // 4)
    totals, kinds = Counter(), Counter()
    for w, n in counts.items():
        totals[symbols.of(w)] += n
        kinds[symbols.of(w)] += 1
    pairs, firsts = Counter(), Counter()
    for x in learned:
        ids = [0, *map(symbols.of, x)]
        pairs.update(zip(ids, ids[1:]))
        firsts.update(ids[:-1])
    spread, size, total, n = Counter(a for a, _ in pairs), sum(counts.values()) + symbols.size, 0.0, 0
    for x in held:
        ids = [0, *map(symbols.of, x)]
        for a, b, w in zip(ids, ids[1:], x):
            plain = (totals[b] + 1) / size
            p = (max(pairs[a, b] - 0.75, 0) + 0.75 * spread[a] * plain) / firsts[a] if firsts[a] else plain
            total += math.log10(p) + (math.log10((counts[w] + 1) / (totals[b] + kinds[b] + 1)) if w not in symbols.known else 0)
            n += 1
    return total / n


def test_lm_beats_base_and_bigrams_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries()["op10_lm_scores"](spark, sf).where("held_out").collect()
    n = sum(r.n_tokens for r in rows)
    score, base = sum(r.score for r in rows) / n, sum(r.base_score for r in rows) / n
    assert len(rows) > 100 and score > base + 0.25 and score > bigram_on_held_out(table(spark, sf, "documents").collect()) + 0.05


def trained(rows, symbols, counts, steps):
    model = lm_scoring.LogBilinear(counts, dim=8, noise=6, seed=1)
    contexts, found = lm_scoring.Reader(symbols).read(rows)
    for i in range(steps):
        model.step(contexts, found, np.random.default_rng(i))
    return model, contexts, found


def test_lm_is_normalised_and_learns():
    rng = random.Random(2)
    follow = {w: [rng.choice(b"abcdefghijkl") for _ in range(2)] for w in b"abcdefghijkl"}
    rows = []
    for _ in range(60):
        w, out = rng.choice(b"abcdefghijkl"), []
        for _ in range(40):
            out.append(bytes([w]))
            w = rng.choice(follow[w])
        rows.append([*out, lm_scoring.END])
    symbols = lm_scoring.Symbols([bytes([w]) for w in b"abcdefghijkl"], 3)
    _, found = lm_scoring.Reader(symbols).read(rows)
    symbols.placed(np.bincount(found, minlength=symbols.size))
    counts = np.sort(np.bincount(found, minlength=symbols.size))[::-1]
    model, contexts, found = trained(rows, symbols, counts, 300)
    every = np.arange(symbols.size)
    for context in ([0, 0, 0], [3, 1, 15], [7, 7, 2]):
        p = np.exp(model.log_probs(np.tile(context, (symbols.size, 1)), every))
        assert math.isclose(p.sum(), 1, rel_tol=1e-5) and (p > 0).all()
    unigram = np.log((counts + 1) / (counts + 1).sum())[found].mean()
    assert model.log_probs(contexts, found).mean() > unigram + 1.0  # two followers of twelve: ln 6 is 1.8
    assert np.allclose(model.log_probs(contexts, found, chunk=7), model.log_probs(contexts, found), atol=1e-4)


def test_lm_contexts():
    symbols = lm_scoring.Symbols([b"a", b"b"], 2)
    contexts, found = lm_scoring.Reader(symbols).read([[b"a", b"b", b" "], [b" "]])
    assert found.tolist() == [1, 2, 0, 0] and contexts.tolist() == [[0, 0, 0], [1, 0, 0], [2, 1, 0], [0, 0, 0]]


def test_lm_scores_by_brute_force(make):
    """``score`` is the sum over tokens of the model's log10 and the share within a class."""
    rows = [(i, t) for i, t in ODD if i is not None] + [(100 + i, f"the cat {i} sat on the mat and the dog") for i in range(30)]
    kept = {}
    plain = lm_scoring.train
    try:
        lm_scoring.train = lambda docs, symbols, model, **kw: kept.setdefault("all", (symbols, plain(docs, symbols, model, **kw)))[1]
        docs = make(rows)
        got = {r.doc_id: r.score for r in lm_scoring.score(docs, docs["doc_id"] % 2 == 0, own_words=6, classes=4, frequent=5, dim=4).collect()}
    finally:
        lm_scoring.train = plain
    symbols, model = kept["all"]
    counts, totals, kinds = Counter(), Counter(), Counter()
    for i, t in rows:
        if i % 2 == 0:
            counts.update(lm_scoring.tokens((t or "").encode()))
    for w, n in counts.items():
        totals[symbols.of(w)] += n
        kinds[symbols.of(w)] += 1
    t = {k: v.astype(np.float64) for k, v in model.tables.items()}
    for i, text in rows:
        before, want = [symbols.of(b" ")] * 3, 0.0
        for w in lm_scoring.tokens((text or "").encode()):
            s = symbols.of(w)
            h = sum(t["R"][before[-1 - k]] @ t["C"][k] for k in range(3))
            coarse, first = np.exp(t["G"] @ h + t["g"]), s // model.width * model.width
            fine = np.exp(t["Q"][first : first + model.width] @ h + t["b"][first : first + model.width])
            want += math.log10(coarse[s // model.width] / coarse.sum() * fine[s - first] / fine.sum())
            if w not in symbols.known:
                want += math.log10((counts[w] + 1) / (totals[s] + kinds[s] + 1))
            before.append(s)
        assert math.isclose(got[i], want, rel_tol=1e-4, abs_tol=1e-3)


def test_lm_class_shares(make):
    """Within a class, words have probabilities in proportion to count + 1, an unseen word 1."""
    rows = [(i, t) for i, t in enumerate(["a b c", "a b d", "zz yy", "a c", "b"])]
    symbols, counts = lm_scoring.Symbols([b"a", b"b"], 3), Counter("a b c a b d zz yy a c b".split())
    classes = {}
    for w in ["c", "d", "zz", "yy", *(f"u{k}" for k in range(12))]:
        classes.setdefault(symbols.of(w.encode()), []).append(w)
    words = [w for ws in classes.values() for w in ws]
    docs = make(rows + [(2000 + i, w) for i, w in enumerate(words)])
    found = lm_scoring.score(docs, docs["doc_id"] < 1000, own_words=2, classes=3, dim=3).collect()
    got = {words[r.doc_id - 2000]: 10**r.score for r in found if r.doc_id >= 2000}
    for members in classes.values():
        assert all(math.isclose(got[w] / got[members[0]], (counts[w] + 1) / (counts[members[0]] + 1), rel_tol=1e-9) for w in members)


def test_lm_empty(make):
    docs = make([(1, "a")]).where("false")
    assert lm_scoring.score(docs, ~held_out("doc_id", 7)).count() == 0
    docs = make([(1, "a b"), (2, None)])
    got = lm_scoring.score(docs, docs["doc_id"] < 0).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(3, 0, 0), (1, 0, 0)} and all(np.isfinite(r.score) for r in got)


def test_slices_keep_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 5, None, "", "b" * 30, "c"]})
    assert [x for s in slices(iter([batch]), "text", 10) for x in s.column("text").to_pylist()] == batch.column("text").to_pylist()
