import math
import time

import numpy as np
from pyspark.sql import functions as F

from driftwood.llm import lm_scoring
from driftwood.llm.log_bilinear import LogBilinear


def sigma(x):
    return 1 / (1 + np.exp(-x))


class Plain(LogBilinear):
    """The same model; each row goes through the matrices and sums on its own."""

    def _plain_add(self, name, at, slope):
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.diff(at[order], prepend=-1))
        total, rows = np.add.reduceat(slope[order], starts, axis=0), at[order][starts]
        self.squares[name][rows] += total * total
        self.tables[name][rows] += self.rate * total / np.sqrt(self.squares[name][rows])

    def _plain_draw(self, upto, first, stop, rng):
        below = upto[first - 1] if first else 0.0
        return np.minimum(np.searchsorted(upto, below + rng.random(self.noise) * (upto[stop - 1] - below), "right"), stop - 1)

    def step(self, contexts, symbols, rng):
        order = np.argsort(symbols, kind="stable")
        contexts, symbols = contexts[order], symbols[order]
        t, cluster = self.tables, symbols // self.width
        seen = [t["R"][contexts[:, i]] for i in range(self.context)]
        h = sum(x @ t["C"][i] for i, x in enumerate(seen))
        told = lambda v, b, at, q: 1 - sigma((h * t[v][at]).sum(axis=1) + t[b][at] - math.log(self.noise) - np.log(q[at]))
        mistaken = lambda rows, v, b, at, q: sigma(rows @ t[v][at].T + t[b][at] - math.log(self.noise) - np.log(q[at]))
        fake = self._plain_draw(self._cluster_upto, 0, len(self.q_cluster), rng)
        up, down = told("G", "g", cluster, self.q_cluster), mistaken(h, "G", "g", fake, self.q_cluster)
        back = up[:, None] * t["G"][cluster] - down @ t["G"][fake]
        coarse = np.concatenate((cluster, fake)), np.concatenate((up[:, None] * h, -(down.T @ h))), np.concatenate((up, -down.sum(axis=0)))
        up = told("Q", "b", symbols, self.q)
        back += up[:, None] * t["Q"][symbols]
        at, slopes, biases = [symbols], [up[:, None] * h], [up]
        runs = [*np.flatnonzero(np.diff(cluster, prepend=-1)).tolist(), len(cluster)]
        for lo, hi in zip(runs, runs[1:]):
            first = int(cluster[lo]) * self.width
            fake = self._plain_draw(self._upto, first, min(first + self.width, self.size), rng)
            down = mistaken(h[lo:hi], "Q", "b", fake, self.q)
            back[lo:hi] -= down @ t["Q"][fake]
            at.append(fake)
            slopes.append(-(down.T @ h[lo:hi]))
            biases.append(-down.sum(axis=0))
        through = [back @ t["C"][i].T for i in range(self.context)]
        self._plain_add("G", coarse[0], coarse[1])
        self._plain_add("g", coarse[0], coarse[2])
        self._plain_add("Q", np.concatenate(at), np.concatenate(slopes))
        self._plain_add("b", np.concatenate(at), np.concatenate(biases))
        self._plain_add("C", np.arange(self.context), np.stack([x.T @ back for x in seen]))
        self._plain_add("R", contexts.T.ravel(), np.concatenate(through))

    def log_probs(self, contexts, symbols):
        t, out = {k: v.astype(np.float64) for k, v in self.tables.items()}, []
        for c, s in zip(contexts, symbols.tolist(), strict=True):
            h, first = sum(t["R"][x] @ t["C"][i] for i, x in enumerate(c)), s // self.width * self.width
            coarse, fine = t["G"] @ h + t["g"], t["Q"][first : first + self.width] @ h + t["b"][first : first + self.width]
            out.append(coarse[s // self.width] - np.logaddexp.reduce(coarse) + fine[s - first] - np.logaddexp.reduce(fine))
        return np.array(out)


def drawn(size, n, seed=3):
    """Symbols as frequent as words are, and those before each of them."""
    symbols = np.minimum((size ** np.random.default_rng(seed).random(n + 3)).astype(np.int64) - 1, size - 1)
    return np.stack([symbols[2 - i : n + 2 - i] for i in range(3)], axis=1), symbols[3:], np.sort(np.bincount(symbols, minlength=size))[::-1]


def test_a_step_does_the_plain_step_at_less_cost():
    """The same weights from the same noise, in at most 0.8 of the time."""
    contexts, symbols, counts = drawn(9000, 8 * 8192)
    models, took = (Plain(counts), LogBilinear(counts)), ([], [])
    for lo in range(0, len(symbols), 8192):
        for model, times in zip(models, took, strict=True):
            began = time.thread_time()
            model.step(contexts[lo : lo + 8192], symbols[lo : lo + 8192], np.random.default_rng(lo))
            times.append(time.thread_time() - began)
    plain, own = models
    assert all(np.allclose(plain.tables[n], own.tables[n], atol=2e-3) and np.allclose(plain.squares[n], own.squares[n], rtol=1e-2, atol=1e-3) for n in plain.tables)
    assert min(took[1]) < 0.8 * min(took[0])


def test_steps_with_few_symbols_or_beyond_16_bits():
    for size, n, dim in ((1, 50, 2), (20, 1, 3), (20, 300, 3), (90_000, 400, 5)):
        contexts, symbols, counts = drawn(size, n)
        plain, own = Plain(counts, dim=dim), LogBilinear(counts, dim=dim)
        for i in range(3):
            for model in (plain, own):
                model.step(contexts, symbols, np.random.default_rng(i))
        assert all(np.allclose(plain.tables[k], own.tables[k], atol=1e-3) for k in plain.tables)
        assert np.allclose(plain.log_probs(contexts, symbols), own.log_probs(contexts, symbols, block=64), atol=1e-4)


def test_large_exponents_do_not_overflow():
    contexts, symbols, counts = drawn(40, 200)
    model = LogBilinear(counts, dim=4)
    model.tables["Q"] *= 4000
    model.tables["G"] *= 4000
    want = Plain.log_probs(model, contexts, symbols)
    assert want.min() < -100 and np.allclose(model.log_probs(contexts, symbols), want, rtol=1e-4, atol=1e-2)


def test_ends_that_are_not_among_the_frequent_words(spark):
    """Scores do not depend on how many words' counts are broadcast."""
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(30) for _ in range(3)) if i < 4 else t) for i, t in enumerate(["", "", "", "", "", None, "w3 w29 new"])], "doc_id long, text string").repartition(1).sortWithinPartitions("doc_id")
    got = [{r.doc_id: r for r in lm_scoring.score(docs, F.col("doc_id") < 4, own_words=5, classes=4, dim=4, frequent=n, least_tokens=1).collect()} for n in (2, 1000)]
    for i in range(7):
        few, many = (x[i] for x in got)
        assert (few.n_tokens, few.n_known) == (many.n_tokens, many.n_known) and math.isclose(few.score, many.score, rel_tol=1e-6) and math.isclose(few.base_score, many.base_score, rel_tol=1e-9)
