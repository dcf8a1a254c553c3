"""A log-bilinear model of symbols, trained by noise-contrastive estimation in numpy.

The vector that a context predicts is the sum of its symbols' vectors, each through the
matrix of its place. Symbols stand in clusters of equal numbers; the probability of a
symbol is that of its cluster times that within the cluster, each a softmax of the inner
products with the predicted vector and a bias. Both are trained by telling the symbol that
came from noise symbols that are drawn for each mini-batch.
"""

from __future__ import annotations

import math

import numpy as np

#: Tables of weights, in the order in which ``flat`` has them.
_TABLES = ("R", "C", "Q", "b", "G", "g")
_START = 1e-2
#: Exponents below this in size are summed as they are; float32 holds a million such terms.
_PLAIN = 60.0
#: Of so many rows of a run, the sum is taken along all runs at once.
_SHORT = 16


def _sigma(x: np.ndarray) -> np.ndarray:
    """Overwrites ``x``."""
    with np.errstate(over="ignore"):
        np.exp(np.negative(x, out=x), out=x)
        x += 1
        return np.reciprocal(x, out=x)


def _log_sum(x: np.ndarray, plain: bool) -> np.ndarray:
    """The logarithm of each row's summed exponentials; overwrites ``x``. ``plain``: known
    to have no exponent that is too large to be summed as it is."""
    if plain or max(x.max(), -x.min()) < _PLAIN:
        return np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype))
    top = x.max(axis=1)
    x -= top[:, None]
    np.exp(x, out=x)
    return np.log(x.sum(axis=1)) + top


def _order(at: np.ndarray) -> np.ndarray:
    """A stable order of numbers from 0 to 2^32 - 1, by 16 bits at a time, which numpy deals out without comparing."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    return order if at.max() < 1 << 16 else order[np.argsort((at >> 16).astype(np.uint16)[order], kind="stable")]


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate(([0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(sorted_)]))


def _sums(rows: np.ndarray, order: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(runs, sums)``: the sum of each run of ``rows[order]``, which begin at ``starts``, those
    of over ``_SHORT`` rows first, then by falling length. The first rows of all runs are added at once, then the second ones, as
    numpy takes longer to begin a short run than to sum it; what is left of long runs goes
    run by run, two numbers at a time."""
    size = np.diff(starts, append=len(order))
    runs = _order(np.maximum(_SHORT + 1 - size, 0))
    at, size = starts[runs], size[runs]
    out = rows.take(order[at], axis=0)
    for k in range(1, _SHORT):
        many = np.count_nonzero(size > k)
        if not many:
            break
        out[:many] += rows.take(order[at[:many] + k], axis=0)
    many = np.count_nonzero(size > _SHORT)
    if many:
        left = size[:many] - _SHORT
        begin = np.cumsum(left) - left
        x = rows.take(order[np.arange(left.sum()) + np.repeat(at[:many] + _SHORT - begin, left)], axis=0)
        pairs = x.view(np.complex64) if x.ndim == 2 and x.shape[1] % 2 == 0 and x.dtype == np.float32 else x
        out[:many] += np.add.reduceat(pairs, begin, axis=0).view(x.dtype)
    return runs, out


class LogBilinear:
    """``counts`` has the occurrences of each symbol, most frequent first. With S symbols the
    tables have about 2 S dim numbers, and training as many again."""

    def __init__(self, counts: np.ndarray, *, dim: int = 24, context: int = 3, noise: int = 12, rate: float = 0.1, seed: int = 5):
        size, rng = len(counts), np.random.default_rng(seed)
        self.size, self.context, self.noise, self.rate = size, context, noise, rate
        self.width = math.isqrt(size - 1) + 1
        firsts = np.arange(0, size, self.width)
        shares = np.asarray(counts, np.float64) + 1
        clusters = np.add.reduceat(shares, firsts)
        self.q_cluster = (clusters / clusters.sum()).astype(np.float32)
        self.q = (shares / np.repeat(clusters, self.width)[:size]).astype(np.float32)
        drawn = lambda n: rng.normal(0, 0.1, (n, dim)).astype(np.float32)
        places = np.stack([np.eye(dim, dtype=np.float32) / (i + 1) for i in range(context)])
        self.tables = {"R": drawn(size), "C": places, "Q": drawn(size), "b": np.log(self.q), "G": drawn(len(firsts)), "g": np.log(self.q_cluster)}
        self.squares = {n: np.full(v.shape, _START, np.float32) for n, v in self.tables.items()}
        self._cluster_upto, self._upto = np.cumsum(self.q_cluster, dtype=np.float64), np.cumsum(self.q, dtype=np.float64)

    # --- training

    def _add(self, names: str, at: np.ndarray, slope: np.ndarray) -> None:
        """One Adagrad step on the rows ``at``, repeats summed. Of two tables, the second has
        the bias of the first one's vectors, whose slopes stand behind those of the vector."""
        order = _order(at)
        starts = _runs(at[order])[:-1]
        runs, total = _sums(slope, order, starts)
        rows = at[order[starts[runs]]]
        dim = self.tables["R"].shape[1]
        for name, part in zip(names, (total[:, :dim], total[:, dim]) if len(names) > 1 else (total,), strict=True):
            squares = self.squares[name][rows] + part * part
            self.squares[name][rows] = squares
            self.tables[name][rows] += self.rate * part / np.sqrt(squares)

    def step(self, contexts: np.ndarray, symbols: np.ndarray, rng: np.random.Generator) -> None:
        """Learns from a mini-batch: each row of ``contexts`` has the symbols before one of
        ``symbols``, the nearest first. What depends on a context's symbol and place alone is
        reckoned once for all the rows that have them."""
        order = _order(symbols)
        symbols, before = symbols[order], contexts.T.take(order, axis=1).ravel()
        t, n, noise = self.tables, len(symbols), self.noise
        order = _order(before)
        place = sum((order >= i * n).astype(np.int64) for i in range(1, self.context))
        row, met = order - place * n, before[order]
        new = np.concatenate(([True], met[1:] != met[:-1]))
        spot = (np.cumsum(new) - 1) * self.context + place  # each word has one for each place
        words, which = met[new], np.empty(len(order), np.int64)
        which[order] = spot
        known, dim = t["R"][words], t["R"].shape[1]
        matrices = np.concatenate(t["C"], axis=1)
        placed = (known @ matrices).reshape(-1, dim)
        h = np.zeros((n, dim + 2 - dim % 2), np.float32)  # by a one, for the bias; an even number of columns
        h[:, :dim] = sum(placed.take(which[i * n : (i + 1) * n], axis=0) for i in range(self.context))
        h[:, dim] = 1

        # noise: the first row among the clusters, then one within each cluster that is there
        runs, cut = _runs(symbols // self.width), _runs(symbols)[:-1]
        own = symbols[runs[:-1]] // self.width
        first, stop = own * self.width, np.minimum((own + 1) * self.width, self.size)
        random, below = rng.random((len(own) + 1, noise)), np.where(first, self._upto[first - 1], 0.0)
        coarse = np.minimum(np.searchsorted(self._cluster_upto, random[0] * self._cluster_upto[-1], "right"), len(self.q_cluster) - 1)
        drawn = below[:, None] + random[1:] * (self._upto[stop - 1] - below)[:, None]
        fine = np.minimum(np.searchsorted(self._upto, drawn, "right"), stop[:, None] - 1)

        def with_bias(table: str, bias: str, at: np.ndarray, q: np.ndarray) -> np.ndarray:
            out = np.zeros((*at.shape, h.shape[1]), np.float32)
            out[..., :dim], out[..., dim] = t[table][at], t[bias][at] - math.log(noise) - np.log(q[at])
            return out

        # of each cluster's rows: the noise within it, the cluster itself, the noise among clusters
        told = np.concatenate((with_bias("Q", "b", fine, self.q), with_bias("G", "g", own[:, None], self.q_cluster), np.broadcast_to(with_bias("G", "g", coarse, self.q_cluster), (len(own), noise, h.shape[1]))), axis=1)
        wrong, back, slopes = np.empty((n, 2 * noise + 1), np.float32), np.empty_like(h), np.empty_like(told)
        spans = [slice(lo, hi) for lo, hi in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True)]
        for k, at in enumerate(spans):
            np.matmul(h[at], told[k].T, out=wrong[at])
        wrong = _sigma(wrong)
        wrong[:, noise] -= 1
        for k, at in enumerate(spans):
            np.matmul(wrong[at], told[k], out=back[at])
            np.matmul(wrong[at].T, h[at], out=slopes[k])
        found = np.repeat(with_bias("Q", "b", symbols[cut], self.q), np.diff(cut, append=n), axis=0)
        up = 1 - _sigma(np.einsum("ij,ij->i", h, found))
        found *= up[:, None]
        found -= back
        sums = np.zeros((len(placed), dim), np.float32)
        starts = _runs(spot)[:-1]  # a symbol's rows come place by place
        runs, total = _sums(found, row, starts)
        sums[spot[starts[runs]]] = total[:, :dim]
        sums = sums.reshape(len(words), -1)

        self._add("Gg", np.concatenate((own, coarse)), -np.concatenate((slopes[:, noise], slopes[:, noise + 1 :].sum(axis=0))))
        runs, total = _sums(h * up[:, None], np.arange(n), cut)
        self._add("Qb", np.concatenate((symbols[cut[runs]], fine.ravel())), np.concatenate((total, -slopes[:, :noise].reshape(-1, h.shape[1]))))
        self._add("R", words, sums @ matrices.T)
        self._add("C", np.arange(self.context), (known.T @ sums).reshape(dim, self.context, dim).transpose(1, 0, 2))

    # --- exchange between tasks

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All weights and all sums of squared slopes, each as one vector."""
        return tuple(np.concatenate([x[n].ravel() for n in _TABLES]) for x in (self.tables, self.squares))

    def load(self, weights: np.ndarray, squares: np.ndarray) -> None:
        for kind, vector in ((self.tables, weights), (self.squares, squares)):
            lo = 0
            for n in _TABLES:
                kind[n] = vector[lo : lo + kind[n].size].reshape(kind[n].shape).astype(np.float32)
                lo += kind[n].size

    # --- scoring

    def log_probs(self, contexts: np.ndarray, symbols: np.ndarray, chunk: int = 1 << 15, block: int = 1 << 10) -> np.ndarray:
        """The normalised natural logarithm of each symbol's probability. Rows meet all
        clusters ``block`` at a time, which a processor's own memory holds."""
        one = lambda x, bias: np.concatenate((x, bias[:, None]), axis=1)  # noqa: E731  vectors with their bias as a further number
        t, firsts = self.tables, np.arange(0, self.size, self.width)
        placed = [t["R"] @ t["C"][i] for i in range(self.context)]
        placed = [one(x, np.full(self.size, i == 0, np.float32)) for i, x in enumerate(placed)]
        coarse, fine = one(t["G"], t["g"]).T, one(t["Q"], t["b"])
        # an inner product is at most that of the lengths
        length = lambda x: np.sqrt(np.einsum("ij,ij->i", x, x))
        among, biased = float(length(t["G"]).max()), float(np.abs(t["g"]).max())
        longest, most_biased = (np.maximum.reduceat(x, firsts).tolist() for x in (length(t["Q"]), np.abs(t["b"])))
        out = np.zeros(len(symbols))
        for start in range(0, len(symbols), chunk):
            order = _order(symbols[start : start + chunk]) + start
            before, own = contexts.take(order, axis=0), symbols[order]
            h = sum(placed[i].take(before[:, i], axis=0) for i in range(self.context))
            cluster, most = own // self.width, float(length(h).max())
            found = np.einsum("ij,ij->i", h, fine.take(own, axis=0) + coarse.T.take(cluster, axis=0))
            for lo in range(0, len(own), block):
                found[lo : lo + block] -= _log_sum(h[lo : lo + block] @ coarse, most * among + biased < _PLAIN)
            runs = _runs(cluster).tolist()
            for begin, end in zip(runs, runs[1:]):
                first, k = int(cluster[begin]) * self.width, int(cluster[begin])
                table = fine[first : min(first + self.width, self.size)].T
                for lo in range(begin, end, block):
                    hi = min(lo + block, end)
                    found[lo:hi] -= _log_sum(h[lo:hi] @ table, most * longest[k] + most_biased[k] < _PLAIN)
            out[order] = found
        return out
