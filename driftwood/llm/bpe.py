"""BPE encoding and decoding with a tokenization automaton.

The automaton's states are tokens (the last one read) and its arcs are labelled with the
next token. It starts with every arc between the base symbols. Merges are compiled one
after the other, each by a gadget: merging u and v makes a state w that is entered from
where u was, is left to where v could go, and cuts the arc from u to v. States are numbered
so that all copies of a cut are a rectangle, and the table keeps for every class of states
the runs of next states that are cut. It is made once, when the vocabulary is loaded, and
encoding does nothing but look arcs up in it. Of a word's prefix exactly one path ends at
each position, so a word is encoded by one walk over the table, and decoding emits the
arcs' labels. Which labels end at a position is found by a string matcher over all labels.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, pre_tokenizers

from driftwood.llm.common import in_arrow, release, slices

#: Stands for a suffix among the symbols.
_LAST = "\uffff"
#: The state before a word, which any token may follow.
_BEGIN = (1 << 24) - 1
#: Unicode white space, for use within a class. Python's own \\s splits at \\x1c-\\x1f too.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = re.compile("[\x1c-\x1f]")
_GAPS = re.compile(f"[{_WHITE}]+")


def chunks(text: str) -> list[str]:
    """The text's runs of characters that are not white space."""
    return [x for x in _GAPS.split(text) if x] if _ODD.search(text) else text.split()


def _numbered(copied_from: dict[int, int], states: Iterable[int], born: dict[int, int]) -> tuple[dict[int, int], dict[int, int], dict[int, list[int]]]:
    """A number for each state, and the first number behind it and all that were copied
    from it, directly or not. Copies follow their source, the latest first. Also the copies
    of each state in that order."""
    copies: dict[int, list[int]] = {}
    for w in sorted(copied_from, key=born.__getitem__, reverse=True):
        copies.setdefault(copied_from[w], []).append(w)
    first, behind = {}, {}
    for root in states:
        if root in copied_from:
            continue
        stack = [root]
        while stack:
            x = stack.pop()
            if x in first:
                behind[x] = len(first)
                continue
            first[x] = len(first)
            stack.append(x)
            stack.extend(reversed(copies.get(x, ())))
    return first, behind, copies


class Automaton:
    """The automaton of an ordered list of merges, over symbols that are strings. With a
    ``suffix``, the last symbol of a word bears it. It is compiled when it is made; encoding
    reads its tables and changes nothing."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        self.born: dict[int, int] = {}
        self.parents: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for time, (u, v) in enumerate(merges):
            self._add_gadget(time, vocab[u], vocab[v], vocab[u + v])
        # states that can be reached: those of symbols, and of merges that nothing pre-empts
        whole: dict[int, bool] = {}
        for w, (u, v) in self.parents.items():
            whole[w] = whole.get(u, True) and whole.get(v, True) and self._open_before(u, v, self.born[w])
        made = {u + v for u, v in merges}
        self.tokens = {t: i for t, i in vocab.items() if (whole[i] if i in whole else t not in made)}
        self._compile(vocab.values())
        # which labels end at each symbol of a word, the longest first; the suffix counts as one symbol
        self.matcher = ahocorasick.Automaton()
        for t, i in self.tokens.items():
            last = bool(suffix) and t.endswith(suffix) and t != suffix
            self.matcher.add_word(t[: -len(suffix)] + _LAST if last else t, (i, len(t) - (len(suffix) - 1) * last))
        if self.tokens:
            self.matcher.make_automaton()
        del self.born, self.parents, self.merged

    def _add_gadget(self, time: int, u: int, v: int, w: int) -> None:
        """Cuts the arc u -> v from ``time`` on; w, if new, gets u's way in and v's way out."""
        self.merged.setdefault((u, v), time)
        if w not in self.born:
            self.born[w], self.parents[w] = time, (u, v)

    def _open_before(self, x: int, y: int, before: int) -> bool:
        """Whether the arc x -> y was there before a time, while gadgets are applied."""
        base = -1
        while True:
            if self.merged.get((x, y), before) < before:
                return False
            bx, by = self.born.get(x, base), self.born.get(y, base)
            if bx == by == base:
                return True
            if bx > by:
                before, x = min(before, bx), self.parents[x][1]  # x was made as a copy of its right part
            else:
                before, y = min(before, by + 1), self.parents[y][0]  # y as a copy of its left part, just after

    def _compile(self, states: Iterable[int]) -> None:
        """The transition table. A gadget's cut of u -> v holds for u, v and the states copied
        from them later on. States are numbered, once by where their ways out and once by
        where their ways in were copied from, so that these are runs of numbers: a cut is a
        rectangle of the table. Rows between the same corners are one state class. For each
        class the table has the runs of next states that are cut, flat and in order."""
        states = sorted(states)
        out, out_behind, out_copies = _numbered({w: v for w, (_, v) in self.parents.items()}, states, self.born)
        into, into_behind, into_copies = _numbered({w: u for w, (u, _) in self.parents.items()}, states, self.born)

        def run(first: dict, behind: dict, copies: dict, state: int, after: int) -> tuple[int, int]:
            later = bisect_left(copies.get(state, ()), -after, key=lambda c: -self.born[c])
            return first[state], behind[copies[state][later - 1]] if later else first[state] + 1

        rows = [(*run(out, out_behind, out_copies, u, t), *run(into, into_behind, into_copies, v, t - 1)) for (u, v), t in self.merged.items()]
        x0, x1, y0, y1 = np.array(rows, np.int64).reshape(-1, 4).T
        corners = np.unique(np.concatenate(([0, len(out)], x0, x1)))
        used = np.zeros(len(out) + 1, np.int64)  # classes of no state that a word can be in are left out
        ends = {i for t, i in self.tokens.items() if self.suffix and t.endswith(self.suffix)}
        used[[out[i] for i in self.tokens.values() if i not in ends]] = 1
        live = np.add.reduceat(used, corners[:-1]) > 0 if len(corners) > 1 else np.zeros(0, bool)
        number = np.concatenate(([0], np.cumsum(live)))
        lo, hi = number[np.searchsorted(corners, x0)], number[np.searchsorted(corners, x1)]
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        a, b = np.repeat(y0, size), np.repeat(y1, size)
        order = np.lexsort((a, at))
        at, a, b = at[order], a[order], b[order]
        width = len(into) + 1  # runs of one class that overlap or touch become one
        top = np.maximum.accumulate(at * width + b) if len(at) else b
        fresh = np.concatenate(([True], at[1:] * width + a[1:] > top[:-1])) if len(at) else np.zeros(0, bool)
        starts = np.flatnonzero(fresh)
        stops = top[np.concatenate((starts[1:] - 1, [len(at) - 1]))] - at[starts] * width if len(at) else b
        bounds = np.stack((a[starts], stops), axis=1).ravel()
        per_class = np.bincount(at[starts], minlength=int(number[-1])) * 2
        self.bounds = array("i", bounds.astype(np.int32).tobytes())
        self.class_start = array("i", np.concatenate(([0], np.cumsum(per_class))).astype(np.int32).tobytes())
        most = max(states, default=-1) + 1
        self.class_of, self.column = array("i", bytes(4 * most)), array("i", bytes(4 * most))
        for i in states:
            self.class_of[i] = number[np.searchsorted(corners, out[i], "right") - 1]
            self.column[i] = into[i]

    def arc(self, x: int, y: int) -> bool:
        """Whether token y may follow token x: its column is in no run that x's class cuts."""
        c = self.class_of[x]
        start = self.class_start[c]
        return not (bisect_right(self.bounds, self.column[y], start, self.class_start[c + 1]) - start) & 1

    def encode(self, text: str) -> list[int]:
        """The tokens of a word: at each position the one token that ends a valid path."""
        whole = self.tokens.get(text + self.suffix)
        if whole is not None:
            return [whole]
        if not text:
            return []
        n, bounds, starts, classes, columns = len(text) + bool(self.suffix), self.bounds, self.class_start, self.class_of, self.column
        state, start = [-1] * (n + 1), [0] * (n + 1)
        if self.suffix:
            state[n - 1] = -2  # no path ends there: the last symbol bears the suffix
        state[0] = _BEGIN
        for end, (token, size) in self.matcher.iter(text + _LAST if self.suffix else text):
            j = end + 1
            if state[j] != -1:
                continue
            before = state[j - size]
            if before < 0:
                continue
            if before != _BEGIN:
                first = starts[c := classes[before]]
                if (bisect_right(bounds, columns[token], first, starts[c + 1]) - first) & 1:
                    continue
            state[j], start[j] = token, j - size
        if state[n] < 0:
            raise ValueError(f"no path for {text!r}")
        out, j = [], n
        while j:
            out.append(state[j])
            j = start[j]
        return out[::-1]


def _byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: itself where it is
    printable in Latin-1, else the next code point from 256 on."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class WordCodec:
    """A word-end BPE vocabulary file: normaliser, word pattern, automaton and labels."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("this codec reads word-end BPE files with the NFC, white space, lower case normaliser and no decoder")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", _WHITE))
        # for characters that this Python does not know: the normaliser and pattern of the file's library
        self.normal, self.split_odd = Tokenizer.from_file(path).normalizer, pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.automaton = Automaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], self.suffix)
        self.symbols = dict(enumerate(_byte_symbols()))

    def split(self, text: str) -> list[str | int]:
        """The words of a text without white space (or with it); special tokens as ids."""
        if "<|" not in text:
            return self._words(text)
        out = []
        for part in self.cut.split(text):
            out.extend([self.special[part]] if part in self.special else self._words(part))
        return out

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            low = text.lower()
        elif not text.isprintable() and any(unicodedata.category(c) == "Cn" for c in text):
            return [word for word, _ in self.split_odd.pre_tokenize_str(self.normal.normalize_str(text))]
        else:
            low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter: no final sigma
        return [low] if low.isalpha() else self.words.findall(low)

    def word(self, word: str) -> list[int]:
        plain = word.isascii() and word.isprintable()  # its bytes stand for themselves
        return self.automaton.encode(word if plain else word.encode("utf-8", "replace").decode("latin-1").translate(self.symbols))

    def chunk(self, text: str) -> list[int]:
        return [i for x in self.split(text) for i in ([x] if isinstance(x, int) else self.word(x))]


class ChunkTable:
    """Ids of chunks, and of the words in them, seen before: a number for each, and the ids
    of all of them one after another."""

    def __init__(self, words: WordCodec, entries: int, most_ids: int = 1 << 22):
        self.words, self.entries, self.most_ids = words, entries, most_ids
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.stops, self.ids = array("q", [0]), array("i")

    def _add(self, text: str, ids: list[int] | array) -> None:
        self.numbers[text] = len(self.numbers)
        self.ids.extend(ids)
        self.stops.append(len(self.ids))

    def add(self, chunk: str) -> None:
        parts = self.words.split(chunk)
        for part in parts:
            if part not in self.numbers and not isinstance(part, int):
                self._add(part, self.words.word(part))
        if chunk not in self.numbers:
            ids = array("i")
            for part in parts:
                if isinstance(part, int):
                    ids.append(part)
                else:
                    number = self.numbers[part]
                    ids.extend(self.ids[self.stops[number] : self.stops[number + 1]])
            self._add(chunk, ids)

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        parts = [chunks(x) for x in texts]
        flat = list(chain.from_iterable(parts))
        if len(self.numbers) > self.entries or len(self.ids) > self.most_ids:
            self.clear()
        for chunk in set(flat).difference(self.numbers):
            self.add(chunk)
        stops, ids = np.array(self.stops), np.array(self.ids, np.int32)
        own = np.fromiter(map(self.numbers.__getitem__, flat), np.int64, len(flat))
        first, size = stops[own], stops[own + 1] - stops[own]
        at = np.concatenate(([0], np.cumsum(size)))
        out = ids[np.repeat(first - at[:-1], size) + np.arange(at[-1])]
        ends = at[np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()))


@lru_cache(maxsize=2)
def chunk_table(path: str, entries: int) -> ChunkTable:
    """The worker's table, kept from task to task."""
    return ChunkTable(codec(path), entries)


@lru_cache(maxsize=4)
def labels(path: str) -> pa.Array:
    """The label of each id of a vocabulary file; null where an id is free."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    known = {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
    return pa.array([known.get(i) for i in range(max(known, default=-1) + 1)], pa.string())


def decode_ids(ids: pa.ListArray, known: pa.Array) -> pa.Array:
    """Labels joined by blanks, as a file without decoder has it. Unknown and null ids are
    left out; null lists give an empty text."""
    flat = ids.flatten()
    at = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)))
    inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(known))).fill_null(False)
    if not pc.all(inside).as_py():
        flat = pc.if_else(inside, flat, None)
    found = known.take(flat)
    if found.null_count:
        there = found.is_valid()
        at = np.concatenate(([0], np.cumsum(there.to_numpy(zero_copy_only=False), dtype=np.int64)))[at]
        found = found.filter(there)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), found), " ")


@lru_cache(maxsize=4)
def codec(path: str) -> WordCodec:
    made = WordCodec(path)
    release()  # compiling takes four times the memory of what it makes
    return made


def encode(docs: DataFrame, path: str, *, keep: list[str], text_col: str = "text", decoded_col: str | None = None, cache_entries: int = 200_000) -> DataFrame:
    """The columns ``keep`` with ``ids array<int>`` and, if a name for it is given, what the
    ids decode to. Whole texts; null counts as empty and gives no ids. White space only parts
    chunks, so chunks between it are encoded on their own and kept in a bounded cache of the
    worker. ``path`` must exist on every executor."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(x) for x, c in zip(names, keep, strict=True)), F.col(text_col).alias("text"))
    made = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *([T.StructField("decoded", T.StringType())] if decoded_col else [])]
    schema = T.StructType([*rows.schema.fields[:-1], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(path, cache_entries)
        for batch in slices(batches, "text", 2 << 20):
            ids = table.encode([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), ids, *([decode_ids(ids, labels(path))] if decoded_col else [])], schema.names)

    out = in_arrow(rows, run, schema)
    return out.select(*(F.col(x).alias(c) for x, c in zip(names, keep, strict=True)), "ids", *([F.col("decoded").alias(decoded_col)] if decoded_col else []))


def decode(encoded: DataFrame, path: str, *, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns ``keep`` with ``text``, decoded from ``ids_col``; null ids give an empty
    text."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = encoded.select(*(F.col(c).alias(x) for x, c in zip(names, keep, strict=True)), F.col(ids_col).alias("ids"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = labels(path)
        for batch in batches:
            size = np.cumsum(pc.list_value_length(batch.column("ids")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            start = 0
            while start < batch.num_rows:  # a million ids at a time, or one row
                stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + (1 << 20), "right")))
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), decode_ids(part.column("ids"), known)], [*names, "text"])
                start = stop

    return in_arrow(rows, run, schema).select(*(F.col(x).alias(c) for x, c in zip(names, keep, strict=True)), "text")
