"""Operator 10: language by cross-parsing entropy.

Training text of each language becomes a suffix automaton. A text is parsed against it into the
longest phrases that occur in the training text (Ziv and Merhav); phrases * log2(training
length) / text length estimates the bits a letter needs under that language. The language with
the fewest normalised phrases wins.

Parsing runs in numpy over many blocks at once: a text is cut into blocks of BLOCK letters, and each
step moves every block under every language one letter on. A block is first parsed as if a phrase
began with it; then once more from the state in which the block before it ended, until both
parses are in one state, from where on they agree. So phrases run across blocks, and the counts are
those of one pass over the whole text.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulon.llm.common import held_out, judged, spread_key

BLOCK = 1024
NONE = "und"
#: Entries of one language's table of states and letters, eight bytes each.
DENSE = 1 << 23
#: Bits of a place in the tables: 30 in four-byte tables, 40 in eight-byte ones, which larger models get.
_BITS = {np.dtype(np.int32): 30, np.dtype(np.int64): 40}


def letters(text: str) -> str:
    """Lower-case letters of a text, with one space for each run of others."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class Automata:
    """Suffix automata, one for each language, as arrays; each language has an alphabet of its own.

    A state is the place of its row in the array: next[state + letter] is the state after a letter;
    where the current phrase can't go on the entry is the state after starting a new phrase with that
    letter, plus `turn`. A letter that the language's training text lacks is a phrase of its own: it
    is class 0 and leads to a last state that any letter leaves by a new phrase. A language whose
    table would have more than DENSE entries keeps its edges sorted instead.
    """

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        alphabet = sorted(set("".join(texts.values())))
        self.classes = np.zeros(0x110000, dtype=np.uint16 if len(alphabet) < 65535 else np.uint32)
        self.classes[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        letter = np.zeros((len(self.langs), len(alphabet) + 1), dtype=np.int64)  # of each language: class to its own letter number
        roots = np.zeros(len(self.langs), dtype=np.int64)
        self.sparse: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        states = sum(2 * len(t) * (len(set(t)) + 1) for t in texts.values())
        self.kind = np.dtype(np.int32 if states < 1 << 30 else np.int64)
        self.bit = _BITS[self.kind]
        self.turn = self.kind.type(1 << self.bit)
        tables, base = [], 0
        for i, lang in enumerate(self.langs):
            own = sorted(set(texts[lang]))
            letter[i, self.classes[[ord(c) for c in own]]] = np.arange(1, len(own) + 1)
            width = len(own) + 1
            edges = self._build([int(letter[i, self.classes[ord(c)]]) for c in texts[lang]])
            at = [(s * width, c, t * width) for s, e in enumerate(edges) for c, t in e.items()]
            s, c, t = np.array(at, dtype=np.int64).reshape(-1, 3).T
            root = np.full(width, len(edges) * width, dtype=np.int64)
            root[list(edges[0])] = [x * width for x in edges[0].values()]
            if (len(edges) + 1) * width > DENSE:
                order = np.argsort(s + c)
                self.sparse[i] = (s + c)[order], t[order], root
                continue
            table = np.tile((root + base + int(self.turn)).astype(self.kind), len(edges) + 1)
            table[:width] = root + base
            table[s + c] = t + base
            tables.append(table)
            roots[i] = base
            base += len(table)
        self.letter, self.roots = letter.astype(self.kind), roots.astype(self.kind)
        self.next = np.concatenate(tables) if tables else np.zeros(0, dtype=self.kind)
        self.dense = np.array([i for i in range(len(self.langs)) if i not in self.sparse], dtype=np.int64)
        self.bits = np.array([np.log2(max(2, len(texts[x]))) for x in self.langs])

    def step(self, state: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The state of each language (row) and block (column) after a letter, plus turn where it begins a phrase."""
        if not self.sparse:
            return self.next.take(state + self.letter[:, classes])
        out = np.empty_like(state)
        out[self.dense] = self.next.take(state[self.dense] + self.letter[self.dense][:, classes])
        for i, (keys, to, root) in self.sparse.items():
            own = self.letter[i, classes]
            want = state[i] + own
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            new = root[own] + np.where(state[i] == 0, 0, self.turn)
            out[i] = np.where((keys[at] == want) & (own > 0), to[at], new)
        return out

    @staticmethod
    def _build(text: list[int]) -> list[dict[int, int]]:
        """The suffix automaton: edges of each state."""
        edges, link, length, last = [{}], [-1], [0], 0
        for c in text:
            new = len(edges)
            edges.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(edges)
                    edges.append(dict(edges[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        return edges

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letter classes of all texts, one after another (a space for each run of non-letters), and the number of each text's."""
        raw = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
        sizes = np.array([len(r) for r in raw])
        all_ = np.concatenate([*raw, np.zeros(0, dtype=np.uint32)])
        is_letter = _letters()[all_]
        owner = np.repeat(np.arange(len(texts)), sizes)
        # A non-letter stays, as a space, if a letter of the same text comes right before it and another letter later.
        before = np.zeros(len(all_), dtype=bool)
        if len(all_) > 1:
            before[1:] = is_letter[:-1] & (owner[1:] == owner[:-1])
        last = np.full(len(texts), -1)
        at = np.flatnonzero(is_letter)
        last[owner[at]] = at  # the last write of a text stands
        keep = is_letter | (before & (np.arange(len(all_)) < last[owner]))
        out = self.classes[np.where(is_letter, all_, 32)][keep]
        return out, np.bincount(owner[keep], minlength=len(texts))

    def phrases(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each text under each language."""
        n, langs = len(sizes), len(self.langs)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(n), blocks)
        first = np.cumsum(blocks) - blocks
        at = starts[owner] + (np.arange(len(owner)) - first[owner]) * BLOCK
        length = np.minimum(BLOCK, starts[owner + 1] - at)
        head = at == starts[owner]
        # Each block by itself, the longest first, so that those that still go on are the first ones.
        order = np.argsort(-length, kind="stable")
        active = np.searchsorted(-length[order], -np.arange(1, BLOCK + 1), side="right")
        state = np.repeat(self.roots[:, None], len(owner), axis=1)
        count = np.zeros((langs, len(owner)), dtype=np.int64)
        for i in range(int(length[order[0]]) if len(order) else 0):
            k = active[i]
            moved = self.step(state[:, :k], codes[at[order[:k]] + i])
            count[:, :k] += moved >> self.bit
            state[:, :k] = moved & (self.turn - 1)
        own_end, own_count = np.empty_like(state), np.empty_like(count)
        own_end[:, order], own_count[:, order] = state, count
        end, count = own_end.copy(), own_count + head  # the phrase that a text begins with
        # Again from where the block before really ended: all but the first blocks, then those after a block whose end that changed.
        todo = np.flatnonzero(~head)
        while len(todo):
            true, alone = end[:, todo - 1], np.repeat(self.roots[:, None], len(todo), axis=1)
            more, live, cols = np.zeros((langs, len(todo)), dtype=np.int64), np.arange(len(todo)), todo
            last = own_end[:, todo]
            for i in range(BLOCK):
                going = (length[cols] > i) & (true != alone).any(axis=0)
                if not going.all():
                    ended = live[(length[cols] <= i) & (true != alone).any(axis=0)]
                    last[:, ended] = true[:, np.isin(live, ended)]
                    live, cols, true, alone = live[going], cols[going], true[:, going], alone[:, going]
                    if len(live) == 0:
                        break
                letter = codes[at[cols] + i]
                a, b = self.step(true, letter), self.step(alone, letter)
                more[:, live] += (a >> self.bit) - (b >> self.bit)
                true, alone = a & (self.turn - 1), b & (self.turn - 1)
            else:
                last[:, live] = np.where(true != alone, true, last[:, live])
            count[:, todo] = own_count[:, todo] + more
            changed = (end[:, todo] != last).any(axis=0)
            end[:, todo] = last
            todo = todo[changed] + 1
            todo = todo[todo < len(owner)]
            todo = todo[~head[todo]]
        out = np.zeros((n, langs))
        for i in range(langs):
            out[:, i] = np.bincount(owner, weights=count[i], minlength=n)
        return out

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and how sure it is: the weight of the winner under softmax of total bits, at 32 letters at most."""
        if not self.langs:
            return [NONE] * len(texts), [0.0] * len(texts)
        codes, sizes = self.codes([t or "" for t in texts])
        found = self.phrases(codes, sizes)
        rate = found * self.bits / np.maximum(sizes, 1)[:, None]
        best = rate.argmin(axis=1)
        gap = (rate - rate.min(axis=1, keepdims=True)) * np.minimum(sizes, 32)[:, None]
        sure = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
        langs = [self.langs[b] if s else NONE for b, s in zip(best, sizes, strict=True)]
        return langs, [float(x) if s else 0.0 for x, s in zip(sure, sizes, strict=True)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


@lru_cache(maxsize=1)
def automata(texts: tuple[tuple[str, str], ...]) -> Automata:
    """Built once in each Python process."""
    return Automata(dict(texts))


def training_texts(docs: DataFrame, rows: int, chars: int, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", allowed: Column | None = None) -> tuple[tuple[str, str], ...]:
    """Letters of a bounded sample for each language: the `rows` rows with the least hash of their id, to `chars` letters in all."""
    ok = (~held_out(F.col(id_col)) if allowed is None else allowed) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    order = Window.partitionBy("lang").orderBy("_h", "id")
    picked = docs.filter(ok).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), spread_key(F.col(id_col)).alias("_h"))
    # The limit by rank is applied in each task before rows move, so a language with most of the rows moves no more than others.
    picked = picked.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= rows).drop("_r")
    # Twice as many characters of a text as are kept of all; ids that repeat count once.
    texts = docs.filter(ok).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.substring(F.col(text_col), 1, 2 * chars).alias("text"))
    got = texts.join(F.broadcast(picked.distinct()), ["lang", "id"]).groupBy("lang", "_h", "id").agg(F.min("text").alias("text")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r.lang, r._h, r.id, r.text)):
        out.setdefault(r.lang, []).append(letters(r.text))
    joined = {k: " ".join(v)[:chars] for k, v in out.items()}
    return tuple((k, v) for k, v in sorted(joined.items()) if v)


def identify(docs: DataFrame, train: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 64, chars: int = 40_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score (and the columns named in carry) for each row of docs.

    Learns from at most `rows` rows and `chars` letters for each value of lang_col in `train`
    (docs itself by default), never from held-out rows. A text that is null or has no letter is
    `und` with score 0, as is every text where nothing can be learned. Ties go to the first
    language by name. Repeated rows get equal results; whole texts are parsed. Columns not named
    are not read, and an empty table gives an empty result.
    """
    texts = training_texts(docs if train is None else train, rows, chars, lang_col, id_col, text_col)

    def judge():
        model = automata(texts)

        def run(own: pa.Array) -> pa.Array:
            langs, scores = model.classify(own.to_pylist())
            return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

        return run

    found = judged(F.col(text_col), judge, "lang_pred string, score double")
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), found.alias("_found"), *[F.col(c).alias(f"_{c}") for c in carry])
    return out.select("doc_id", "held_out", "_found.lang_pred", "_found.score", *[F.col(f"_{c}").alias(c) for c in carry])
