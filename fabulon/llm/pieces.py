"""Operator 7: SentencePiece encoding and decoding for merge-type vocabularies.

A chunk of text starts as single characters. An agenda holds the adjacent pairs whose
concatenation is a piece, the best score first and of equal scores the leftmost; the head is
merged if both its symbols are still there, and the pairs the new symbol makes with its
neighbours join the agenda. Symbols that are no piece at the end fall back to bytes.

No piece runs across certain places, so a text may be cut there: before a white space mark that
follows another character, around a line break, and between a letter or digit and a punctuation
mark. All are read off the vocabulary, not assumed: a cut is made only where no piece holds the
two characters side by side. Chunks repeat, so a process keeps the ids of those
it has seen; each new one is checked against the sentencepiece library, a batch at a time.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from functools import lru_cache
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabulon.llm.common import Stretches, joined_bytes, slices

SPACE = "▁"
#: Chunks that a process keeps before it starts anew.
CACHE = 400_000
#: Tokens decoded at once (a longer text is whole all the same).
TOKENS = 1 << 18
#: Bytes of text encoded at once.
SLICE = 2 << 20
#: Chunks of so many characters have their agenda in a list, longer ones in a heap.
SHORT = 48
_NEVER = float("inf")
#: Marks at which chunks may be cut if the vocabulary allows.
MARKS = ".,;:!?%$#&*|\")]}(["

# A byte that is no part of UTF-8 reads as one U+FFFD, each by itself.
codecs.register_error("each_byte", lambda e: ("\ufffd", e.start + 1))


class Pieces:
    """A merge vocabulary, read through the sentencepiece library from a model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.names = [lib.id_to_piece(i) for i in range(n)]
        self.unknown = lib.unk_id()
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(n) if lib.is_control(i)}
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.score = {self.names[i]: lib.get_score(i) for i in plain}
        self.cost = {k: -v for k, v in self.score.items()}
        if lib.encode("ﬁ①  x ", out_type=str) and "".join(lib.encode("ﬁ x", out_type=str)) != SPACE + "ﬁ" + SPACE + "x":
            raise ValueError("only vocabularies without normalisation are supported")
        self.prefix = "".join(lib.encode("x", out_type=str)).startswith(SPACE)
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.cut_before_space = all(b != SPACE or a == SPACE for a, b in pairs)
        self.lines_apart = not any("\n" in p for p in self.ids)
        letter = re.compile("[A-Za-z]")
        self.word_end = {c for c in MARKS if not any(b == c and letter.match(a) for a, b in pairs)}
        self.word_start = {c for c in MARKS if not any(a == c and letter.match(b) for a, b in pairs)}
        self.texts = pa.array([" \u2047 " if i == self.unknown else "" if i in self.silent else n.replace(SPACE, " ") for i, n in enumerate(self.names)], pa.string())
        self.numbers = pa.array(list(map(str, range(n))), pa.string())
        #: Ids whose bytes are whole characters: all but those for bytes beyond ASCII.
        self.whole = np.array([self.byte_of.get(i, 0) < 128 for i in range(n)])
        for i, b in self.byte_of.items():
            if b < 128:
                self.texts = pa.concat_arrays([self.texts[:i], pa.array([chr(b)], pa.string()), self.texts[i + 1 :]])
        self._reset()

    def _reset(self) -> None:
        """Forgets the kept chunks: hash -> number; ids of number i are flat[at[i] : at[i + 1]]."""
        self.cache: dict[int, int] = {}
        self.flat, self.at = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 14, dtype=np.int64)

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk whose spaces are marks already."""
        symbols = list(chunk)
        n = len(symbols)
        if n <= SHORT:  # the agenda is a plain list of the pairs' costs, in text order: its first least entry is the head
            cost = self.cost.get
            agenda = [cost(a + b, _NEVER) for a, b in pairwise(symbols)]
            while agenda and (head := min(agenda)) != _NEVER:
                i = agenda.index(head)
                symbols[i] = new = symbols[i] + symbols.pop(i + 1)
                del agenda[i]
                if i < len(agenda):
                    agenda[i] = cost(new + symbols[i + 1], _NEVER)
                if i:
                    agenda[i - 1] = cost(symbols[i - 1] + new, _NEVER)
            return self._finish(symbols)
        score, after, before = self.score, list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            s = score.get(symbols[i] + symbols[i + 1])
            if s is not None:
                agenda.append((-s, i, symbols[i], symbols[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, i, a, b = heapq.heappop(agenda)
            if symbols[i] != a or (j := after[i]) >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = new, _ = a + b, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                s = score.get(new + symbols[k])
                if s is not None:
                    heapq.heappush(agenda, (-s, i, new, symbols[k]))
            h = before[i]
            if h >= 0:
                s = score.get(symbols[h] + new)
                if s is not None:
                    heapq.heappush(agenda, (-s, h, symbols[h], new))
        return self._finish(symbols)

    def _finish(self, symbols: list[str | None]) -> list[int]:
        out = []
        for s in symbols:
            if s is not None:
                i = self.ids.get(s)
                if i is not None:
                    out.append(i)
                elif self.bytes:
                    out += [self.bytes[b] for b in s.encode("utf-8")]
                else:
                    out.append(self.unknown)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        return self.encode_all(pa.array([text], pa.large_string()))[0].tolist()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), one after another, and len + 1 offsets."""
        if len(self.cache) > CACHE:
            self._reset()
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.prefix:  # a text gets a mark before it unless it is empty
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)))
        data, offsets = joined_bytes(texts)
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        if len(data) and self.cut_before_space:
            marked = np.flatnonzero(pc.match_substring(texts, SPACE).to_numpy(zero_copy_only=False))
            left, right, kinds = data[:-1], data[1:], _CLASSES(self)
            free = (right == 32) & (left != 32)
            if self.lines_apart:
                free |= (right == 10) | (left == 10)
            free |= (kinds[left] & 1 > 0) & (kinds[right] & 2 > 0)
            free |= (kinds[left] & 4 > 0) & (kinds[right] & 1 > 0)
            for i in marked:  # a mark that the text itself holds joins with spaces: such a text is one chunk
                free[max(offsets[i] - 1, 0) : offsets[i + 1]] = False
            cut[1:-1] |= free
        bounds = np.flatnonzero(cut)
        if len(data) == 0:
            return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
        start, end = bounds[:-1], bounds[1:]
        kinds, first, index = np.unique(Stretches(data).of(start, end), return_index=True, return_inverse=True)
        keys, cache = kinds.tolist(), self.cache
        number = np.fromiter(map(cache.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        new = np.flatnonzero(number < 0)
        if len(new):
            self._keep(new, [keys[i] for i in new.tolist()], [data[s:e].tobytes().decode().replace(" ", SPACE) for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)], number)
        number = number[index]
        sizes = self.at[number + 1] - self.at[number]
        ends = np.cumsum(sizes)
        out = self.flat[np.repeat(self.at[number] - ends + sizes, sizes) + np.arange(ends[-1])]
        return out, np.concatenate([[0], ends])[np.searchsorted(bounds, offsets)]

    def _keep(self, new: np.ndarray, keys: list[int], chunks: list[str], number: np.ndarray) -> None:
        """Merges the new chunks, checks them against the library, and keeps them."""
        ids = [self.merge(c) for c in chunks]
        self.check(chunks, ids)
        n, sizes = len(self.cache), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        number[new] = np.arange(n, n + len(new))
        self.cache.update(zip(keys, range(n, n + len(new)), strict=True))
        used = int(self.at[n])
        total = used + int(sizes.sum())
        self.flat, self.at = _grown(self.flat, total), _grown(self.at, n + len(new) + 1)
        self.flat[used:total] = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=total - used)
        self.at[n + 1 : n + len(new) + 1] = used + np.cumsum(sizes)

    def check(self, chunks: list[str], ids: list[list[int]]) -> None:
        """Compares the ids of chunks with the library's, in one batch; raises where they differ."""
        # The library puts a mark before a text, so a chunk without one is encoded after a line break, which no piece holds.
        whole = [c[0] == SPACE and self.prefix for c in chunks]
        texts = [(c[1:] if w else "\n" + c).replace(SPACE, " ") for c, w in zip(chunks, whole, strict=True)]
        stand_in = self.library.encode("\n")
        for c, w, own, theirs in zip(chunks, whole, ids, self.library.encode(texts, num_threads=1), strict=True):
            if (own if w else stand_in + own) != theirs and c != SPACE and (w or self.lines_apart):
                raise ValueError(f"ids of {c!r} differ from the library's")

    def decode(self, ids: list[int]) -> str:
        """Text of ids as the library has it: pieces joined, marks as spaces, one leading mark dropped, byte runs read as UTF-8."""
        out, raw = [], bytearray()
        first = True
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                first = False
                continue
            if raw:
                out.append(bytes(raw).decode("utf-8", "each_byte"))
                raw.clear()
            if i in self.silent:
                continue
            name = " ⁇ " if i == self.unknown else self.names[i]
            if first and self.prefix and name.startswith(SPACE):
                name = name[1:]
            first = False
            out.append(name)
        if raw:
            out.append(bytes(raw).decode("utf-8", "each_byte"))
        return "".join(out).replace(SPACE, " ")

    def decode_all(self, flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of many id lists."""
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.texts.take(pa.array(flat)))
        out = pc.binary_join(lists, "")
        n = np.diff(offsets)
        head = flat[np.minimum(offsets[:-1], max(len(flat) - 1, 0))] if len(flat) else np.zeros(len(n), dtype=np.int32)
        marked = np.array([x.startswith(SPACE) for x in self.names])
        if self.prefix:
            out = pc.if_else(pa.array((n > 0) & marked[head]), pc.utf8_slice_codeunits(out, 1), out)
        # Bytes beyond ASCII read together with their neighbours, and control pieces before the first text: such texts one by one.
        odd = ~self.whole[flat] | np.isin(flat, list(self.silent))
        rows = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1)
        if len(rows):
            some = {int(i): self.decode(flat[offsets[i] : offsets[i + 1]].tolist()) for i in rows}
            mask = np.zeros(len(n), dtype=bool)
            mask[rows] = True
            out = pc.replace_with_mask(out, pa.array(mask), pa.array([some[i] for i in sorted(some)], out.type))
        return out


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), dtype=a.dtype)])


def _CLASSES(p: Pieces) -> np.ndarray:
    """Of each byte: 1 an ASCII letter, 2 a mark that no piece has after a letter, 4 one that none has before a letter."""
    out = np.zeros(256, dtype=np.uint8)
    for i in range(128):
        c = chr(i)
        out[i] = (c.isalpha()) + 2 * (c in p.word_end) + 4 * (c in p.word_start)
    return out


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids for each row, as the library encodes without begin and end ids.

    A null or empty text has no ids (an empty list). Whole texts are encoded; repeated rows get
    equal results; other columns are not read. model: path of the vocabulary on every executor.
    """

    def run(batches):
        p = pieces(model)
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                flat, offsets = p.encode_all(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded for each row of encode_pieces. Null ids decode as none."""

    def run(batches):
        p = pieces(model)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // TOKENS
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
            for a, z in pairwise(cuts):
                b = batch.slice(a, z - a)
                ids = b.column("ids").cast(pa.list_(pa.int32())).fill_null([])
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), p.numbers.take(pa.array(flat)))
                digests = [hashlib.sha256(x.as_buffer()).hexdigest() for x in pc.binary_join(lists, ",")]
                arrays = [b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(digests, pa.string()), p.decode_all(flat, offsets).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded string")
