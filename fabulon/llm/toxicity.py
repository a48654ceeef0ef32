"""Operator 9: convolutional text classifier for toxicity.

Words are hashed (whole word, two prefixes, one suffix) into rows of an embedding table; filters
of several widths run over the word vectors, the maximum of each over the text goes through a
logistic layer. Trained in numpy with Adam on all labelled rows, in one task that holds a chunk of them. The
score of a text comes from its words alone; thresholds for flagging are calibrated for each language
on a fifth of the rows that the model was not fitted on.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabulon.llm.common import Rolling, held_out, joined_bytes, judged, spread_key

BUCKETS = 1 << 16
PARTS = 4
WIDTHS = (1, 2, 3)
FILTERS = 6
DIM = 6
#: Hashes in fewer training texts stay without a vector.
MIN_TEXTS = 3
#: Texts and characters that are trained on together, and how often tables of one chunk are gone through.
CHUNK_ROWS, CHUNK_CHARS, EPOCHS = 4000, 16 << 20, 24
#: At most 2 ** BITMAP bits tell rows that may have a label from those that have none.
BITMAP = 26


_WORD = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])


def indexed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows of the words of all texts; starts and ends of the texts, at least one position each.

    Words are runs of letters and digits in lower case. Pads follow every text, so that no
    window reaches the next.
    """
    data, offsets = joined_bytes(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True  # a word ends where its text does
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    hashes = Rolling(data)
    parts = [hashes.of(start, end), hashes.of(start, np.minimum(start + 5, end)), hashes.of(start, np.minimum(start + 4, end)), hashes.of(np.maximum(end - 5, start), end)]
    rows = np.stack([(p + np.uint64(i)) % np.uint64(BUCKETS) for i, p in enumerate(parts)], axis=1).astype(np.int32)
    pads = max(WIDTHS) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    out = np.full((len(start) + pads * len(texts), PARTS), BUCKETS, dtype=np.int32)
    out[np.arange(len(start)) + pads * text] = rows
    ends = np.cumsum(np.bincount(text, minlength=len(texts))) + pads * np.arange(1, len(texts) + 1) - pads + 1
    return out, np.concatenate([[0], ends[:-1] + pads - 1]), ends


@dataclass
class Model:
    """Parameters; the last row of the table is the pad's and stays zero."""

    table: np.ndarray
    filters: list[np.ndarray]  # width x DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        table = np.zeros((BUCKETS + 1, DIM), dtype=np.float32)
        table[:-1] = r.normal(0, 0.01, (BUCKETS, DIM))
        return Model(table, [r.normal(0, (2 / (DIM * w)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS], np.abs(r.normal(0.5, 0.1, FILTERS * len(WIDTHS))).astype(np.float32), -1.0)

    def answers(self, rows: np.ndarray) -> list[np.ndarray]:
        """What each filter says at each position, FILTERS x positions for each width, before the bias."""
        vectors = self.table[rows[:, 0]]
        for k in range(1, PARTS):
            vectors += self.table[rows[:, k]]
        each = np.concatenate([f[k] for f in self.filters for k in range(len(f))], axis=1).T @ vectors.T
        out, at = [], 0
        for w in WIDTHS:
            answer = each[at : at + FILTERS]
            for k in range(1, w):
                answer[:, :-k] += each[at + k * FILTERS : at + (k + 1) * FILTERS, k:]
            out.append(answer)
            at += w * FILTERS
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        if len(texts) == 0:
            return np.zeros(0)
        rows, starts, ends = indexed(texts)
        cuts = np.stack([starts, ends], axis=1).ravel()
        top = [np.maximum.reduceat(a, cuts, axis=1)[:, ::2] + b[:, None] for a, b in zip(self.answers(rows), self.bias, strict=True)]
        hidden = np.maximum(np.concatenate(top), 0)
        return 1 / (1 + np.exp(-np.clip(self.out @ hidden + self.out_bias, -30, 30).astype(np.float64)))


class Trainer:
    """Fits a model by Adam to the weighted logistic loss, chunk after chunk of texts; only winning windows get a gradient."""

    def __init__(self, batch: int = 32, rate: float = 0.02, decay: float = 1e-4, seed: int = 7):
        self.model, self.random = Model.fresh(seed), np.random.default_rng(seed)
        self.batch, self.rate, self.decay = batch, rate, decay
        params = [*self.model.filters, *self.model.bias, self.model.out]
        self.m1, self.m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        self.t1, self.t2 = np.zeros_like(self.model.table), np.zeros_like(self.model.table)
        self.b1 = self.b2 = 0.0
        self.step = 0
        self.seen = np.zeros(BUCKETS + 1, dtype=np.int64)

    def learn(self, texts: list[str], labels: np.ndarray, weights: np.ndarray, epochs: int) -> None:
        """Takes so many epochs over these texts. Hashes in few of all texts so far stay out."""
        prepared = [indexed(pa.array([t]))[0] for t in texts]
        for p in prepared:
            self.seen[np.unique(p)] += 1
        rare = self.seen < MIN_TEXTS
        prepared = [np.where(rare[p], BUCKETS, p) for p in prepared]
        self.model.table[BUCKETS] = 0
        for _ in range(epochs):
            order = self.random.permutation(len(texts))
            for at in range(0, len(order), self.batch):
                pick = order[at : at + self.batch]
                parts = [prepared[i] for i in pick]
                sizes = np.array([len(p) for p in parts])
                starts, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes) - max(WIDTHS)
                rows = np.concatenate(parts)
                tops, where = [], []
                for a, b in zip(self.model.answers(rows), self.model.bias, strict=True):
                    best = np.stack([a[:, s:e].argmax(axis=1) + s for s, e in zip(starts, ends, strict=True)])
                    where.append(best)
                    tops.append(a[np.arange(FILTERS), best] + b)
                raw = np.concatenate(tops, axis=1)
                hidden = np.maximum(raw, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ self.model.out + self.model.out_bias, -30, 30)))
                g = ((p - labels[pick]) * weights[pick] / len(pick)).astype(np.float32)
                g_out, g_b = hidden.T @ g, float(g.sum())
                g_hidden = np.where(raw > 0, g[:, None] * self.model.out, 0.0).astype(np.float32)
                g_filters, g_bias, won, pushed = [], [], [], []
                for i, (w, f) in enumerate(zip(WIDTHS, self.model.filters, strict=True)):
                    gh = g_hidden[:, i * FILTERS : (i + 1) * FILTERS]
                    gf = np.zeros_like(f)
                    for k in range(w):
                        own = rows[where[i] + k]  # texts x filters x parts
                        gf[k] = np.einsum("tfd,tf->df", self.model.table[own].sum(axis=2), gh)
                        won.append(own.reshape(-1, PARTS))
                        pushed.append((gh[:, :, None] * f[k].T[None]).reshape(-1, DIM))
                    g_filters.append(gf)
                    g_bias.append(gh.sum(axis=0))
                self.step += 1
                fix1, fix2 = 1 - 0.9**self.step, 1 - 0.999**self.step
                for q, gq, a, c in zip([*self.model.filters, *self.model.bias, self.model.out], [*g_filters, *g_bias, g_out], self.m1, self.m2, strict=True):
                    gq = gq + self.decay * q
                    a += 0.1 * (gq - a)
                    c += 0.001 * (gq * gq - c)
                    q -= self.rate * (a / fix1) / (np.sqrt(c / fix2) + 1e-8)
                self.b1 += 0.1 * (g_b - self.b1)
                self.b2 += 0.001 * (g_b * g_b - self.b2)
                self.model.out_bias -= self.rate * (self.b1 / fix1) / ((self.b2 / fix2) ** 0.5 + 1e-8)
                won, pushed = np.concatenate(won), np.concatenate(pushed)
                touched, back = np.unique(won.ravel(), return_inverse=True)
                gt = np.zeros((len(touched), DIM), dtype=np.float32)
                np.add.at(gt, back, np.repeat(pushed, PARTS, axis=0))
                gt += self.decay * self.model.table[touched]
                self.t1[touched] += 0.1 * (gt - self.t1[touched])
                self.t2[touched] += 0.001 * (gt * gt - self.t2[touched])
                self.model.table[touched] -= self.rate * (self.t1[touched] / fix1) / (np.sqrt(self.t2[touched] / fix2) + 1e-8)
                self.model.table[BUCKETS] = 0

    def done(self) -> Model:
        self.model.table[self.seen < MIN_TEXTS] = 0  # what few texts have says more about these texts than about the label
        return self.model


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, epochs: int = 24, seed: int = 7) -> Model:
    trainer = Trainer(seed=seed)
    trainer.learn(texts, labels, weights, epochs)
    return trainer.done()


def calibrated(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold with the best F1, midway to the next score below, kept within 0.25 to 0.75; 0.5 without both labels."""
    if len(set(labels.tolist())) < 2:
        return 0.5
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    best = int(f1.argmax())
    return float(np.clip((s[best] + (s[best + 1] if best + 1 < len(s) else 0)) / 2, 0.25, 0.75))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", label_col: str = "toxic") -> DataFrame:
    """text, y, lang of at most `limit` rows for each label, those with the least hash of their id; held-out rows never."""
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    y = y.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    # Only labels of documents that are there count. Each task keeps its `limit` least hashes before any row moves.
    y = docs.select(F.col(id_col).alias("id")).join(y, "id").dropDuplicates(["id"]).withColumn("_h", spread_key("id"))
    each = [y.filter(F.col("y") == k).orderBy("_h", "id").limit(limit) for k in (0, 1)]
    picked = each[0].unionByName(each[1]).select("id", "y")
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), lang.alias("lang")).join(F.broadcast(picked), "id").groupBy("id").agg(F.min(F.struct("text", "lang")).alias("s"), F.min("y").alias("y")).select("s.text", "y", "s.lang")


def fit(rows: list[tuple], seed: int = 7, most_bytes: int = 64 << 20) -> Model | None:
    """A model of (text, label, lang) rows, of which a fifth serves the thresholds alone; None if the rows don't hold both labels.

    Rows are taken in the order of a hash of their texts until they have most_bytes together.
    """
    rows = sorted(rows, key=lambda r: (zlib.crc32(r[0].encode()), r[0], r[1], r[2] or ""))
    total = np.cumsum([len(r[0].encode()) for r in rows])
    rows = rows[: max(2, int(np.searchsorted(total, most_bytes, side="right")))]
    aside = [zlib.crc32(b"aside" + r[0].encode()) % 5 == 0 for r in rows]
    fitted = [r for r, x in zip(rows, aside, strict=True) if not x]
    if len({r[1] for r in fitted}) < 2:
        fitted = rows
    if len({r[1] for r in fitted}) < 2:
        return None
    y = np.array([r[1] for r in fitted], dtype=np.float32)
    w = np.where(y == 1, (1 - y).sum() / y.sum(), 1.0).astype(np.float32)  # as if both labels were as many
    model = train([r[0] for r in fitted], y, w / w.mean(), seed=seed)
    others = [r for r, x in zip(rows, aside, strict=True) if x]
    if others:
        scores = np.concatenate([model.scores(pa.array([r[0] for r in others[i : i + 100]])) for i in range(0, len(others), 100)])
        for lang in sorted({r[2] for r in others if r[2] is not None}):
            own = np.array([r[2] == lang for r in others])
            model.thresholds[lang] = calibrated(scores[own], np.array([r[1] for r in others])[own])
    return model


def open_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """id, text, lang, aside of every row of docs that has an id and is not held out; aside, made of the text, is there before rows meet labels, so that no text need move for it."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), lang.alias("lang")).filter(F.col("id").isNotNull() & ~held_out(F.col("id")))
    return rows.withColumn("aside", F.crc32(F.concat(F.lit("aside"), F.col("text")).cast("binary")) % 5 == 0)


def known_labels(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str = "toxic") -> DataFrame:
    """id, in the type that docs has it in, and y of each id that has a label, held-out ones never."""
    y = labels.select(F.col(id_col).try_cast(docs.select(id_col).schema[0].dataType).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    return y.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", label_col: str = "toxic") -> DataFrame:
    """id, text, lang, aside, y of every row of docs with a label, held-out rows never; aside: it serves the thresholds alone."""
    return open_rows(docs, id_col, text_col, lang_col).join(known_labels(docs, labels, id_col, label_col), "id")


def likely(rows: DataFrame, y: DataFrame, total: int) -> DataFrame:
    """The rows whose id is in y, and a few others: a bitmap of the ids' hashes, 8 MB at most, is sent to where the rows are.

    What it lets through still has to meet y; it is there so that rows without a label need not move for that.
    The more ids there are to its bits, the more others pass; never is a row of y lost.
    """
    bits = 1 << min(max((16 * total).bit_length(), 15), BITMAP)
    at = spread_key("id").bitwiseAND(F.lit(bits - 1))
    maps = y.select(at.alias("_v")).groupBy(F.shiftright("_v", 15).alias("_part")).agg(F.bitmap_construct_agg(F.col("_v") % (1 << 15)).alias("_map"))
    place = F.col("_v") % (1 << 15)
    byte = F.conv(F.hex(F.substring("_map", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_v", at).withColumn("_part", F.shiftright("_v", 15)).join(F.broadcast(maps), "_part")
    return found.filter(F.getbit(byte, (place % 8).cast("int")) == 1).select(*rows.columns)


def in_order(rows: DataFrame, y: DataFrame, total: int, parts: int) -> DataFrame:
    """text, y of the rows whose id is in y, in `parts` parts, each in the order of a hash of the ids. Texts of these rows move, once, whatever the tables' sizes."""
    rows = likely(rows, y, total).withColumn("_h", spread_key("id")).select("_h", "id", "text")
    dealt = rows.repartition(parts, "_h", "id").sortWithinPartitions("_h", "id", "text")
    return dealt.join(y.withColumn("_h", spread_key("id")).repartition(parts, "_h", "id").hint("merge"), ["_h", "id"]).select("text", "y")


def thresholds(scored: DataFrame) -> dict[str, float]:
    """What `calibrated` gives for each lang of (lang, score, y), from all rows; of these a row for each language comes to the driver."""
    each = scored.groupBy("lang", "score").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    down, whole = Window.partitionBy("lang").orderBy(F.col("score").desc()), Window.partitionBy("lang")
    each = each.withColumn("below", F.coalesce(F.lead("score").over(down), F.lit(0.0))).withColumn("all_y", F.sum("y").over(whole)).withColumn("all_n", F.sum("n").over(whole))
    each = each.withColumn("f1", 2 * F.sum("y").over(down) / (F.sum("n").over(down) + F.col("all_y")))
    best = each.groupBy("lang", "all_y", "all_n").agg(F.max_by(((F.col("score") + F.col("below")) / 2), F.struct("f1", "score")).alias("t"))
    return {r.lang: min(max(r.t, 0.25), 0.75) if 0 < r.all_y < r.all_n else 0.5 for r in best.collect()}


def fitted_on_all(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> bytes:
    """The model of every labelled row, pickled; None in it where there are not both labels.

    One task takes the rows as they come, in the order of a hash of their ids, a chunk at a time; small tables are gone through up to
    EPOCHS times. The thresholds come from scores of all rows that were put aside, made in many tasks, where the texts are.
    """
    rows, known = open_rows(docs, id_col, text_col, lang_col), known_labels(docs, labels, id_col)
    counts = {(r.aside, r.y): r["count"] for r in labelled(docs, labels, id_col, text_col, lang_col).groupBy("aside", "y").count().collect()}
    own = [counts.get((False, y), 0) for y in (0, 1)]
    fitting = rows.filter("not aside")
    if not all(own):
        own, fitting = [counts.get((False, y), 0) + counts.get((True, y), 0) for y in (0, 1)], rows
    if not all(own):
        return pickle.dumps(None)
    total = sum(own)
    weights = np.array([total / (2 * own[0]), total / (2 * own[1])], dtype=np.float32)  # as if both labels were as many
    epochs = int(np.clip(EPOCHS * CHUNK_ROWS // total, 1, EPOCHS))

    def run(batches):
        trainer, texts, y, size = Trainer(), [], [], 0

        def learn():
            if texts:
                own = np.array(y, dtype=np.float32)
                trainer.learn(texts, own, weights[own.astype(int)], epochs)
            texts.clear(), y.clear()

        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                texts.append(text)
                y.append(label)
                size += len(text)
                if len(texts) >= CHUNK_ROWS or size >= CHUNK_CHARS:
                    learn()
                    size = 0
        learn()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trainer.done())], pa.binary())], names=["model"])

    every = sum(counts.values())
    dealt = in_order(fitting, known, every, -(-total // CHUNK_ROWS))
    model = pickle.loads(dealt.coalesce(1).mapInArrow(run, "model binary").collect()[0].model)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # BUCKETS * DIM floats and a few filters

    def judge():
        model = pickle.loads(sent.value)
        return lambda own: pa.array(model.scores(own))

    scored = likely(rows.filter("aside and lang is not null"), known, every).select("id", "lang", judged(F.col("text"), judge, "double").alias("score"))
    model.thresholds = thresholds(scored.join(known, "id"))
    return pickle.dumps(model)


def fitted_model(sample: DataFrame) -> bytes:
    """The model of the rows of training_rows, pickled. It is fitted in one task, which an executor that is lost costs again, not on the driver."""

    def run(batches):
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("text", "y", "lang")), strict=True)]
        packed = pickle.dumps(fit(rows))
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["model"])

    got = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return got[0].model if got else pickle.dumps(None)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", limit: int | None = None, train_docs: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), threshold and flagged (score over the language's threshold) (and the columns named in carry) for each row.

    Fits on all labelled rows of train_docs (docs by default), never on held-out rows; where a caller names
    a limit, on at most so many for each label and 64 MB of text. A null or empty text is scored as one without words. Where
    labels are missing or of one kind, every score is 0. A null or unseen language has threshold
    0.5. Repeated rows get equal results; whole texts are scored. Columns not named are not read,
    and an empty table gives an empty result.
    """
    known_docs = docs if train_docs is None else train_docs
    packed = fitted_on_all(known_docs, labels, id_col, text_col, lang_col) if limit is None else fitted_model(training_rows(known_docs, labels, limit, id_col, text_col, lang_col))
    sent = docs.sparkSession.sparkContext.broadcast(packed)  # BUCKETS * DIM floats and a few filters, whatever the corpus
    model = pickle.loads(packed)
    known = {} if model is None else model.thresholds

    def judge():
        model = pickle.loads(sent.value)
        return lambda own: pa.array(np.zeros(len(own)) if model is None else model.scores(own))

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    limits = F.create_map(*[F.lit(x) for k, v in sorted(known.items()) for x in (k, v)]) if known else None
    threshold = F.lit(0.5) if limits is None else F.coalesce(F.try_element_at(limits, lang), F.lit(0.5))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), judged(F.col(text_col), judge, "double").alias("score"), threshold.alias("threshold"), *[F.col(c).alias(f"_{c}") for c in carry])
    return out.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.greatest("threshold", F.lit(1e-9))).alias("flagged"),
        *[F.col(f"_{c}").alias(c) for c in carry],
    )
