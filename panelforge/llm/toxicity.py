"""Toxicity: class-conditional Kneser-Ney models of byte sequences, compared per byte of text.

Each class, toxic and ordinary, has interpolated Kneser-Ney models over bytes (A-Z as a-z, ASCII marks and digits as
spaces, UTF-8 bytes as they are): one of order four that runs across words, and one of order seven within words, that starts
anew at each word, so stems of rare and inflected expressions count. A class's own counts, less a discount, are
interpolated with the shared Kneser-Ney model of both classes (same order, backed off through shared
continuation counts), so what is rare in both classes scores alike.

A text's difference of log-likelihoods is divided by its length; so is that of each of its windows
of WINDOW bytes (half overlapping, over the whole text). A logistic function of both models' values for the text and
their two highest windows that do not overlap, fitted on labelled rows that the counts have not seen,
gives the score. Labels, lang, source and doc_id are no inputs.

Labels are learnt from at most max_labelled rows, those of least MD5 of the id (a third of them
toxic at most), one row of each doc_id (of several texts that of least hash); counts of sequences are made on the executors
and bounded by that sample. All texts are scored in one scan without a shuffle.

Defined cases: null and empty texts are scored by their constant inputs; very long texts are scored whole, in steps of whole texts;
of equal windows the first is the highest; labels of one doc_id are averaged
and count as 1 from 0.5 on; null labels are ignored; with one class only, or none, the score is the
smoothed share of toxic rows (0.5 if none); repeated rows are scored alike; other columns, of any name, are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_steps, written
from .quality_fm import remainder

ORDER, WORD_ORDER, WINDOW, MAX_LABELLED = 4, 7, 16, 6000
#: What a class's own count loses to the shared model.
DISCOUNT = 2
_SLOT_BITS = 22
_FOLD = np.array([b if b >= 128 or chr(b).islower() else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def sequences(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """At each byte of a step: it and the ORDER - 1 before it, as one number; spaces stand before a text."""
    pad = ORDER - 1
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    at = np.arange(len(data)) + pad * (doc + 1)
    padded = np.full(len(data) + pad * n, 32, np.uint64)
    padded[at] = _FOLD[data]
    out = np.zeros(len(data), np.uint64)
    for back in range(pad, -1, -1):
        out = (out << np.uint64(8)) | padded[at - back]
    return out


def sequences_in_words(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """At each byte of a word: it and the WORD_ORDER - 1 before it, as if the word stood alone; 0 at spaces."""
    n = len(data)
    folded, at = _FOLD[data].astype(np.uint64), np.arange(n)
    space = folded == 32
    begins = np.zeros(n, bool)
    begins[off[:-1][off[:-1] < n]] = True
    begins[1:] |= space[:-1]
    start = np.maximum.accumulate(np.where(begins, at, 0))
    out = np.zeros(n, np.uint64)
    for back in range(WORD_ORDER - 1, -1, -1):
        out = (out << np.uint64(8)) | np.where(at - back >= start, folded[np.maximum(at - back, 0)], np.uint64(32))
    return np.where(space, np.uint64(0), out)


@dataclass
class Table:
    """One order's difference of log probabilities, by sequence."""

    keys: np.ndarray  # sorted sequences seen in either class
    ratio: np.ndarray
    contexts: np.ndarray
    unseen: np.ndarray  # the difference for a byte not seen after the context
    slots: np.ndarray | None = field(default=None, repr=False)

    def indexed(self) -> Table:
        slot = self._slot(self.keys)
        self.slots = np.zeros(1 << _SLOT_BITS, np.int32)
        self.slots[slot] = np.arange(len(self.keys), dtype=np.int32)
        return self

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def ratios(self, g: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(g))
        at = self.slots[self._slot(g)]
        out = self.ratio[at]
        other = np.flatnonzero(self.keys[at] != g)
        if len(other):
            missed = g[other]
            at = np.minimum(np.searchsorted(self.keys, missed), len(self.keys) - 1)
            found = self.keys[at] == missed
            context = missed >> np.uint64(8)
            place = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            out[other] = np.where(found, self.ratio[at], np.where(self.contexts[place] == context, self.unseen[place], 0.0))
        return out


@dataclass
class Model:
    tables: tuple[Table, Table] | None = None  # across words, within words
    constant: float | None = None
    weights: np.ndarray | None = None

    def inputs(self, texts: pa.Array) -> np.ndarray:
        """Of each text: for both tables the mean difference and the means of the two highest windows; log of the number of windows."""
        out = np.zeros((len(texts), 7))
        half = WINDOW // 2
        for lo, hi, data, off in text_steps(texts):
            length = np.diff(off)
            some = np.flatnonzero(length)
            if not len(some):
                continue
            length, begins = length[some], off[:-1][some]
            pieces = (length + half - 1) // half
            doc = np.repeat(np.arange(len(some)), pieces)
            first = np.cumsum(pieces) - pieces
            place = np.arange(len(doc)) - first[doc]
            for kind, g in enumerate((sequences(data, off), sequences_in_words(data, off))):
                each = self.tables[kind].ratios(g).astype(np.float64)
                each[g == 0] = 0.0
                piece = np.add.reduceat(each, begins[doc] + place * half)
                following = np.append(piece[1:], 0.0)
                following[first[1:] - 1] = 0.0
                window = piece + following
                best = np.maximum.reduceat(window, first)
                at = np.full(len(some), -9)
                hit = np.flatnonzero(window == best[doc])[::-1]
                at[doc[hit]] = place[hit]
                second = np.maximum.reduceat(np.where(np.abs(place - at[doc]) <= 1, -np.inf, window), first)
                out[lo + some, 3 * kind] = np.add.reduceat(each, begins) / length
                out[lo + some, 3 * kind + 1] = best / WINDOW
                out[lo + some, 3 * kind + 2] = np.where(np.isfinite(second), second, 0.0) / WINDOW
            out[lo + some, 6] = np.log1p(pieces)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(_terms(self.inputs(texts)) @ self.weights, -30, 30)))


def _terms(x: np.ndarray) -> np.ndarray:
    size, columns = x[:, 6], [np.ones(len(x)), x[:, 6]]
    for mean, window, second in (x[:, 0:3].T, x[:, 3:6].T):
        columns += [mean * 50, window * 10, window * 10 * size, second * 10, second * 10 * size]
    return np.stack(columns, axis=1)


def _discount(counts: np.ndarray) -> float:
    ones, twos = (counts == 1).sum(), (counts == 2).sum()
    return float(ones / (ones + 2 * twos)) if ones else 0.5


def _interpolated(keys: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kneser-Ney probability of each key given lower-order ones; the contexts and their backoff weights."""
    contexts, place = np.unique(keys >> np.uint64(8), return_inverse=True)
    total = np.bincount(place, weights=counts)
    kinds = np.bincount(place, weights=counts > 0)
    d = _discount(counts)
    back = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
    return np.maximum(counts - d, 0) / np.maximum(total, 1)[place] + back[place] * lower, contexts, back


def kneser_ney(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, top: int = ORDER) -> Table:
    """keys: sorted distinct sequences of `top` bytes; toxic, ordinary: their counts."""
    if not len(keys):
        return Table(*[np.zeros(0, np.uint64), np.zeros(0)] * 2)
    levels = [keys]
    for order in range(top - 1, 0, -1):
        levels.append(np.unique(levels[-1] & np.uint64((1 << 8 * order) - 1)))
    p = np.full(len(levels[-1]), 1 / 256)
    for order in range(1, top):
        above, own = levels[top - 1 - order], levels[top - order]
        continued = np.bincount(np.searchsorted(own, above & np.uint64((1 << 8 * order) - 1)), minlength=len(own)).astype(float)
        if order > 1:
            p = p[np.searchsorted(levels[top - order + 1], own & np.uint64((1 << 8 * (order - 1)) - 1))]
        p = _interpolated(own, continued, p)[0]
    shared = p[np.searchsorted(levels[1], keys & np.uint64((1 << 8 * (top - 1)) - 1))]
    both, contexts, _ = _interpolated(keys, toxic + ordinary, shared)
    place = np.searchsorted(contexts, keys >> np.uint64(8))

    def of_class(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        less = np.minimum(counts, DISCOUNT)
        total, lost = np.bincount(place, weights=counts), np.bincount(place, weights=less)
        back = np.where(total > 0, lost / np.maximum(total, 1), 1.0)
        return (counts - less) / np.maximum(total, 1)[place] + back[place] * both, back

    (p_toxic, back_toxic), (p_ordinary, back_ordinary) = of_class(toxic), of_class(ordinary)
    return Table(keys, np.log(p_toxic / p_ordinary), contexts, np.log(np.maximum(back_toxic, 1e-6) / np.maximum(back_ordinary, 1e-6)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step / max(1.0, np.abs(step).max() / 5)
    return w


def trained(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, usable=None) -> Model:
    usable = remainder(5) != 0 if usable is None else usable
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    draw = F.md5(F.col("doc_id").cast("string"))
    ids = one.where("label = 1").orderBy(draw, "doc_id").limit(max_labelled // 3).union(one.where("label = 0").orderBy(draw, "doc_id").limit(max_labelled - max_labelled // 3))
    fifth = F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string"))) % 4 == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    # one row an id, however often the id stands in the table: the sample is bounded in rows, too
    one_each = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = written(one_each.select("label", fifth.alias("tuning"), "text"))

    def count(batches):
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in text_steps(batch.column(1)):
                of = np.repeat(label[lo:hi], np.diff(off))
                for found, kind in ((f, kind) for f in (sequences(data, off), sequences_in_words(data, off)) for kind in (0, 1)):
                    keys, counts = np.unique(found[(of == kind) & (found > 0)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(np.where(kind == 1, counts, 0)), pa.array(np.where(kind == 0, counts, 0))], names=["key", "toxic", "ordinary"])

    shares = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        n, ones = sum(shares.values()), shares.get(1, 0)
        return Model(constant=(ones + 0.5) / (n + 1))
    counts = sample.where("not tuning").select("label", "text").mapInArrow(count, "key long, toxic long, ordinary long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toArrow().sort_by("key")
    keys, toxic, ordinary = counts["key"].to_numpy().astype(np.uint64), counts["toxic"].to_numpy().astype(float), counts["ordinary"].to_numpy().astype(float)
    # sequences of seven bytes are the larger numbers
    cut = int(np.searchsorted(keys, np.uint64(1 << 8 * ORDER)))
    tables = tuple(kneser_ney(keys[part], toxic[part], ordinary[part], top) for part, top in ((slice(0, cut), ORDER), (slice(cut, None), WORD_ORDER)))
    for table in tables:
        table.ratio = table.ratio.astype(np.float32)
    model = Model(tuple(t.indexed() for t in tables))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            x = shipped.value.inputs(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, i]) for i in range(7)]], names=["label", *"abcdefg"])

    tuning = np.array(sample.where("tuning").select("label", "text").mapInArrow(measure, "label int, a double, b double, c double, d double, e double, f double, g double").collect())
    if not len(tuning) or len(set(tuning[:, 0])) < 2:
        model.weights = np.eye(12)[2] + np.eye(12)[7]
    else:
        model.weights = logistic(_terms(tuning[:, 1:]), tuning[:, 0])
    return model


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, **options))

    def run(batches):
        for batch in batches:
            got = model.value.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")
