"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its words hashed into buckets (damped counts, scaled to length one), statistics
of its layout, and n_chars. The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so that all pairwise interactions cost time linear in the features. Labels, lang, source and
doc_id are never features.

The model is fitted on the driver to at most max_labelled labelled rows, those of least MD5 of the id, one row of
each id (of several the one whose text has the least hash; a bounded sample of about 10 kB a row); every text is scored on the
executors in one scan, without a shuffle.

Defined cases: null and empty texts are scored by their constant features; a null n_chars is taken from the
text; labels of one doc_id are averaged and count as 1 from 0.5 on, null labels are ignored; with no
usable label every score is 0.5, with one class only it is that class's smoothed share; repeated rows
are scored alike; very long texts are measured whole; other columns, of any name, are kept by the stage and not read; an empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, filtered, text_steps, word_hashes

BUCKETS = 4096
MAX_LABELLED = 6000
RANK, EPOCHS, RATE, PENALTY = 8, 12, 0.05, 1e-5
_STATISTICS = 16
FEATURES = BUCKETS + _STATISTICS


def _byte_class(of) -> np.ndarray:
    return np.array([of(b) for b in range(256)], np.float32)


_CLASSES = {
    "upper": _byte_class(lambda b: 65 <= b <= 90),
    "lower": _byte_class(lambda b: 97 <= b <= 122),
    "digit": _byte_class(lambda b: 48 <= b <= 57),
    "stop": _byte_class(lambda b: b in b".,;:?"),
    "mark": _byte_class(lambda b: b in b"!"),
    "symbol": _byte_class(lambda b: 33 <= b < 127 and not chr(b).isalnum() and b not in b".,;:?!"),
    "feed": _byte_class(lambda b: b == 10),
    "wide": _byte_class(lambda b: b >= 128),
}


def features(texts: pa.Array, n_chars: pa.Array):
    """(first row, row index, feature index, value) of runs of rows; the values of a row stand together."""
    n_chars = pc.cast(n_chars, pa.float64()).to_numpy(zero_copy_only=False)
    for lo, hi, data, off in text_steps(texts):
        n = hi - lo
        length = np.diff(off).astype(np.float64)
        words, doc, _ = word_hashes(data, off, WORDS)
        pairs, count = np.unique(doc * BUCKETS + (words >> np.uint64(52)).astype(np.int64), return_counts=True)
        row, bucket = pairs // BUCKETS, pairs % BUCKETS
        value = np.log1p(count)
        norm = np.sqrt(np.bincount(row, weights=value**2, minlength=n))
        value /= norm[row]
        total = np.bincount(doc, minlength=n).astype(np.float64)
        distinct = _distinct(doc, words, n)
        per = {}
        for name, table in _CLASSES.items():
            sums = np.add.reduceat(np.append(table[data], 0.0), off[:-1], dtype=np.float64) if n else np.zeros(0)
            per[name] = np.where(length > 0, sums, 0.0)
        known = np.where(np.isnan(n_chars[lo:hi]), length, n_chars[lo:hi])
        safe, safe_words = np.maximum(length, 1), np.maximum(total, 1)
        letters = np.maximum(per["upper"] + per["lower"] + per["wide"], 1)
        columns = [
            np.ones(n),
            np.log1p(length) / 10,
            np.log1p(np.maximum(known, 0)) / 10,
            np.log1p(total) / 10,
            distinct / safe_words,
            np.minimum(letters / safe_words / 10, 2),
            per["upper"] / letters,
            per["digit"] / safe * 4,
            per["stop"] / safe_words * 2,
            np.minimum(per["mark"] / safe_words, 2),
            np.minimum(per["symbol"] / safe_words, 2),
            np.minimum(per["symbol"] / safe * 4, 2),
            per["wide"] / safe,
            np.minimum(per["feed"] / safe_words * 10, 2),
            (total == 0).astype(float),
            (total < 30).astype(float),
        ]
        rows = np.concatenate([row, np.tile(np.arange(n), len(columns))])
        index = np.concatenate([bucket, np.repeat(np.arange(BUCKETS, FEATURES), n)])
        values = np.concatenate([value, *columns])
        order = np.argsort(rows, kind="stable")
        yield lo, n, rows[order], index[order], values[order].astype(np.float32)


def _distinct(doc: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Distinct words of each text."""
    if not len(words):
        return np.zeros(n)
    order = np.lexsort((words, doc)) if len(words) < 1000 else np.argsort((doc.astype(np.uint64) << np.uint64(44)) | (words >> np.uint64(20)))
    d, w = doc[order], words[order]
    new = np.append(True, (d[1:] != d[:-1]) | (w[1:] != w[:-1]))
    return np.bincount(d[new], minlength=n).astype(np.float64)


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    constant: float | None = None

    def raw(self, n: int, row: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Every row has features, and they stand together."""
        begins = np.searchsorted(row, np.arange(n))
        linear = np.add.reduceat(self.w[index] * value, begins)
        part = self.v[index] * value[:, None]
        sums = np.add.reduceat(part, begins, axis=0)
        squares = np.add.reduceat((part * part).sum(axis=1), begins)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares)

    def scores(self, texts: pa.Array, n_chars: pa.Array) -> np.ndarray:
        out = np.full(len(texts), 0.5 if self.constant is None else self.constant)
        if self.constant is None:
            for lo, n, *found in features(texts, n_chars):
                out[lo : lo + n] = 1 / (1 + np.exp(-np.clip(self.raw(n, *found), -30, 30)))
        return out


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Machine:
    """Adagrad on the logistic loss; rows: (feature index, value, label)."""
    label = np.array([r[2] for r in rows], np.float64)
    zero = np.zeros(FEATURES, np.float32)
    if not len(rows) or label.min() == label.max():
        return Machine(0.0, zero, np.zeros((FEATURES, RANK), np.float32), 0.5 if not len(rows) else (label.sum() + 0.5) / (len(rows) + 1))
    rng = np.random.default_rng(seed)
    share = label.mean()
    m = Machine(float(np.log(share / (1 - share))), zero.astype(np.float64), rng.normal(0, 0.05, (FEATURES, RANK)))
    seen_w, seen_v, seen_b = np.full(FEATURES, 1e-4), np.full((FEATURES, RANK), 1e-4), 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 64):
            some = order[at : at + 64]
            row = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            index = np.concatenate([rows[i][0] for i in some]).astype(np.int64)
            value = np.concatenate([rows[i][1] for i in some]).astype(np.float64)
            begins = np.searchsorted(row, np.arange(len(some)))
            part = m.v[index] * value[:, None]
            sums = np.add.reduceat(part, begins, axis=0)
            raw = m.bias + np.add.reduceat(m.w[index] * value, begins) + 0.5 * ((sums * sums).sum(axis=1) - np.add.reduceat((part * part).sum(axis=1), begins))
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[some]) / len(some)
            used, place = np.unique(index, return_inverse=True)
            by = slope[row] * value
            g_w = np.bincount(place, weights=by) + PENALTY * m.w[used]
            g = by[:, None] * (sums[row] - part)
            g_v = np.stack([np.bincount(place, weights=g[:, f]) for f in range(RANK)], axis=1) + PENALTY * m.v[used]
            seen_w[used] += g_w**2
            seen_v[used] += g_v**2
            seen_b += slope.sum() ** 2
            m.w[used] -= RATE * g_w / np.sqrt(seen_w[used])
            m.v[used] -= RATE * g_v / np.sqrt(seen_v[used])
            m.bias -= RATE * slope.sum() / np.sqrt(seen_b)
    m.w, m.v = m.w.astype(np.float32), m.v.astype(np.float32)
    return m


def remainder(modulus: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def sampled_labels(labels: DataFrame, column: str, usable, most: int) -> DataFrame:
    """doc_id and label of at most `most` labelled rows, those of least MD5 of the id."""
    one = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(column) >= 0.5).cast("int").alias("label"))
    return one.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)


def with_n_chars(docs: DataFrame):
    return F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def trained(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, column: str = "quality", usable=None) -> Machine:
    usable = remainder(3) != 1 if usable is None else usable
    ids = sampled_labels(labels, column, usable, max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", with_n_chars(docs).alias("n_chars")).join(F.broadcast(ids), "doc_id")
    # one row an id, however often the id stands in the table: what comes to the driver is bounded in rows, too
    whole = F.struct(F.xxhash64("text"), "text", "n_chars")
    rows = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min(whole).alias("least")).select("doc_id", "label", "least.text", "least.n_chars")

    def run(batches):
        for batch in batches:
            found = []
            for _, n, row, index, value in features(batch.column(2), batch.column(3)):
                ends = np.searchsorted(row, np.arange(n + 1))
                found += [(index[a:b].astype(np.int16).tobytes(), value[a:b].astype(np.float16).tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], names=["doc_id", "label", "at", "value"])

    got = rows.mapInArrow(run, "doc_id long, label int, at binary, value binary").collect()  # max_labelled rows
    got = sorted(got, key=lambda r: (r.doc_id, bytes(r.at)))
    # as they came, four bytes a feature: a batch widens its own
    return fit([(np.frombuffer(r.at, np.int16), np.frombuffer(r.value, np.float16), r.label) for r in got])


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, **options))

    def run(batches):
        for batch in batches:
            got = model.value.scores(batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = docs.select("doc_id", "text", with_n_chars(docs).alias("n_chars")).mapInArrow(run, docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


def stage(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs that score 0.5 or more, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, **options))
    text, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            n_chars = pa.nulls(len(batch), pa.float64()) if chars is None else batch.column(chars)
            yield batch.filter(pa.array(model.value.scores(batch.column(text), n_chars) >= 0.5))

    return filtered(docs, run)
