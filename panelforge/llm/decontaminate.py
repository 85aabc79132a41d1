"""Benchmark decontamination: short test items are found inside long documents by MinHash containment.

Items are partitioned by size (powers of two of their distinct five-word shingles), and each
partition has its own number of hash functions. An item's signature is, for each function, the shingle
of least hash. The chance that a document holds that shingle is exactly the containment of the item in
the document, whatever the document's length, so the share of an item's signature that occurs in a document
estimates containment without a bias against long documents, where plain Jaccard signatures fail.
A pair is a candidate when enough of the signature occurs: so much that a pair at the threshold fails
with a chance below 1e-9. Candidates are verified on the words themselves.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z as a-z, so layout, case and
punctuation do not hide an item. Items of fewer than five words are one shingle of their own length.

How it scales: items are counted first. A benchmark of up to BROADCAST_WORDS words (all usual ones) is sent to every task, and
documents are scanned once and not shuffled. A larger one stays a table: signatures are made on the executors, the
documents' shingles that pass a filter of fixed size meet them in a join by shingle, and candidates meet both texts. Both ways give
the same rows.

Defined cases: null and empty texts hold no item, and items without words are in no document; rows with null ids are
compared like others; repeated rows are reported each; a repeated item_id is one report for each of its rows; of equal least hashes
the first shingle signs; very long texts are searched whole; other columns, of any name, are kept by the stage and not read; an empty
table gives an empty result, an empty benchmark finds nothing.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, filtered, mix, shingle_hashes, text_steps, word_hashes, written

SHINGLE, THRESHOLD = 5, 0.8
#: Words of items that every task may hold; larger benchmarks are joined.
BROADCAST_WORDS = 1_000_000
#: Hash functions for items of up to 2 ** key shingles; larger ones take the last.
FUNCTIONS = {4: 24, 6: 32, 8: 48}
_PREFILTER_BITS = 20
_FILTER_BITS = 22
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return [w.lower() for w in _WORD.findall((text or "").encode())]


def shingles_of(words: list[bytes], k: int) -> set[bytes]:
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def least_hits(functions: int, threshold: float, miss: float = 1e-9) -> int:
    """The largest m with P(Binomial(functions, threshold) < m) <= miss."""
    below, m = 0.0, 0
    while m < functions:
        below += math.comb(functions, m) * threshold**m * (1 - threshold) ** (functions - m)
        if below > miss:
            return max(1, m)
        m += 1
    return max(1, m)


@dataclass
class Index:
    """Signatures of one batch of items, by shingle length."""

    items: list[tuple[int | None, int, set[bytes]]]  # id, shingle length, shingles
    keys: dict[int, np.ndarray]  # sorted distinct signature shingles
    owners: dict[int, list[list[tuple[int, int]]]]  # of each key: (item, functions that chose it)
    needed: list[int]
    first: dict[int, np.ndarray]  # prefilter on the low bits of a key


def signature(words: list[bytes]) -> tuple[int, int, list[tuple[int, int]]]:
    """Shingle length, number of hash functions, and (shingle, functions that chose it) of an item with words."""
    k = min(SHINGLE, len(words))
    joined = np.frombuffer(b" ".join(words), np.uint8)
    hashes, doc, _ = word_hashes(joined, np.array([0, len(joined)]), PLAIN)
    distinct = np.unique(shingle_hashes(hashes, doc, k)[0])
    functions = next((f for bits, f in FUNCTIONS.items() if len(distinct) <= 1 << bits), max(FUNCTIONS.values()))
    seeds = mix(np.arange(1, functions + 1, dtype=np.uint64))
    chosen = distinct[np.argmin(mix(distinct[None, :] ^ seeds[:, None]), axis=1)]
    keys, counts = np.unique(chosen, return_counts=True)
    return k, functions, list(zip(keys.tolist(), counts.tolist(), strict=True))


def build(rows: list[tuple[int | None, str | None]], threshold: float) -> Index:
    items, needed = [], []
    owners: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for item_id, text in rows:
        words = words_of(text)
        if not words:
            continue
        k, functions, chosen = signature(words)
        for key, count in chosen:
            owners[k][key].append((len(items), count))
        items.append((item_id, k, shingles_of(words, k)))
        needed.append(least_hits(functions, threshold))
    keys = {k: np.array(sorted(by), np.uint64) for k, by in owners.items()}
    first = {}
    for k, own in keys.items():
        first[k] = np.zeros(1 << _PREFILTER_BITS, bool)
        first[k][own & np.uint64((1 << _PREFILTER_BITS) - 1)] = True
    return Index(items, keys, {k: [owners[k][int(x)] for x in own] for k, own in keys.items()}, needed, first)


def search(texts: pa.Array, index: Index, threshold: float):
    """(row, item, shared shingles) of every text that holds an item."""
    low = np.uint64((1 << _PREFILTER_BITS) - 1)
    for lo, _, data, off in text_steps(texts):
        words, doc, _ = word_hashes(data, off, PLAIN)
        hits: dict[tuple[int, int], int] = defaultdict(int)
        for k, keys in index.keys.items():
            shingles, at = shingle_hashes(words, doc, k)
            maybe = np.flatnonzero(index.first[k][shingles & low])
            place = np.minimum(np.searchsorted(keys, shingles[maybe]), len(keys) - 1)
            sure = keys[place] == shingles[maybe]
            found = np.unique(np.stack([doc[at[maybe[sure]]], place[sure]], axis=1), axis=0)
            for row, key in found.tolist():
                for item, count in index.owners[k][key]:
                    hits[row, item] += count
        own: tuple[int, list[bytes], dict[int, set[bytes]]] = (-1, [], {})
        for (row, item), count in sorted(hits.items()):
            if count < index.needed[item]:
                continue
            if own[0] != row:
                own = (row, [w.lower() for w in _WORD.findall(data[off[row] : off[row + 1]].tobytes())], {})
            _, k, shingles = index.items[item]
            if k not in own[2]:
                own[2][k] = shingles_of(own[1], k)
            shared = len(shingles & own[2][k])
            if shared >= threshold * len(shingles):
                yield lo + row, item, shared


_FOUND = "doc_id long, item_id long, shared long, shingles long, containment double"
_NAMES = [c.split(" ")[0] for c in _FOUND.split(", ")]


def small_index(docs: DataFrame, items: DataFrame, threshold: float):
    """The broadcast index of items, or None if they have more than BROADCAST_WORDS words."""
    n = items.agg(F.sum(F.length("text") + 1), F.count("*")).first()
    if (n[0] or 0) // 2 > BROADCAST_WORDS or n[1] > BROADCAST_WORDS:  # a word and what parts it are two characters or more
        return None
    rows = [(r.item_id, r.text) for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").collect()]  # bounded by the count
    return docs.sparkSession.sparkContext.broadcast(build(rows, threshold))


def joined(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """rid and the found pair of docs (rid, doc_id, text): signatures as a table, met by the documents' shingles."""
    items = written(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text"))

    def sign(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words := words_of(text):
                    k, functions, chosen = signature(words)
                    out += [(item, k, least_hits(functions, threshold), key, count) for key, count in chosen]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(np.array(columns[3], np.uint64).view(np.int64)), pa.array(columns[4], pa.int32())], names=["item", "k", "needed", "key", "n"])

    signed = written(items.select("item", "text").mapInArrow(sign, "item long, k int, needed int, key long, n int"))
    lengths = sorted(r.k for r in signed.select("k").distinct().collect())  # SHINGLE rows at most
    low = (1 << _FILTER_BITS) - 1
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[signed.select(F.col("key").bitwiseAND(F.lit(low)).cast("int").alias("bit")).distinct().toArrow()["bit"].to_numpy()] = True  # a filter of fixed size
    shipped = docs.sparkSession.sparkContext.broadcast(bits)

    def shingled(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _, data, off in text_steps(batch.column(1)):
                words, doc, _ = word_hashes(data, off, PLAIN)
                for k in lengths:
                    shingles, at = shingle_hashes(words, doc, k)
                    maybe = np.flatnonzero(shipped.value[(shingles & np.uint64(low)).astype(np.int64)])
                    row, key = doc[at[maybe]], shingles[maybe]
                    order = np.lexsort((key, row))
                    row, key = row[order], key[order]
                    new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))[: len(row)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo + row[new]]), pa.array(np.full(int(new.sum()), k, np.int32)), pa.array(key[new].view(np.int64))], names=["rid", "k", "key"])

    hits = docs.select("rid", "text").mapInArrow(shingled, "rid long, k int, key long").join(signed, ["k", "key"]).groupBy("rid", "item").agg(F.sum("n").alias("n"), F.first("needed").alias("needed"))
    pairs = hits.where("n >= needed").select("rid", "item").join(docs, "rid").join(items.select("item", "item_id", F.col("text").alias("wanted")), "item")

    def verify(batches):
        for batch in batches:
            rid, doc_id, text, item_id, wanted = (batch.column(i).to_pylist() for i in range(5))
            out = []
            for i in range(len(batch)):
                words = words_of(wanted[i])
                k = min(SHINGLE, len(words))
                own = shingles_of(words, k)
                shared = len(own & shingles_of(words_of(text[i]), k))
                if shared >= threshold * len(own):
                    out.append((rid[i], doc_id[i], item_id[i], shared, len(own), shared / len(own)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i == 5 else pa.int64()) for i, c in enumerate(columns)], names=["rid", *_NAMES])

    return pairs.select("rid", "doc_id", "text", "item_id", "wanted").mapInArrow(verify, f"rid long, {_FOUND}")


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, shared, shingles, containment of every pair at the threshold or above."""
    index = small_index(docs, items, threshold)
    if index is None:
        keyed = written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
        return joined(keyed, items, threshold).drop("rid")

    def run(batches):
        for batch in batches:
            found = list(search(batch.column(1), index.value, threshold))
            ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            of = [index.value.items[f[1]] for f in found]
            total = [len(i[2]) for i in of]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([i[0] for i in of], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array(total, pa.int64()), pa.array([f[2] / t for f, t in zip(found, total, strict=True)], pa.float64())],
                names=_NAMES,
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _FOUND)


def stage(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that hold an item, with all their columns."""
    index = small_index(docs, items, threshold)
    if index is None:
        keyed = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("rid")))
        found = joined(keyed.select("rid", F.col("doc.doc_id").cast("long").alias("doc_id"), "doc.text"), items, threshold)
        return keyed.join(found.select("rid").distinct(), "rid", "left_anti").select("doc.*")
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = np.ones(len(batch), bool)
            keep[[row for row, _, _ in search(batch.column(at), index.value, threshold)]] = False
            yield batch.filter(pa.array(keep))

    return filtered(docs, run)


SQL = r"""
WITH w AS (
  SELECT 'd' AS side, row_number() OVER () AS rid, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words FROM documents
  UNION ALL
  SELECT 'i', row_number() OVER (), item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') FROM benchmark),
item AS (SELECT rid, id AS item_id, least(5, len(words)) AS k, unnest(list_distinct(list_transform(range(1, len(words) - least(5, len(words)) + 2), lambda i: array_to_string(words[i : i + least(5, len(words)) - 1], ' ')))) AS s FROM w WHERE side = 'i' AND len(words) > 0),
doc AS (SELECT rid, id AS doc_id, k, unnest(list_distinct(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i : i + k - 1], ' ')))) AS s FROM w, (SELECT DISTINCT k::BIGINT AS k FROM item) WHERE side = 'd' AND len(words) >= k),
total AS (SELECT rid, count(*) AS n FROM item GROUP BY rid)
SELECT doc_id, item_id, count(*)::BIGINT AS shared, any_value(n)::BIGINT AS shingles, count(*) / any_value(n)::DOUBLE AS containment
FROM doc JOIN item USING (k, s) JOIN total ON item.rid = total.rid
GROUP BY doc.rid, doc_id, item.rid, item_id HAVING count(*) >= 0.8 * any_value(n)
"""
