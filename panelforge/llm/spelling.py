"""Spelling variants: words one edit apart by an errata trie that merges light subtrees, and the form that each belongs to.

The trie of all words has a node for each prefix. A node's heavy child is the one of most words; its other children, and the
end of a word at the node, are light. Two words that differ in one edit part at one node, and at most one of them goes on
into its heavy child. So it suffices to merge the light side, the smaller one, into what is there (small-to-large): a word at a light
edge enters with its character at the node skipped (among all words of the node), with the heavy one in front of it (in the heavy
child), with its own replaced by the heavy one (there, too) and with its own replaced by a wildcard (among the
other light children). Terminals that coincide are words one edit apart. A word of a vocabulary of V has
at most log2(V) light edges, so at most 4 log2(V) entries.

How it scales: texts become counts within tasks, in tables of FLUSH words at most, so a word on a third of all places moves as one row
from each. Nodes are hashes of prefixes, linear in a word's length (nodes that share a hash share the choice of the heavy child, which is all that
matters). Children are counted with partial sums; nodes near the root, which all words pass, are dealt over tasks
by `spread_join`. Entries meet words by hash and are checked by their edit distance. An entry's hash belongs to
no more words than there are single edits of a text. Chains of forms are followed by doubling; each step multiplies n by `factor`, so the
number of rounds is known from the largest n.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty text in the draw of the deleted code point; repeated rows are documents of
their own and have the same code points deleted; a very long text is counted whole, and a very long run is a word like any other; ties of n go to the word that is less in code points; an empty table
gives an empty result; other columns, of any name, are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _ODD, _power_tables, mix, spread_join, written

LEAST_LENGTH, LEAST_N, FACTOR = 6, 5, 5
#: A run loses a code point where this divides the hash of it and its document.
EVERY = 199
#: Words of a task's table of counts before it is sent on.
FLUSH = 300_000
#: In Latin-1: a-z and U+00C0 to U+00FF stay (A-Z are lower-cased before); all else, also what Latin-1 lacks, parts runs.
_KEPT = bytes(b if b >= 0xC0 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: The place after a word's last code point; and the wildcard. Neither is a code point of a word.
END, WILD = 0, b"\x01"


def runs_of(text: str | None) -> list[bytes]:
    """The lower-cased runs of a text, a byte a code point (Latin-1)."""
    return (text or "").encode("latin-1", "replace").lower().translate(_KEPT).split()


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def _counted(batches: Iterator[pa.RecordBatch], least: int, every: int) -> Iterator[pa.RecordBatch]:
    """word, n summed over runs of rows (doc_id as text, text)."""
    times: Counter = Counter()

    def rows() -> pa.RecordBatch:
        found = [(w.decode("latin-1"), n) for w, n in times.items() if n and len(w) >= least]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = [w for w in runs_of(text) if len(w) >= least]
            times.update(found)
            before = zlib.crc32(f"{doc_id}:".encode())
            for run in set(found):
                h = zlib.crc32(_utf8(run), before)
                if h % every == 0:
                    at, here = h % len(run), found.count(run)
                    times[run] -= here
                    times[run[:at] + run[at + 1 :]] += here
        if len(times) > FLUSH:
            yield rows()
            times.clear()
    yield rows()


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N, every: int = EVERY) -> DataFrame:
    """word, n, wid (its hash) of the words that occur often enough."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = rows.mapInArrow(lambda batches: _counted(batches, least_length, every), "word string, n long")
    return seen.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n).select("word", "n", F.xxhash64("word").alias("wid"))


def _places(words: DataFrame) -> DataFrame:
    """wid, at, node (hash of the word's first `at` code points), next (the code point after them, END after the last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
        for batch in batches:
            raw = [w.encode("latin-1") for w in batch.column(1).to_pylist()]
            size = np.array([len(w) for w in raw], np.int64)
            data = np.frombuffer(b"\x00".join(raw) + b"\x00", np.uint8) if raw else np.zeros(0, np.uint8)
            row = np.repeat(np.arange(len(raw)), size + 1)
            first = np.cumsum(size + 1) - (size + 1)
            at = np.arange(len(data)) - first[row]
            up, _ = _power_tables(int(size.max(initial=0)) + 1)
            sums = np.cumsum(code[data] * up[at]) if len(data) else np.zeros(0, np.uint64)
            before = np.concatenate([np.zeros(1, np.uint64), sums[:-1]]) if len(data) else sums
            node = mix(before - before[first[row]] + at.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(node.view(np.int64)), pa.array(data.astype(np.int32))], names=["wid", "at", "node", "next"])

    return words.select("wid", "word").mapInArrow(run, "wid long, at int, node long, next int")


def heavy_children(places: DataFrame) -> DataFrame:
    """node, heavy (the child of most words; of equals the least code point; never the end) of every node of two children or more."""
    children = places.groupBy("node", "next").agg(F.count("*").alias("n"))
    best = F.max_by("next", F.struct(F.col("next") != END, "n", -F.col("next")))
    return children.groupBy("node").agg(F.count("*").alias("children"), best.alias("heavy")).where("children > 1").select("node", "heavy")


def errata(words: DataFrame, lights: DataFrame) -> DataFrame:
    """key, word, n, wild of every entry of the words' light edges (wid, at, heavy)."""

    def entries(word: bytes, at: int, heavy: bytes) -> Iterator[tuple[bytes, bool]]:
        yield word[:at] + heavy + word[at:], False
        if at < len(word):
            yield word[:at] + word[at + 1 :], False
            yield word[:at] + heavy + word[at + 1 :], False
            yield word[:at] + WILD + word[at + 1 :], True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, row, wild = [], [], []
            for i, (word, edges) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = word.encode("latin-1")
                for edge in edges:
                    for text, free in entries(own, edge["at"], bytes([edge["heavy"]])):
                        # the seed is that of the words' hash
                        key.append(xxhash.xxh64_intdigest(_utf8(text), 42))
                        row.append(i)
                        wild.append(free)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(key, np.uint64).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(wild, pa.bool_())], names=["key", "word", "n", "wild"])

    # a word has log2(V) light edges at most
    edges = lights.groupBy("wid").agg(F.collect_list(F.struct("at", "heavy")).alias("edges"))
    return words.join(edges, "wid").select("word", "n", "edges").mapInArrow(run, "key long, word string, n long, wild boolean")


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n of every ordered pair of words that differ by one edit."""
    places = written(_places(words))
    lights = spread_join(places, written(heavy_children(places)), "node").where("next <> heavy").select("wid", "at", "heavy")
    entries = written(errata(words, lights))
    ends = words.select(F.col("wid").alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    ends = ends.unionByName(entries.where("wild").select("key", F.col("word").alias("other"), F.col("n").alias("other_n")))
    met = entries.join(ends, "key").where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n")
    return met.unionByName(met.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))).distinct()


def roots(forms: DataFrame, factor: int = FACTOR, least_n: int = LEAST_N) -> DataFrame:
    """word, root of every row of forms (word, form, form_n): the end of its chain of forms, found by doubling."""
    now = written(forms.select("word", F.col("form").alias("root")))
    top = forms.agg(F.max("form_n")).first()[0]
    reach, longest, n = 1, 0, least_n
    while top is not None and n * factor <= top:
        longest, n = longest + 1, n * factor
    while reach < longest:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now, reach = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))), 2 * reach
    return now


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N, factor: int = FACTOR, every: int = EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text) of least_length code points and least_n places or more."""
    words = written(vocabulary(docs, least_length, least_n, every))
    near = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    is_form = -F.col("best.less") >= factor * F.col("n")
    near = written(near.select("word", "n_near", F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    ends = roots(near.where("form is not null").select("word", "form", "form_n"), factor, least_n)
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


SQL = r"""
WITH RECURSIVE runs AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY id, run),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))),
    lambda h, b: list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: xor(x >> 1, 3988292384 * (x & 1))))) AS h
  FROM counted),
w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
met AS (
  SELECT a.word AS x, a.n AS x_n, b.word AS y, b.n AS y_n FROM cut a JOIN w b ON a.rest = b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
near AS (SELECT x AS word, x_n AS n, y AS other, y_n AS other_n FROM met UNION SELECT y, y_n, x, x_n FROM met),
best AS (SELECT word, n, count(*) AS n_near, min({'less': -other_n, 'other': other}) AS b FROM near GROUP BY word, n),
form AS (SELECT word, n_near, CASE WHEN -b.less >= 5 * n THEN b.other END AS form, CASE WHEN -b.less >= 5 * n THEN -b.less END AS form_n FROM best),
chain AS (SELECT word, word AS root FROM w UNION ALL SELECT c.word, f.form FROM chain c JOIN form f ON c.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c LEFT JOIN form f ON c.root = f.word WHERE f.form IS NULL)
SELECT w.word, form, root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n FROM w JOIN ends USING (word) LEFT JOIN form USING (word)
"""
