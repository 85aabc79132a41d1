"""LM scoring by masked pseudo-likelihood: a window network predicts each token from both its sides.

Tokens are words (A-Z as a-z), hashed to 2 ** VOCABULARY_BITS ids for the network. A token's probability is

    p(class of id | two ids before, two after) * p(id | its class) * p(word | its id)

The first factor is a network: each neighbour's embedding is scaled by its place, their sum goes through tanh
and a softmax over CLASSES. Classes are runs of ids of equal mass by falling frequency, the second
factor is the id's smoothed share of its class, and the third is the word's share of its id's occurrences, so
words that meet in an id keep their own counts; all come from counts over the whole corpus.

Training is numpy on the executors. Documents are dealt into about sqrt(tokens / TOKENS_A_SHARD) shards by a hash of their
tokens (copies of one text go to different shards) and stand in the order of that hash, so what a shard learns does not
depend on how the table is partitioned or ordered. In each of EVERY rounds a shard takes Adagrad steps from the common
parameters on one in EVERY of its positions, and the shards' parameters are averaged by positions seen, in the order of
shards. The rounds take each position once, so every position of every document is a target. A document's score is the sum
of its tokens' log-probabilities.

How it scales: tokens are written once, two bytes each and eight more for a word beyond the HEAD most frequent, and once more
as shards; rounds read them where they are. The network is 1.1 MB however large the corpus, parameters of shards stream
through two levels of sums in constant memory, and their number grows with the root of the corpus until a shard is a
row of 64 MB. Word
counts are a table that grows with the corpus: its HEAD is broadcast, all other words are joined, so no frequent
word is a key of the join.

Defined cases: null and empty texts and texts without words have 0 tokens, score 0 and a null mean; repeated
rows are scored each; a very long text is tokenised, learnt and scored whole; ids of equal count are dealt into classes by
their number; other columns are not read; an empty corpus trains nothing and gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_steps, word_hashes, written

VOCABULARY_BITS, CLASSES, WIDTH, REACH = 14, 64, 16, 2
VOCABULARY = 1 << VOCABULARY_BITS
EVERY, STEP, RATE = 2, 1024, 0.1
#: Of a corpus of one shard; larger ones have a root's share of it more shards and of longer ones.
TOKENS_A_SHARD = 4000
#: A shard is a row of two bytes a token, so it has no more tokens than this.
TOKENS_A_ROW = 1 << 25
#: Most frequent words, whose shares are broadcast.
HEAD = 1 << 16
_PLACES = [*range(-REACH, 0), *range(1, REACH + 1)]


def word_shares(docs: DataFrame) -> DataFrame:
    """word (its hash), n, share: log of the word's part of all occurrences of its id, of every word of the corpus."""

    def run(batches):
        def counted(parts):
            words, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            seen, at = np.unique(words, return_inverse=True)
            return seen, np.bincount(at, weights=n, minlength=len(seen)).astype(np.int64)

        def out(parts):
            words, n = counted(parts)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

        parts = []
        for batch in batches:
            for _, _, data, off in text_steps(batch.column(0)):
                parts.append(np.unique(word_hashes(data, off)[0], return_counts=True))
            if sum(len(p[0]) for p in parts) > 1 << 20:
                parts = [counted(parts)]
                if len(parts[0][0]) > 1 << 19:
                    yield out(parts)
                    parts = []
        if parts:
            yield out(parts)

    counts = written(docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    of_id = F.shiftrightunsigned("word", 64 - VOCABULARY_BITS).alias("id")
    totals = counts.groupBy(of_id).agg(F.sum("n").alias("total"))  # VOCABULARY rows at most
    return written(counts.select("*", of_id).join(F.broadcast(totals), "id").select("word", "n", F.log(F.col("n") / F.col("total")).alias("share")))


def head_shares(shares: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The `size` most frequent words in order of hash, and their shares."""
    top = shares.orderBy(F.desc("n"), "word").limit(size).select("word", "share").toArrow()
    words = top["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    return words[order], top["share"].to_numpy()[order]


def tokens(docs: DataFrame, head: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, ids (of the whole text as two-byte numbers), own (sum of the head words' shares), tail (all other words)."""
    shipped = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        known, share = shipped.value
        for batch in batches:
            found, own, tail = [], [], []
            for lo, hi, data, off in text_steps(batch.column(1)):
                words, doc, _ = word_hashes(data, off)
                ids = (words >> np.uint64(64 - VOCABULARY_BITS)).astype(np.uint16)
                ends = np.searchsorted(doc, np.arange(hi - lo + 1))
                found += [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                place = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
                here = known[place] == words if len(known) else np.zeros(len(words), bool)
                own.append(np.bincount(doc[here], weights=share[place[here]], minlength=hi - lo).astype(float))
                cut = np.searchsorted(doc[~here], np.arange(hi - lo + 1))
                rest = words[~here].view(np.int64)
                tail += [rest[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            own = np.concatenate(own) if own else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array(own, pa.float64()), pa.array(tail, pa.list_(pa.int64()))], names=["doc_id", "ids", "own", "tail"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, own double, tail array<long>")


def stretches(off: np.ndarray, limit: int = 1 << 17):
    """(first, end) of runs of whole documents, about limit tokens each, by their offsets."""
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def token_steps(column: pa.Array, limit: int = 1 << 17):
    """(first row, ids, offsets) of runs of whole documents, about limit tokens each."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    ids = np.frombuffer(data, np.uint16) if data is not None and data.size else np.zeros(0, np.uint16)
    off = off // 2
    for lo, hi in stretches(off, limit):
        yield lo, ids[off[lo] : off[hi]].astype(np.int64), off[lo : hi + 1] - off[lo]


def frequencies(tokenised: DataFrame) -> np.ndarray:
    """How often each id occurs in the corpus."""

    def run(batches):
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for _, ids, _ in token_steps(batch.column(0)):
                total += np.bincount(ids, minlength=VOCABULARY)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    out = np.zeros(VOCABULARY, np.int64)
    for r in tokenised.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # VOCABULARY rows at most
        out[r.id] = r.n
    return out


@dataclass
class Network:
    embedding: np.ndarray  # of each id, and of the place beyond a text's end
    places: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    class_of: np.ndarray
    within: np.ndarray  # log p(id | its class)

    NAMES = ("embedding", "places", "bias", "out", "out_bias")

    @classmethod
    def fresh(cls, counts: np.ndarray, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        order = np.argsort(-counts, kind="stable")
        smooth = counts + 0.5
        mass = np.cumsum(smooth[order]) / smooth.sum()
        class_of = np.empty(VOCABULARY, np.int64)
        class_of[order] = np.minimum(((mass - smooth[order] / smooth.sum() / 2) * CLASSES).astype(np.int64), CLASSES - 1)
        of_class = np.bincount(class_of, weights=smooth, minlength=CLASSES)
        share = np.maximum(of_class, 1e-9) / of_class.sum()
        return cls(
            rng.normal(0, 0.3, (VOCABULARY + 1, WIDTH)).astype(np.float32),
            np.ones((len(_PLACES), WIDTH), np.float32),
            np.zeros(WIDTH, np.float32),
            rng.normal(0, 0.1, (WIDTH, CLASSES)).astype(np.float32),
            np.log(share).astype(np.float32),
            class_of,
            np.log(smooth / of_class[class_of]),
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES]).astype(np.float64)

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.bias + self.embedding[context[:, 0]] * self.places[0]
        for j in range(1, len(_PLACES)):
            total += self.embedding[context[:, j]] * self.places[j]
        return np.tanh(total)

    def log_class(self, hidden: np.ndarray, dtype: type = np.float32) -> np.ndarray:
        logits = hidden.astype(dtype) @ self.out.astype(dtype) + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def token_scores(self, ids: np.ndarray, off: np.ndarray, step: int = 8192) -> np.ndarray:
        context, wanted, out = contexts(ids, off), self.class_of[ids], self.within[ids].copy()
        scaled = [self.embedding * place for place in self.places]  # once for all positions
        matrix, bias = self.out.astype(np.float64), self.out_bias.astype(np.float64)
        for lo in range(0, len(ids), step):
            around = context[lo : lo + step]
            total = self.bias + scaled[0].take(around[:, 0], axis=0)
            for j in range(1, len(_PLACES)):
                total += scaled[j].take(around[:, j], axis=0)
            # a product's last digits depend on a row's place in the block: doubles, rounded, give equal texts equal scores
            logits = np.tanh(total, out=total).astype(np.float64) @ matrix
            logits += bias
            logits -= logits.max(axis=1, keepdims=True)
            # only the wanted class's logarithm is formed, and the exponentials take the logits' place
            found = logits[np.arange(len(around)), wanted[lo : lo + step]]
            found -= np.log(np.exp(logits, out=logits).sum(axis=1))
            out[lo : lo + step] += np.rint(found * (1 << 20)) / (1 << 20)
        return out


def contexts(ids: np.ndarray, off: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The ids around each token (or those at the places given), VOCABULARY beyond the ends of its text."""
    # REACH places lie before and after each text, so that no position looks into another text
    moved = np.arange(len(ids)) + np.repeat(np.arange(1, len(off)) * REACH, np.diff(off))
    wide = np.full(len(ids) + len(off) * REACH, VOCABULARY)
    wide[moved] = ids
    around = moved if at is None else moved[at]
    return np.stack([wide[around + d] for d in _PLACES], axis=1)


class Trainer:
    """Adagrad steps on one shard's positions, STEP by STEP however they arrive."""

    def __init__(self, net: Network):
        self.net, self.seen = net, 0
        self.sums = {n: np.full(getattr(net, n).shape, 1e-3, np.float32) for n in Network.NAMES}
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    def take(self, context: np.ndarray, wanted: np.ndarray) -> None:
        self.kept.append((context, wanted))
        if sum(len(k[1]) for k in self.kept) >= STEP:
            context, wanted = (np.concatenate(x) for x in zip(*self.kept, strict=True))
            full = len(wanted) // STEP * STEP
            for lo in range(0, full, STEP):
                self.step(context[lo : lo + STEP], wanted[lo : lo + STEP])
            self.kept = [(context[full:], wanted[full:])]

    def done(self) -> Network:
        if sum(len(k[1]) for k in self.kept):
            self.step(*(np.concatenate(x) for x in zip(*self.kept, strict=True)))
        self.kept = []
        return self.net

    def step(self, context: np.ndarray, wanted: np.ndarray) -> None:
        net, n = self.net, len(wanted)
        around = net.embedding[context]
        h = net.bias + around[:, 0] * net.places[0]
        for j in range(1, len(_PLACES)):
            h += around[:, j] * net.places[j]
        np.tanh(h, out=h)
        p = h @ net.out
        p += net.out_bias
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p *= (np.float32(1 / n) / p.sum(axis=1))[:, None]
        p[np.arange(n), wanted] -= np.float32(1 / n)
        back = (p @ net.out.T) * (1 - h * h)
        self._move("out", h.T @ p)
        self._move("out_bias", p.sum(axis=0))
        places = np.stack([(back * around[:, j]).sum(axis=0) for j in range(len(_PLACES))])
        flat = context.astype(np.uint16).ravel()  # sorts by radix
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        begins = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        used = flat[begins].astype(np.int64)
        grad = np.add.reduceat((back[:, None, :] * net.places[None]).reshape(-1, WIDTH)[order], begins, axis=0)
        seen = self.sums["embedding"][used] + grad * grad
        self.sums["embedding"][used] = seen
        net.embedding[used] -= RATE * grad / np.sqrt(seen)
        self._move("places", places)
        self._move("bias", back.sum(axis=0))
        self.seen += n

    def _move(self, name: str, grad: np.ndarray) -> None:
        self.sums[name] += grad**2
        getattr(self.net, name)[...] -= RATE * grad / np.sqrt(self.sums[name])


def masked_at(ids: np.ndarray, off: np.ndarray, turn: int, every: int = EVERY) -> np.ndarray:
    """Positions that a round predicts: that many rounds predict each position once."""
    at = np.arange(len(ids)) - np.repeat(off[:-1], np.diff(off))
    return np.flatnonzero((at + ids * 5) % every == turn)


def shards_of(tokens: int) -> int:
    """About the root of the corpus's size, and no shard over TOKENS_A_ROW."""
    return max(int(np.ceil(np.sqrt(tokens / TOKENS_A_SHARD))), -(-tokens // TOKENS_A_ROW))


def sharded(tokenised: DataFrame, shards: int) -> DataFrame:
    """shard, ids, ends: a row for each shard: its documents' ids one after the other, in the order of hashes, and where each ends.

    Copies of a text are numbered and dealt like other texts, so no shard gets more than its part of them.
    """
    copies = tokenised.where(F.length("ids") > 0).groupBy(F.xxhash64("ids").alias("a"), F.xxhash64(F.lit("second"), "ids").alias("b")).agg(F.first("ids").alias("ids"), F.count("*").alias("n"))
    each = copies.select("a", "b", "ids", F.explode(F.expr("sequence(1L, n)")).alias("copy"))
    dealt = each.select(F.pmod(F.xxhash64("a", "b", "copy"), F.lit(shards)).cast("int").alias("shard"), "a", "b", "copy", "ids")
    in_order = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "a", "b", "copy").select("shard", "ids")

    def pack(batches):
        now, ids, ends = None, [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([b"".join(ids)], pa.binary()), pa.array([np.cumsum(ends, dtype=np.int64).tobytes()], pa.binary())], names=["shard", "ids", "ends"])

        for shard, batch in _runs(batches):
            if shard != now:
                if ids:
                    yield out()
                now, ids, ends = shard, [], []
            for text in batch.column(1):
                ids.append(text.as_buffer().to_pybytes())
                ends.append(len(ids[-1]) // 2)
        if ids:
            yield out()

    return in_order.mapInArrow(pack, "shard int, ids binary, ends binary")


def _runs(batches, key: int = 0):
    """(key, batch) of stretches of rows with one key."""
    for batch in batches:
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo < hi:
                yield int(keys[lo]), batch.slice(lo, hi - lo)


def trained(tokenised: DataFrame) -> Network:
    sc = tokenised.sparkSession.sparkContext
    counts = frequencies(tokenised)
    net = Network.fresh(counts)
    if not counts.sum():
        return net
    shards = shards_of(int(counts.sum()))
    lessons = written(sharded(tokenised, shards))
    streams, every = int(np.ceil(np.sqrt(shards))), EVERY
    for turn in range(every):
        common = sc.broadcast(net)

        def learn(batches, common=common, turn=turn):
            from copy import deepcopy

            for batch in batches:
                for shard, ids, ends in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    ids, off = np.frombuffer(ids.as_buffer(), np.uint16), np.append(0, np.frombuffer(ends.as_buffer(), np.int64))
                    trainer = Trainer(deepcopy(common.value))
                    for lo, hi in stretches(off):
                        own, at = ids[off[lo] : off[hi]].astype(np.int64), off[lo : hi + 1] - off[lo]
                        masked = masked_at(own, at, turn, every)
                        trainer.take(contexts(own, at, masked), trainer.net.class_of[own[masked]])
                    flat = trainer.done().flat().astype(np.float32).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([shard % streams], pa.int32()), pa.array([shard], pa.int32()), pa.array([trainer.seen]), pa.array([flat], pa.binary())], names=["stream", "part", "n", "flat"])

        def add(batches):
            """One weighted mean for each stream, its parts in order."""
            now, total, n = None, None, 0

            def out():
                return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([now], pa.int32()), pa.array([n]), pa.array([(total / max(n, 1)).astype(np.float32).tobytes()], pa.binary())], names=["stream", "part", "n", "flat"])

            for stream, batch in _runs(batches):
                if stream != now:
                    if now is not None:
                        yield out()
                    now, total, n = stream, 0.0, 0
                for seen, flat in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                    total, n = total + np.frombuffer(flat.as_buffer(), np.float32).astype(np.float64) * seen, n + seen
            if now is not None:
                yield out()

        form = "stream int, part int, n long, flat binary"
        learnt = lessons.mapInArrow(learn, form)
        for width in (streams, 1):
            learnt = learnt.repartition(width, "stream").sortWithinPartitions("stream", "part").mapInArrow(add, form)
        net.load(np.frombuffer(learnt.collect()[0].flat, np.float32).astype(np.float64))  # one row
    return net


def score(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """doc_id, tokens, log_likelihood (sum over the tokens), mean (by token) of every row."""
    shares = word_shares(docs)
    tokenised = written(tokens(docs, head_shares(shares, head)).withColumn("rid", F.monotonically_increasing_id()))
    net = docs.sparkSession.sparkContext.broadcast(trained(tokenised))

    def run(batches):
        for batch in batches:
            n, total = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for lo, ids, off in token_steps(batch.column(1)):
                hi = lo + len(off) - 1
                doc = np.repeat(np.arange(hi - lo), np.diff(off))
                n[lo:hi] = np.diff(off)
                total[lo:hi] = np.bincount(doc, weights=net.value.token_scores(ids, off), minlength=hi - lo)
            total += batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total), batch.column(3)], names=["doc_id", "tokens", "log_likelihood", "rid"])

    out = tokenised.select("doc_id", "ids", "own", "rid").mapInArrow(run, "doc_id long, tokens long, log_likelihood double, rid long")
    # decimals, so that the sum does not depend on the order of rows
    rare = tokenised.select("rid", F.explode("tail").alias("word")).join(shares.select("word", F.col("share").cast("decimal(20,12)").alias("share")), "word").groupBy("rid").agg(F.sum("share").cast("double").alias("rare"))
    out = out.join(rare, "rid", "left").select("doc_id", "tokens", (F.col("log_likelihood") + F.coalesce("rare", F.lit(0.0))).alias("log_likelihood"))
    return out.withColumn("mean", F.when(F.col("tokens") > 0, F.col("log_likelihood") / F.col("tokens")))
