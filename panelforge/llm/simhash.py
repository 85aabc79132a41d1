"""SimHash near-dedup: fingerprints are linked at few differing bits by a popcount grid.

Embedding: a 64-bit fingerprint is cut into 32 segments of two bits; its point has each segment's bit
count (0 to 2) as a coordinate. Flipping one bit moves one coordinate by at most one, so the Manhattan
distance of two points is at most the Hamming distance of the fingerprints: a lower bound. Within 3
bits, one of the two halves of 16 coordinates is within Manhattan distance 1. So a half's point is a
grid cell; each fingerprint looks into its own cell and those one step up (the pair's other member
looks down), in both halves. Pairs that meet are compared exactly, by the bits that differ.

How it scales: copies share a fingerprint and are one row of the join; of n unrelated fingerprints, the
cell of one holds n / 2 ** 22.6 on average, and the fullest cell, where each segment has one bit set, n / 2 ** 16 (its seekers are dealt by Spark's skew join); only verified links leave the join, and a fingerprint has at
most 43 744 neighbours within 3 bits. Components come from alternating star contraction, with each
round's links in a written table; later links join components that are there.

The stage that drops near copies follows another rule, a Jaccard similarity of 0.8 or more of the sets of five-word shingles. Such
texts differ in 10 of 64 bits on average and often in 14, farther than a grid reaches without meeting a large share of all pairs. So the grid's pairs
(of five-word fingerprints, within 3 bits) are one source of candidates, and bands of MinHash values are the other; links of
both are verified on the sets. All texts of a band first meet its hub (a member that differs from band to band), the likeliest hub
first. Only texts of a band that are still in different groups then meet each other, in blocks of bounded size, so a group of thousands of
near copies is linked through hubs and not by all its pairs.

Defined cases: null and empty texts and texts without words have fingerprint zero and are linked like
others; shorter texts than a shingle hash the whole word sequence; repeated rows give repeated rows;
a null doc_id has a fingerprint, and its group's id comes from its other members (null if none has one); very long
texts are hashed whole; a bit that exactly half of the hashes set is 0; other columns, of any name, are kept by the stage and not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, scratch, shingle_hashes, spread_join, text_steps, word_hashes, written

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: The rule of the stage.
STAGE_SHINGLE, STAGE_JACCARD = 5, 0.8
#: Two texts at the stage's threshold meet in no band with a chance of (1 - 0.8 ** 5) ** 20 = 0.0004.
BANDS, BAND_ROWS = 20, 5
#: Of 100 places, two texts at the threshold agree in 80; fewer than these are four standard errors off.
LEAST_EQUAL = 64
#: Shingles of a block of texts that share a band: two blocks meet in memory.
BLOCK = 250_000
PAIRS_OF_BITS = 0x55555555


def fingerprint(text: str | bytes | None, k: int = SHINGLE) -> int:
    """A bit is 1 if set in over half of the XXH64 values of the k-word shingles, repeats included."""
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    start = np.flatnonzero(np.frombuffer(b" " + joined, np.uint8) == 32)
    end = np.append(start[1:] - 1, len(joined))
    last = max(0, min(k, len(words)) - 1)
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(start[: len(start) - last].tolist(), end[last:].tolist(), strict=True)), np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            got = np.fromiter((fingerprint(x, k) for x in batch.column(1).cast(pa.large_binary()).to_pylist()), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def links(found: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: every pair of distinct values of fp (long) that differ in max_bits bits or fewer."""
    if max_bits > 3:
        raise ValueError("the grid of two halves reaches 3 bits at most")
    fp = F.col("fp")

    def point(half):
        return half - F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(PAIRS_OF_BITS))

    halves = found.select("fp", F.posexplode(F.array(point(F.shiftrightunsigned(fp, 32)), point(fp.bitwiseAND(F.lit(0xFFFFFFFF))))).alias("half", "cell"))
    steps = F.array(F.lit(0).cast("long"), *[F.lit(1 << 2 * i) for i in range(16)])
    up = F.filter(steps, lambda s: (s == 0) | (F.col("cell").bitwiseAND(s * 3) != s * 2))
    seekers = halves.select(fp.alias("a"), "half", F.explode(F.transform(up, lambda s: F.col("cell") + s)).alias("cell"), F.col("cell").alias("own"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    once = (F.col("cell") != F.col("own")) | (F.col("a") < F.col("b"))
    return seekers.join(halves.select(fp.alias("b"), "half", "cell"), ["half", "cell"]).where(near & once).select("a", "b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (least node reachable) of every node of edges (a, b), by star contraction; a written table.

    Large star: every larger neighbour of a node links to the least of its neighbourhood. Small star:
    every smaller neighbour does. Both keep connectivity. Rounds end when links are stars around their least nodes: no node
    with a smaller neighbour has a second one. A round's first table tells so, and is then the result.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        both = now.union(now.select("b", "a")).toDF("a", "b")
        own = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), ((F.min("b") < F.col("a")) & (F.count("*") > 1)).alias("open"))
        own = written(own)
        if not own.agg(F.max("open")).first()[0]:
            return own.select(F.col("a").alias("node"), F.col("m").alias("component"))
        large = now.join(own.select(F.col("a").alias("b"), "m"), "b").select("a", F.col("m").alias("b"))
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("link"))
        now = written(small.select("link.a", "link.b").where("a <> b").distinct())
    raise RuntimeError("components did not settle")


def joined(reached: DataFrame, links: DataFrame) -> DataFrame:
    """reached (node, component of earlier links) with further links (a, b; a written table): only components that these join are
    contracted, not all links anew."""
    if not links.count():
        return reached
    between = links
    for side in ("a", "b"):
        between = between.join(reached.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    found = components(between.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    before = reached.join(found.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left")
    new = found.join(reached.select("node"), "node", "left_anti")
    return written(before.select("node", F.coalesce("now", "component").alias("component")).unionByName(new))


def groups(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    found = written(fingerprints(docs, k))
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    reached = components(written(links(distinct.select("fp"), max_bits)))
    named = distinct.join(reached.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return spread_join(found, ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of a step's texts (shorter texts: of all their words) and their rows, by row."""
    words, row, _ = word_hashes(data, off)
    sizes = np.bincount(row, minlength=len(off) - 1)
    found = [(h, row[at]) for h, at in [shingle_hashes(words, row, k)]]
    for few in range(1, k):
        of = sizes[row] == few
        hashes, at = shingle_hashes(words[of], row[of], few)
        found.append((hashes, row[of][at]))
    hashes, rows = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(rows, kind="stable")
    return hashes[order], rows[order]


def signatures(docs: DataFrame, k: int = STAGE_SHINGLE) -> DataFrame:
    """rid, fp, same_a and same_b (equal for texts of the same shingles), bands (a hash for each), least (a byte for each
    function) of every row of docs (rid, text); texts without words have no bands."""
    factors = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)

    def marks(texts):
        for lo, hi, data, off in text_steps(texts):
            hashes, rows = _shingles(data, off, k)
            least = np.zeros((hi - lo, len(factors)), np.uint64)
            same = np.zeros((hi - lo, 2), np.uint64)
            with_words, start = np.unique(rows, return_index=True)
            if len(start):
                for i, factor in enumerate(factors):
                    least[with_words, i] = np.minimum.reduceat(hashes * factor, start)
                for i in range(2):
                    same[with_words, i] = np.add.reduceat(mix(hashes ^ factors[i]), start)
            bands = np.zeros((hi - lo, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for i in range(BAND_ROWS):
                bands = mix(bands ^ least[:, i::BAND_ROWS])
            full = np.isin(np.arange(hi - lo), with_words)
            yield from zip(same[:, 0].view(np.int64), same[:, 1].view(np.int64), [b if f else [] for b, f in zip(bands.view(np.int64).tolist(), full, strict=True)], [x.tobytes() for x in (least >> np.uint64(56)).astype(np.uint8)], strict=True)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(x, k) for x in texts.to_pylist()), np.uint64, len(batch))
            rest = list(zip(*marks(batch.column(1)), strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            arrays = [pa.array(list(x), t) for x, t in zip(rest, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *arrays], names=["rid", "fp", "same_a", "same_b", "bands", "least"])

    return docs.select("rid", "text").mapInArrow(run, "rid long, fp long, same_a long, same_b long, bands array<long>, least binary")


def _agreeing(pairs: DataFrame) -> DataFrame:
    """a, b, equal of the pairs (a, b, x, y) whose signatures x and y agree in LEAST_EQUAL places or more."""
    width = BANDS * BAND_ROWS

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, width) for i in (2, 3))
            equal = (x == y).sum(axis=1)
            keep = np.flatnonzero(equal >= LEAST_EQUAL)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(equal[keep].astype(np.int64))], names=["a", "b", "equal"])

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, equal long")


def _sets(texts, k: int):
    """The sorted distinct shingle hashes of each text of an Arrow array."""
    for lo, hi, data, off in text_steps(texts):
        hashes, rows = _shingles(data, off, k)
        cuts = np.searchsorted(rows, np.arange(hi - lo + 1))
        yield from (np.unique(hashes[cuts[i] : cuts[i + 1]]) for i in range(hi - lo))


def _verified(pairs: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts' (rid, text) sets of shingles have a Jaccard similarity of least or more."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(_sets(batch.column(2), k), _sets(batch.column(3), k), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with scratch(texts.sparkSession, keep_last=True):
        pairs = written(pairs.select("a", "b"))
        if not pairs.count():
            return pairs
        one = written(spread_join(pairs, texts.select(F.col("rid").alias("b"), F.col("text").alias("y")), "b"))
        two = spread_join(one, texts.select(F.col("rid").alias("a"), F.col("text").alias("x")), "a")
        return written(two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _apart(dealt: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """The links among rows of dealt (key, rid, of) of the same key and different groups `of`.

    Keys of one group only need nothing. Others are cut into blocks of about BLOCK shingles, and each pair of blocks is a task's
    group; there, texts outside the most frequent group are held against all others through an index of shingles.
    """

    def hashed(batches):
        for batch in batches:
            found = list(_sets(batch.column(1), k))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["rid", "size", "shingles"])

    def tile(frame):
        sets = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
        sizes, of, rid, block = np.array([len(x) for x in sets]), frame["of"].to_numpy(), frame["rid"].to_numpy(), frame["block"].to_numpy()
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(column, kind="stable")]
        begin = np.concatenate([[0], np.cumsum(np.bincount(column))])
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        groups, count = np.unique(of, return_counts=True)
        a, b = [], []
        for r in np.flatnonzero(of != groups[np.argmax(count)]):
            holders = [owners[begin[c] : begin[c + 1]] for c in column[cuts[r] : cuts[r + 1]]]
            both = np.bincount(np.concatenate(holders), minlength=len(sets))
            hit = (both >= least * (sizes + sizes[r] - both)) & (of != of[r])
            if frame["i"].iat[0] != frame["j"].iat[0]:
                hit &= block != block[r]
            a += [rid[r]] * int(hit.sum())
            b += rid[hit].tolist()
        return pd.DataFrame({"a": np.minimum(a, b).astype(np.int64), "b": np.maximum(a, b).astype(np.int64)})

    open_keys = dealt.groupBy("key").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo <> hi").select("key")
    left = written(dealt.join(open_keys, "key", "left_semi"))
    if not left.count():
        return left.select(F.col("rid").alias("a"), F.col("rid").alias("b"))
    sets = written(texts.join(left.select("rid").distinct(), "rid").select("rid", "text").mapInArrow(hashed, "rid long, size long, shingles binary"))
    sized = left.join(sets.select("rid", "size"), "rid")
    blocks = written(sized.groupBy("key").agg(F.ceil(F.sum("size") / BLOCK).alias("blocks")))
    rows = spread_join(written(sized), blocks, "key").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.select("key", "rid", "of", "block", other.alias("other")).join(sets.select("rid", "shingles"), "rid")
    tiles = rows.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "rid", "of", "block", "shingles")
    return tiles.groupBy("key", "i", "j").applyInPandas(tile, "a long, b long").distinct()


def near_groups(texts: DataFrame, marks: DataFrame, k: int = STAGE_SHINGLE, least: float = STAGE_JACCARD) -> DataFrame:
    """node, component (its least rid) of marks' texts (rid) that have a link: what verified links of `least` or more connect."""
    by_fp = written(marks.groupBy("fp").agg(F.min("rid").alias("hub")))
    grid = links(by_fp.select("fp"))
    for side in ("a", "b"):
        grid = grid.join(by_fp.select(F.col("fp").alias(side), F.col("hub").alias(f"hub_{side}")), side)
    same_fp = spread_join(marks.select("fp", "rid"), by_fp, "fp").where("rid <> hub").select(F.col("hub").alias("a"), F.col("rid").alias("b"))
    first = written(grid.select(F.least("hub_a", "hub_b").alias("a"), F.greatest("hub_a", "hub_b").alias("b")).unionByName(same_fp))

    rows = written(marks.select("rid", F.explode("bands").alias("key")))
    turn = F.xxhash64("key")
    hubs = rows.groupBy("key").agg(F.min(F.col("rid").bitwiseXOR(turn)).alias("least"), F.count("*").alias("n")).where("n > 1")
    hubs = hubs.select("key", F.col("least").bitwiseXOR(turn).alias("a"))
    met = written(spread_join(rows, hubs, "key").where("rid <> a").select("a", F.col("rid").alias("b")).distinct())
    # texts that share nothing move once, to be left out; those that may be near move with their pairs
    wanted = [pairs.select(F.col(c).alias("rid")) for pairs in (met, first) for c in "ab"]
    texts = written(texts.join(reduce(DataFrame.union, wanted).distinct(), "rid", "left_semi"))
    bytes_of = marks.select("rid", "least")
    met = written(met.join(bytes_of.select(F.col("rid").alias("b"), F.col("least").alias("y")), "b"))
    met = written(_agreeing(spread_join(met, bytes_of.select(F.col("rid").alias("a"), F.col("least").alias("x")), "a")))
    best = met.groupBy("b").agg(F.max(F.struct("equal", "a"))["a"].alias("a")).select("a", "b")

    first = first.unionByName(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    reached = components(_verified(first, texts, k, least))

    # what meets in a band and is not connected yet: first with the bands' hubs, then each with each
    sides = met.select("a", "b")
    for side in ("a", "b"):
        sides = sides.join(reached.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    reached = joined(reached, _verified(sides.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")), texts, k, least))
    dealt = rows.join(reached.withColumnRenamed("node", "rid"), "rid", "left").select("key", "rid", F.coalesce("component", "rid").alias("of"))
    return joined(reached, written(_apart(written(dealt), texts, k, least)))


def stage(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each group the row of the least doc_id stays, with all its columns.

    A group is what links connect; a link is a Jaccard similarity of 0.8 or more of the sets of five-word shingles (words
    as above; shorter texts have one shingle, all texts without words are one group). Rows without a doc_id stay only if no row of their
    group has one. Of repeated rows one stays.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = written(docs.select(F.struct(*columns).alias("doc"), F.monotonically_increasing_id().alias("rid")))
    texts = keyed.select("rid", "doc.text")
    marks = written(signatures(texts))
    ids = keyed.select("rid", F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("doc_id"), "rid").alias("first"))
    distinct = marks.select("rid", "same_a", "same_b").join(ids, "rid").groupBy("same_a", "same_b").agg(F.min("first").alias("first"))
    distinct = written(distinct.select(F.col("first.rid").alias("rid"), "first"))
    reached = near_groups(texts, written(marks.join(distinct.select("rid"), "rid", "left_semi"))).withColumnRenamed("node", "rid")
    one = distinct.join(reached, "rid", "left").groupBy(F.coalesce("component", "rid").alias("of")).agg(F.min("first")["rid"].alias("rid"))
    return keyed.join(one.select("rid"), "rid", "left_semi").select("doc.*")
