"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosines, distributed components.

A table hashes a vector to the signs of its products with `bits` random hyperplanes. Two vectors at an angle t agree
in one sign with the chance 1 - t / pi, so in all signs of a table with that to the power of bits, and some table
of enough independent ones brings together all but `miss` of the pairs at the threshold (fewer above it).
Vectors of one bucket are compared by their exact cosine: float32 products decide where they are farther from the
threshold than their rounding, double precision on the original components decides the rest. A pair that shares several tables is counted in the first only, as
each vector carries its keys of all tables.

How it scales: equal vectors are one class, counted before anything moves. The number of signs follows the number of classes, so a bucket
holds about BUCKET unrelated ones however large the table; the number of tables follows from the signs and `miss`. Buckets
of one member end before vectors move. A bucket of many near copies is cut into blocks of BLOCK, each pair of blocks a
task's group. What a group returns is a row a member: the number of its links, and one link of a spanning forest; pairs
never leave it. Vectors move once for each table and block. Components come from star contraction over written tables.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components has no links and is its own component;
vectors of different lengths are never linked; rows are vectors of their own, also where a vec_id repeats; rows with a null vec_id count as links, and a component has
the least vec_id of its rows that have one; components of very large or small values are scaled before they are squared; an
empty table gives an empty result; other columns, of any name, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, spread_join, written
from .simhash import components

LEAST, SEED = 0.95, 42
#: Unrelated vectors of a bucket, about; and members of a block of a larger one.
BUCKET, BLOCK = 256, 8192
#: The chance that two vectors at the threshold meet in no table.
MISS = 1e-6
MAX_BITS = 32


def parameters(n: int, least: float = LEAST, miss: float = MISS) -> tuple[int, int]:
    """Signs of a table and number of tables for n different vectors."""
    if not 0 < least <= 1:
        raise ValueError(f"the least cosine is above 0 and at most 1, not {least}")
    bits = min(MAX_BITS, max(8, math.ceil(math.log2(max(n, 1) / BUCKET))))
    meet = min((1 - math.acos(least) / math.pi) ** bits, 1 - 1e-9)
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-meet)))


def _coded(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """cid, dim, m, e (the components' bytes), keys (a table's signs each, as bytes), buckets of every class (cid, dim, m, embedding)."""
    wide = np.dtype(np.uint16 if bits <= 16 else np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            values, size = np.asarray(batch.column(3).flatten()), batch.column(1).to_numpy()
            begin = np.cumsum(size) - size
            raw, keys = [b""] * len(batch), np.zeros((len(batch), tables), wide)
            for dim in np.unique(size):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, dim]).normal(size=(dim, tables * bits))
                of = np.flatnonzero(size == dim)
                own = values[begin[of][:, None] + np.arange(dim)[None, :]]
                unit = own.astype(np.float64) / np.abs(own).max(axis=1, keepdims=True)
                for lo in range(0, len(of), 512):
                    signs = unit[lo : lo + 512] @ planes[dim] > 0
                    keys[of[lo : lo + 512]] = signs.reshape(-1, tables, bits) @ weights
                for i, x in zip(of.tolist(), own, strict=True):
                    raw[i] = x.tobytes()
            spread = mix((keys.astype(np.uint64) << np.uint64(16)) + np.arange(tables, dtype=np.uint64)[None, :]) + size.astype(np.uint64)[:, None]
            buckets = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * tables, mix(spread).view(np.int64).ravel())
            packed = pa.array([x.tobytes() for x in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(raw, pa.binary()), packed, buckets], names=["cid", "dim", "m", "e", "keys", "buckets"])

    return classes.select("cid", "dim", "m", "embedding").mapInArrow(run, "cid long, dim int, m long, e binary, keys binary, buckets array<long>")


def linked(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and of y (scaled to a largest component of 1) whose cosine is least or more."""
    norms = [np.sqrt((v * v).sum(axis=1)) for v in (x, y)]
    near = (x / norms[0][:, None]).astype(np.float32) @ (y / norms[1][:, None]).astype(np.float32).T
    room = (x.shape[1] + 16) * 1.2e-7
    a, b = np.nonzero(near >= least - room)
    open_ = np.flatnonzero(near[a, b] < least + room)
    if len(open_):
        exact = np.zeros(len(open_))
        for j in range(x.shape[1]):
            exact += x[a[open_], j] * y[b[open_], j]
        fine = np.ones(len(a), bool)
        fine[open_] = exact / (norms[0][a[open_]] * norms[1][b[open_]]) >= least
        a, b = a[fine], b[fine]
    return a, b


def joined_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root (each member's least known equal, compressed) after the links a to b."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def _tile(kind: np.dtype, wide: np.dtype, least: float):
    """Links of one bucket's pair of blocks, as a row a member: cid, root (of its tree), links (rows it links with)."""

    def run(table: pa.Table) -> pa.Table:
        cid, m, block = (table[c].to_numpy() for c in ("cid", "m", "block"))
        order = np.argsort(block, kind="stable")
        cid, m, block = cid[order], m[order], block[order]
        raw, packed = table["e"].to_pylist(), table["keys"].to_pylist()
        x = np.frombuffer(b"".join([raw[i] for i in order]), kind).reshape(len(cid), -1).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        keys = np.frombuffer(b"".join([packed[i] for i in order]), wide).reshape(len(cid), -1)
        t, alone = table["t"][0].as_py(), table["i"][0] == table["j"][0]
        cut = len(cid) if alone else int(np.searchsorted(block, table["i"][0].as_py(), "right"))
        many = np.zeros(len(cid))
        root = np.arange(len(cid))
        for lo in range(0, cut, 256):
            hi = min(lo + 256, cut)
            from_ = lo if alone else cut
            a, b = linked(x[lo:hi], x[from_:], least)
            a, b = a + lo, b + from_
            # each pair once, and in the first table that it shares
            own = (keys[a, t] == keys[b, t]) & (a < b)
            a, b = a[own], b[own]
            for at in range(0, len(a), 1 << 18):
                some = slice(at, at + (1 << 18))
                p, q = a[some], b[some]
                first = ~(keys[p, :t] == keys[q, :t]).any(axis=1)
                p, q = p[first], q[first]
                many += np.bincount(p, m[q], len(cid)) + np.bincount(q, m[p], len(cid))
                root = joined_roots(root, p, q)
        held = np.flatnonzero(many)
        return pa.table({"cid": pa.array(cid[held], pa.int64()), "root": pa.array(cid[root[held]], pa.int64()), "links": pa.array(many[held].astype(np.int64))})

    return run


def groups(vectors: DataFrame, least: float = LEAST, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding)."""
    x = F.col("embedding")
    usable = (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0)
    fine = F.coalesce(usable, F.lit(False))
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    # plus zero: minus zero is the same component
    plain = F.transform(x.cast("array<float>" if single else "array<double>"), lambda c: c + F.lit(0.0).cast("float" if single else "double"))
    own = F.struct(F.size("e").alias("dim"), F.xxhash64("e").alias("a"), F.xxhash64(F.lit("second"), "e").alias("b"))
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), plain.alias("e")).select("vec_id", own.alias("own"), "e")
    classes = rows.groupBy("own").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"), F.first("e").alias("embedding"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "own", "own.dim", "m", "least", "embedding"))
    bits, tables = parameters(classes.count(), least, miss)
    kind, wide = np.dtype(np.float32 if single else np.float64), np.dtype(np.uint16 if bits <= 16 else np.uint32)

    coded = written(_coded(classes, bits, tables))
    keyed = coded.select("cid", F.posexplode("buckets").alias("t", "bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    dealt = spread_join(keyed, written(sizes), "bucket").join(coded.drop("buckets"), "cid")
    block, other = F.pmod(F.xxhash64("cid"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.select("bucket", "dim", "t", "cid", "m", "e", "keys", block.alias("block"), other.alias("other"))
    tiles = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    found = written(tiles.groupBy("bucket", "dim", "t", "i", "j").applyInArrow(_tile(kind, wide, least), "cid long, root long, links long"))

    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
    named = classes.select("cid", "own", "m", "least").join(links, "cid", "left").join(reached, "cid", "left").withColumn("of", F.coalesce("component", "cid"))
    ids = named.groupBy("of").agg(F.min("least").alias("component_id"))
    told = named.join(ids, "of").select("own", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    whole = spread_join(written(rows.select("vec_id", "own")), written(told), "own").select("vec_id", "n_links", "component_id")
    lone = vectors.where(~fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return whole.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = r"""
WITH RECURSIVE v AS (
  SELECT rid, vec_id, fine, CASE WHEN fine THEN embedding::DOUBLE[] ELSE [1.0::DOUBLE] END AS e FROM (SELECT row_number() OVER () AS rid, vec_id, embedding,
    coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS fine FROM embeddings)),
links AS (SELECT a.rid AS a, b.rid AS b FROM v a JOIN v b ON a.fine AND b.fine AND a.rid <> b.rid AND len(a.e) = len(b.e) AND CASE WHEN a.fine AND b.fine AND len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 END),
reach AS (SELECT rid, rid AS other FROM v UNION SELECT r.rid, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT r.rid, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.rid = r.other GROUP BY r.rid),
degree AS (SELECT a AS rid, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN least USING (rid) LEFT JOIN degree USING (rid)
"""
