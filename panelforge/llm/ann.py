"""Nearest neighbours by a block matrix join of int8 tiles, exact in the end.

Equal vectors are one class, named by a 128-bit hash of their components. Queries and classes are dealt into
blocks; a tile is one block of queries against one block of classes. A vector x is x' + e, with x' = scale * int8
codes and the error norm |e| known. A tile's product of codes (exact in float32 while dim < 1040, float64
beyond) gives |x' - y'|, and the true distance is within |e_x| + |e_y| of it, and room for the rounding of doubles.
Per query, the k-th least upper bound, of each tile and then of all tiles, rules out every class whose lower
bound is above it; the pairs that survive are computed anew in double precision from the original vectors,
and heaps by query merge them to its k best rows.

How it scales: only codes (a byte a component), scales and error norms are dealt to tiles; the originals move once, to
meet the surviving pairs. A tile holds at most about q_block + v_block vectors however large the table; the
queries move once for every block of classes and the classes once for every block of queries. A vector that
a third of all rows share is one class, counted before anything moves, and of a class no query needs more
than the k + 1 least ids, k rows of each (it sets aside one id, its own). Heaps take the rows query by query.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null
vec_id; vectors of different lengths are never compared; a repeated vec_id is as many candidates as it has
rows but a query once (of different vectors the one of least hash), and never its own candidate; a query with
fewer than k candidates gets them all; ties go to the smaller vec_id; very long vectors are compared whole, those whose
squares overflow by their exact distance alone; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What rounding may add to the square of a distance, as a share of both squared norms.
ROUNDING = 16 * np.finfo(np.float64).eps


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and error norms (with room for rounding)."""
    top = np.abs(x).max(axis=1)
    scale = np.where(top > 0, top / 127.0, 1.0)
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error * (1 + 1e-9) + 1e-9 * top * math.sqrt(x.shape[1])


def bounds(q: tuple[np.ndarray, ...], v: tuple[np.ndarray, ...], excluded: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query place, vector place, lower, upper) of the pairs that the k-th least upper bound of each query leaves.

    q, v: codes, scales and error norms; excluded(i, j): does query i set vector j aside.
    """
    (q_codes, q_scale, q_error), (v_codes, v_scale, v_error) = q, v
    exact = np.float32 if q_codes.shape[1] < 1040 else np.float64
    right = v_codes.astype(exact).T
    v_norm = (v_codes.astype(np.float64) ** 2).sum(axis=1) * v_scale**2
    q_norm = (q_codes.astype(np.float64) ** 2).sum(axis=1) * q_scale**2
    parts, step = [], max(1, min(256, (1 << 21) // max(1, len(v_scale))))
    for lo in range(0, len(q_scale), step):
        hi = min(lo + step, len(q_scale))
        both = q_norm[lo:hi, None] + v_norm[None, :]
        with np.errstate(over="ignore", invalid="ignore"):
            square = both - 2.0 * (q_codes[lo:hi].astype(exact) @ right) * (q_scale[lo:hi, None] * v_scale[None, :])
            near = np.sqrt(np.maximum(square, 0.0))
            slack = q_error[lo:hi, None] + v_error[None, :] + np.sqrt(ROUNDING * both) + 1e-6 * near
            known = np.isfinite(near) & np.isfinite(slack)
            upper, lower = np.where(known, near + slack, np.inf), np.where(known, near - slack, 0.0)
        aside = excluded(np.arange(lo, hi)[:, None], np.arange(len(v_scale))[None, :])
        upper, lower = np.where(aside, np.inf, upper), np.where(aside, np.inf, lower)
        bound = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(v_scale) > k else np.full(hi - lo, np.inf)
        row, at = np.nonzero((lower <= bound[:, None]) & ~aside)
        parts.append((row + lo, at, lower[row, at], upper[row, at]))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, summed component by component."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += (a[:, j] - b[:, j]) ** 2
    return np.sqrt(total)


def _coded(rows: DataFrame) -> DataFrame:
    """vec_id, dim, a, b, and codes, scale, error of every row of (vec_id, dim, a, b, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(4)
            values = np.asarray(column.flatten(), np.float64)
            size = batch.column(1).to_numpy()
            begin = np.cumsum(size) - size
            codes: list[bytes] = [b""] * len(batch)
            scale, error = np.zeros(len(batch)), np.zeros(len(batch))
            for dim in np.unique(size):
                of = np.flatnonzero(size == dim)
                found, scale[of], error[of] = quantise(values[begin[of][:, None] + np.arange(dim)[None, :]])
                for i, c in zip(of.tolist(), found, strict=True):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(codes, pa.binary()), pa.array(scale), pa.array(error)], names=["vec_id", "dim", "a", "b", "codes", "scale", "error"])

    return rows.mapInArrow(run, "vec_id long, dim int, a long, b long, codes binary, scale double, error double")


def _side(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    codes = np.frombuffer(b"".join(pdf["codes"]), np.int8).reshape(len(pdf), -1)
    return codes, pdf["scale"].to_numpy(), pdf["error"].to_numpy()


def _by_query(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One frame a query, of batches in the order of query_id."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        ids = batch["query_id"].to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if held and held[0]["query_id"].iloc[0] != ids[lo]:
                yield pd.concat(held)
                held = []
            held.append(batch.iloc[lo:hi])
    if held:
        yield pd.concat(held)


def survivors(rows: DataFrame, n: int, n_queries: int, k: int, q_block: int, v_block: int) -> DataFrame:
    """query_id, a, b of the classes that may hold one of a query's k nearest rows."""
    least = 2 * rows.sparkSession.sparkContext.defaultParallelism
    v_blocks, q_blocks = max(1, min(least, n // 256), math.ceil(n / v_block)), max(1, math.ceil(n_queries / q_block))
    code = ("codes", "scale", "error")
    plain = ("vec_id", "dim", "a", "b", "embedding")
    classes = _coded(rows.select(*plain)).groupBy("dim", "a", "b").agg(*[F.first(c).alias(c) for c in code], F.when(F.min("vec_id") == F.max("vec_id"), F.min("vec_id")).alias("only"))
    queries = _coded(rows.where("is_query").select(*plain)).groupBy("vec_id").agg(F.min_by(F.struct("dim", *code), F.struct("a", "b")).alias("x")).select("vec_id", "x.*")
    dealt_v = classes.select("dim", F.pmod(F.xxhash64("a", "b"), F.lit(v_blocks)).alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), "a", "b", "only", *code)
    dealt_q = queries.select("dim", F.explode(F.expr(f"sequence(0L, {v_blocks - 1}L)")).alias("vb"), F.pmod(F.xxhash64(F.lit("q"), "vec_id"), F.lit(q_blocks)).cast("int").alias("qb"), "vec_id", *code)

    def one_tile(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "lower": pd.Series(dtype="float64"), "upper": pd.Series(dtype="float64")})
        ids, only, sole = q["vec_id"].to_numpy(), v["only"].fillna(0).to_numpy(np.int64), v["only"].notna().to_numpy()
        row, at, lower, upper = bounds(_side(q), _side(v), lambda i, j: (ids[i] == only[j]) & sole[j], k)
        return pd.DataFrame({"query_id": ids[row], "a": v["a"].to_numpy()[at], "b": v["b"].to_numpy()[at], "lower": lower, "upper": upper})

    def thinned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _by_query(batches):
            upper = pdf["upper"].to_numpy()
            bound = np.partition(upper, k - 1)[k - 1] if len(upper) > k else np.inf
            yield pdf.loc[pdf["lower"].to_numpy() <= bound, ["query_id", "a", "b"]]

    key = ["dim", "vb", "qb"]
    tiles = dealt_q.groupBy(*key).cogroup(dealt_v.groupBy(*key)).applyInPandas(one_tile, "query_id long, a long, b long, lower double, upper double")
    return tiles.repartition("query_id").sortWithinPartitions("query_id").mapInPandas(thinned, "query_id long, a long, b long")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, q_block: int = 8192, v_block: int = 65536) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of `vectors` (vec_id, embedding) for each query."""
    x = F.col("embedding")
    usable = (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(F.coalesce(usable, F.lit(False)))
    rows = rows.select("vec_id", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit("second"), "embedding").alias("b"), "embedding", "is_query")
    n, n_queries = vectors.select(F.count("*"), F.count_if(is_query)).first()
    near = survivors(rows, n, n_queries, k, q_block, v_block)
    # one vector of each class; its k + 1 least ids and how many rows of each may matter
    one = rows.groupBy("a", "b").agg(F.first("embedding").alias("v"))
    least = Window.partitionBy("a", "b").orderBy("vec_id")
    members = rows.groupBy("a", "b", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n")).withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1)
    q = rows.where("is_query").groupBy(F.col("vec_id").alias("query_id")).agg(F.min_by("embedding", F.struct("a", "b")).alias("q"))
    score = F.sqrt(F.aggregate(F.zip_with("q", "v", lambda s, t: (s - t) * (s - t)), F.lit(0.0), lambda s, t: s + t))
    exact = near.join(one, ["a", "b"]).join(q, "query_id").select("query_id", "a", "b", score.alias("score"))
    pairs = exact.join(members, ["a", "b"]).where("vec_id <> query_id").select("query_id", "score", "vec_id", "n")

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _by_query(batches):
            rows_ = ((s, i) for s, i, n in zip(pdf["score"].tolist(), pdf["vec_id"].tolist(), pdf["n"].tolist(), strict=True) for _ in range(n))
            best = heapq.nsmallest(k, rows_)
            yield pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "rank": np.arange(1, len(best) + 1, dtype=np.int32), "vec_id": np.array([i for _, i in best], np.int64), "score": np.array([s for s, _ in best], np.float64)})

    return pairs.repartition("query_id").sortWithinPartitions("query_id").mapInPandas(merged, "query_id long, rank int, vec_id long, score double")


SQL = r"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - v.e[i]) * (q.e[i] - v.e[i])), lambda a, b: a + b)) AS score
  FROM (SELECT DISTINCT ON (vec_id) * FROM v WHERE vec_id % 100 = 0) q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""
