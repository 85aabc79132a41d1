"""What the operators share: written intermediate tables and numpy text kernels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes of text that one numpy step takes; one longer text is a step of its own.
STEP_BYTES = 2 << 20


_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, one process (a local master, as in tests) takes a folder of
    its own; a cluster must name one, since a driver's own disk is not its executors'."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='panelforge-')}"
        sc.setCheckpointDir(found)
    return found


def written(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and lost executors lose nothing.

    The table goes at the end of a `scratch` block around it, or else when the driver's JVM ends.
    """
    spark = spark or df.sparkSession
    path = f"{shared_folder(spark)}/panelforge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, system = _located(spark, path)
    system.deleteOnExit(at)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def scratch(spark: SparkSession, keep_last: bool = False):
    """With keep_last, the table written last stays. Tables that operators write within the block go at its end: a long-lived driver wraps each job whose result it saves."""
    before = len(_tables)
    try:
        yield
    finally:
        kept = [_tables.pop()] if keep_last and len(_tables) > before else []
        while len(_tables) > before:
            at, system = _located(spark, _tables.pop())
            system.delete(at, True)
        _tables.extend(kept)


#: A key is frequent if it holds over 4096 rows and over one in this many of all: no more keys than this can be.
FREQUENT_KEYS = 100_000


def spread_join(many: DataFrame, one: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """many joined to one by key, where a key may hold a third of many's rows: frequent keys are dealt over `salts` tasks.

    many is read three times, so it should be a written table or small.
    """
    least = max(4096, many.count() // FREQUENT_KEYS)
    # a broadcast of FREQUENT_KEYS rows at most, by the definition of the bound
    often = F.broadcast(many.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > least).select(key, F.lit(True).alias("often")))
    dealt = F.when(F.col("often"), F.pmod(F.xxhash64(*many.columns), F.lit(salts))).otherwise(F.lit(0)).cast("long")
    everywhere = F.when(F.col("often"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    left = many.join(often, key, "left").select(*many.columns, dealt.alias("salt"))
    right = one.join(often, key, "left").select(*one.columns, F.explode(everywhere).alias("salt"))
    return left.join(right, [key, "salt"]).drop("salt")


def filtered(docs: DataFrame, run) -> DataFrame:
    """docs through mapInArrow by `run`, which keeps the columns; their names, which may hold dots, are set aside for it."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_codes(separators: bytes) -> np.ndarray:
    """A 64-bit code per byte, A-Z as a-z, 0 for separators."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    codes[65:91] = codes[97:123]
    codes[np.frombuffer(separators, np.uint8)] = 0
    return codes


WORDS = byte_codes(WHITESPACE)
#: Also every ASCII byte that is no letter and no digit ends a word.
PLAIN = byte_codes(bytes(b for b in range(128) if not chr(b).isalnum()))
_ODD = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, STEP_BYTES)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def text_steps(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts, about limit bytes each; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_hashes(data: np.ndarray, off: np.ndarray, codes: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of a step: a 64-bit hash, the row of its text within the step, its first byte."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none.astype(np.uint64), none, none
    value = codes[data]
    inside = value != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = off[:-1][off[:-1] < len(data)]
    first[begins] = inside[begins]
    start = np.flatnonzero(first)
    if not len(start):
        return none.astype(np.uint64), none, none
    up, down = _power_tables(len(data))
    value *= up[: len(data)]
    hashes = mix(np.add.reduceat(value, start) * down[start])
    return hashes, np.searchsorted(off, start, "right") - 1, start


def shingle_hashes(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words within one text, and the index of its first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    out = words[at]
    for j in range(1, k):
        out = mix(out * np.uint64(_ODD) + words[at + j])
    return out, at


def per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n)
