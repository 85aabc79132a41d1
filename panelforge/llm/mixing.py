"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's expected copies of each document are target / source_size. Whole copies are certain. The
rest is a sample: a document of inclusion probability p gets the rank key (u / (1 - u)) / (p / (1 - p)),
with u uniform by its id; the smallest keys are taken until the source's remaining words are reached,
so the sample's size is fixed in words. One more document closes the gap where that comes nearer.

With a weight column, expected copies within a source are in proportion to it (held to max_repeats),
so inclusion probabilities differ within a source as well as between sources.

How it scales: one scan counts words and writes (doc_id, source, size). The rank keys fall into
about sqrt(n) buckets a source (by u, so evenly, where a source has one p; with a weight column by the key); sums by bucket find the bucket where the sample ends, and only that
bucket's rows are ordered. A source that holds a third of all rows is summed by parts like any other.

Defined cases: null and empty texts have size 0, are never sampled and get taken 0; null sources
are one source, the last; sources without words have target 0; rows with the same id and size are taken
one by one, rows alike in key, id and size in the order in which the table gives them; a very long text is one size like any other; columns
of the caller, whatever their names, are not read but for the weight; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Sources a broadcast may hold (some 100 bytes each); more are joined.
MAX_BROADCAST_SOURCES = 100_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """Adds target to (source, source_size): shares by repeating weights, held to max_repeats times the size.

    The level L at which the sum of least(cap, L * weight) is the total is found on sources ordered by
    cap / weight: those before the first that stays below its cap are full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    index = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    everything = Window.partitionBy()
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), index + 1).cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
        .withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(full), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(full), F.lit(0.0)))
        .withColumn("level", F.col("left_size") / F.col("left_weight"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))))
        .drop("cap", "weight", "left_size", "left_weight", "level", "fits")
    )


def uniform(doc_id):
    """A number in (0, 1) by the id, alike in every engine: 52 bits of its MD5."""
    return (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _looked_up(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """rows with the columns of table by source, null matching null."""
    right = table.withColumnRenamed("source", "source_")
    return rows.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")


def copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, weight: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs, and copies (how often it is taken)."""
    return _copies(_sized(docs, weight), weights, max_repeats, weight is not None).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def _sized(docs: DataFrame, weight: str | None) -> DataFrame:
    by = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(1e-9))
    return written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), by.alias("weight"), F.monotonically_increasing_id().alias("rid")))


def _copies(sized: DataFrame, weights: tuple[int, ...], max_repeats: int, weighted: bool) -> DataFrame:
    of_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.sum(F.col("size") * F.col("weight")).alias("weighted"))
    targets = written(with_targets(of_source, weights, max_repeats))
    small = targets.count() <= MAX_BROADCAST_SOURCES
    expected = F.least(F.when(F.col("weighted") > 0, F.col("weight") * F.col("target") / F.col("weighted")).otherwise(0.0), F.lit(float(max_repeats)))
    ranked = (
        _looked_up(sized, targets, small)
        .withColumn("expected", F.when(F.col("size") > 0, expected).otherwise(0.0))
        .withColumn("whole", F.floor("expected"))
        .withColumn("p", F.col("expected") - F.col("whole"))
        .withColumn("u", uniform(F.col("doc_id")))
        .withColumn("key", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
        # of one inclusion probability the keys stand in the order of u, which is even; else key / (1 + key) orders them
        .withColumn("spread", F.when(F.col("p") > 0, F.col("key") / (1 + F.col("key")) if weighted else F.col("u")))
        .withColumn("bucket", F.floor(F.col("spread") * F.ceil(F.sqrt("n"))))
    )
    sums = ranked.groupBy("source", "bucket").agg(F.sum(F.when(F.col("p") > 0, F.col("size"))).alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("target"))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        sums.withColumn("need", F.col("target") - F.sum("certain").over(Window.partitionBy("source")))
        .where("bucket is not null")
        .withColumn("before", F.coalesce(F.sum("words").over(by_bucket), F.lit(0)))
        .groupBy("source")
        .agg(F.first("need").alias("need"), F.max(F.when(F.col("before") <= F.col("need"), F.struct(F.col("bucket").alias("cut"), "before"))).alias("at"))
        .select("source", "need", "at.cut", "at.before")
    )
    cuts = written(cuts)
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "rid")
    ends = (
        _looked_up(ranked, cuts, small)
        .where("bucket = cut")
        .withColumn("sum", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where("sum <= need")
        .groupBy("source")
        .agg(F.max(F.struct("key", "doc_id", "size", "rid")).alias("end"), F.max("sum").alias("reached"))
    )
    bounds = cuts.join(ends.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")), "left").select("source", "need", "cut", "end", F.coalesce("reached", "before").alias("reached"))
    bounds = written(bounds)
    place = F.struct("key", "doc_id", "size", "rid")
    taken = (F.col("bucket") < F.col("cut")) | ((F.col("bucket") == F.col("cut")) & F.coalesce(place <= F.col("end"), F.lit(False)))
    chosen = _looked_up_left(ranked, bounds, small).withColumn("picked", F.coalesce((F.col("p") > 0) & taken, F.lit(False)))
    off = F.abs(F.col("size") - (F.col("need") - F.col("reached")))
    closing = (
        chosen.where((F.col("p") > 0) & ~F.col("picked") & (off < F.col("need") - F.col("reached")))
        .groupBy("source")
        .agg(F.min(F.struct(off.alias("off"), "key", "doc_id", "size", "rid"))["rid"].alias("closing"))
    )
    closing = written(closing)
    return _looked_up_left(chosen, closing, small).withColumn("copies", F.col("whole") + F.when(F.col("picked") | F.coalesce(F.col("rid") == F.col("closing"), F.lit(False)), 1).otherwise(0))


def _looked_up_left(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    right = table.withColumnRenamed("source", "source_")
    return rows.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, row_number() OVER () AS rid FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::DOUBLE AS cap, ((row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sized GROUP BY source),
lev AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER w, 0) AS left_size, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS left_weight
  FROM src WINDOW w AS (ORDER BY cap / weight, encode(source) ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
one AS (SELECT arg_min(left_size / left_weight, cap / weight) FILTER (left_size / left_weight * weight <= cap) AS level FROM lev),
tgt AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM src, one),
exp AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN size > 0 AND t.source_size > 0 THEN least(1.0::DOUBLE * target / t.source_size::DOUBLE, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS expected,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source),
rk AS (
  SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS p,
         CASE WHEN expected - floor(expected) > 0 THEN (u / (1 - u)) / ((expected - floor(expected)) / (1 - (expected - floor(expected)))) END AS key FROM exp),
need AS (SELECT source, any_value(target) - sum(whole * size)::DOUBLE AS need FROM rk GROUP BY source),
cum AS (
  SELECT rk.*, n.need, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY rk.source ORDER BY key NULLS LAST, doc_id, size, rid ROWS UNBOUNDED PRECEDING) AS upto
  FROM rk JOIN need n ON rk.source IS NOT DISTINCT FROM n.source),
pick AS (SELECT *, p > 0 AND upto <= need AS picked FROM cum),
gap AS (SELECT source, any_value(need) - coalesce(sum(size) FILTER (picked), 0)::DOUBLE AS gap FROM pick GROUP BY source),
cls AS (
  SELECT rid FROM (SELECT p.rid, row_number() OVER (PARTITION BY p.source ORDER BY abs(size - gap), key, doc_id, size, p.rid) AS k
  FROM pick p JOIN gap g ON p.source IS NOT DISTINCT FROM g.source WHERE p > 0 AND NOT picked AND abs(size - gap) < gap) WHERE k = 1)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN picked OR cls.rid IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken,
       (whole + CASE WHEN picked OR cls.rid IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS copies
FROM pick LEFT JOIN cls USING (rid)
"""
