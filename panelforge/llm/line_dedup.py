"""Line dedup: lines that spread over many distinct sites are boilerplate, and go.

A line is a stretch between line feeds, without surrounding spaces and tabs; its key is two 64-bit
hashes. A HyperLogLog sketch of its sites is built per line and merged by aggregation. Lines whose
estimate is far from the threshold are decided by it; lines near it get an exact distinct count.
Of each boilerplate line one occurrence stays (least doc_id, then least position), so no text is
lost from the corpus, and a page that was copied to many sites stays whole once.

How it scales: hashes of lines move, not lines, and sketches are merged before they move, so a line
on a third of all pages arrives as one sketch from each task. Boilerplate lines meet all lines as a broadcast up to
MAX_BROADCAST of them, and beyond by a join that deals frequent lines over tasks. Texts move once, to meet their list of
lines to drop; every step is linear in the lines of a text.

Threshold: min_sites (10 by default) distinct sites, whatever the length of the line. A line that is repeated within fewer
sites, however often, is not cross-site boilerplate and stays.

Defined cases: null and blank lines are never dropped; a null text stays null; a null site counts as
one site; rows of the same id and text are one document and are cleaned alike; of a line's equal places the
least by (doc_id, hash of the text, position) stays; a document whose every line goes keeps an empty text
in `spread` and leaves in `stage`, also where only blank lines are left; a very long text or line is hashed and cleaned whole; an
empty table gives an empty result; other columns of any name are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written

#: log2 of a sketch's size; its relative standard error is about 0.8 / sqrt(2 ** 10) = 2.6 %.
SKETCH_LOG = 10
#: Estimates within this share of the threshold are counted exactly: ten standard errors.
NEAR = 0.26
#: Boilerplate lines (some 60 bytes each) that a broadcast may hold.
MAX_BROADCAST = 200_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def without(lines: Column, drop: Column) -> Column:
    """The lines but for the places in drop, as a text: kept places by a hash set, each line by its place."""
    # the array of one struct names both arrays, so that they are made once and not for every line
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    both = F.array(F.struct(lines.alias("lines"), kept.alias("kept")))
    return F.array_join(F.element_at(F.transform(both, lambda x: F.transform(x["kept"], lambda at: F.get(x["lines"], at))), 1), "\n")


def _keys(text: Column) -> Column:
    """Of each line: two hashes, null if it is blank."""

    def key(line: Column) -> Column:
        bare = F.trim(line, F.lit(" \t\r"))
        return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("second"), bare).alias("b")))

    return F.transform(lines_of(text), key)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), site, pos, key of every line that is not blank."""
    site = F.coalesce(F.col("source").cast("string"), F.lit("\0"))
    # the text is hashed before its lines become rows, not once a line
    hashed = docs.select("doc_id", site.alias("site"), F.xxhash64("text").alias("row"), "text")
    # outer: the plain form makes the optimizer test the array's size first, and so make it twice
    return hashed.select("doc_id", "site", "row", F.posexplode_outer(_keys(F.col("text"))).alias("pos", "key")).where("key is not null")


def spread_lines(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """key, first (the occurrence that stays) and sites of every line on min_sites distinct sites or more."""
    lines = _lines(docs)
    sketched = lines.groupBy("key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_LOG))).alias("sites"),
        F.min(F.struct("doc_id", "row", "pos")).alias("first"),
    )
    likely = sketched.where(F.col("sites") >= min_sites * (1 - NEAR))
    sure = likely.where(F.col("sites") > min_sites * (1 + NEAR))
    near = likely.where(F.col("sites") <= min_sites * (1 + NEAR)).select("key", "first")
    # a line and its sites, once from each task: a frequent line is a few rows before it meets the join
    exact = lines.select("key", "site").distinct().join(near.select("key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.select("key", "first", "sites").unionByName(near.join(exact, "key").select("key", "first", "sites"))


def clean(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """doc (all columns of docs, as a struct with the cleaned text), lines, removed (how many lines the text had and lost).

    The caller's columns stay within the struct, so that none can clash with a helper's name.
    """
    boilerplate = written(spread_lines(docs, min_sites)).select("key", "first")
    lines = _lines(docs).drop("site")
    small = boilerplate.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    met = lines.join(F.broadcast(boilerplate), "key") if small else spread_join(lines, boilerplate, "key")
    drop = met.where(~F.struct("doc_id", "row", "pos").eqNullSafe(F.col("first"))).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("drop"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64("text").alias("own"))
    joined = own.join(drop, F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("row")), "left").select("doc", "drop")
    before = F.col("doc.text")
    text = F.when(F.col("drop").isNull(), before).otherwise(without(lines_of(before), F.col("drop")))
    return joined.select(
        F.col("doc").withField("text", text).alias("doc"),
        F.when(before.isNull(), 0).otherwise(F.size(lines_of(before))).cast("long").alias("lines"),
        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("removed"),
    )


def spread(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """doc_id, lines, removed, text (cleaned) of every row."""
    return clean(docs.select("doc_id", "source", "text"), min_sites).select("doc.doc_id", "lines", "removed", "doc.text")


def stage(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """docs with cleaned texts and all their columns; n_chars, where there, follows the text.

    Documents that lost lines and have no words left (blank lines are none) are boilerplate only, and go.
    """
    found = clean(docs, min_sites).where((F.col("removed") == 0) | F.col("doc.text").rlike(r"[^\x20\x09-\x0D]"))
    doc = F.col("doc")
    if "n_chars" in docs.columns:
        length = F.length("doc.text").cast(docs.schema["n_chars"].dataType)
        doc = doc.withField("n_chars", F.when(F.col("removed") == 0, F.col("doc.n_chars")).otherwise(length))
    return found.select(doc.alias("doc")).select("doc.*")


SQL = r"""
WITH lines AS (
  SELECT rid, doc_id, coalesce(source, chr(1)) AS site, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS bare
  FROM (SELECT row_number() OVER () AS rid, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
bad AS (SELECT bare, min({'d': doc_id, 'r': rid, 'p': pos}) AS first FROM lines WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= 10),
marked AS (SELECT l.*, bad.first IS NOT NULL AND NOT (l.doc_id = first.d AND l.rid = first.r AND l.pos = first.p) AS gone FROM lines l LEFT JOIN bad USING (bare))
SELECT doc_id, count(*)::BIGINT AS lines, count(*) FILTER (gone)::BIGINT AS removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM marked GROUP BY rid, doc_id
"""
