"""Source divergence audit: how far the word use of each source is from its language's and from other sources', all in integers.

A term is a run of letters (ASCII ones, lower-cased, and every code point above U+007F). A language keeps the V terms of at least
`min_docs` of its documents. In a group of N kept occurrences a term with count c has the frequency p = 1 + floor(10^9 (c + 1) / (N + V)), and
p diverges from q by f(p, q) = floor((p - q)^2 / q).

Pairs of sources by a baseline-correction inverted index: each pair (g, h) starts at V times f of the two frequencies of count
zero, g0 and h0. Only postings correct it: a term of g adds f(p, h0) - f(g0, h0), a term of h adds f(g0, p) - f(g0, h0), and a
term of both adds f(p, p') - f(p, h0) - f(g0, p') + f(g0, h0) on top. The first two hang on the frequency alone, so a
group's terms of one frequency meet the other groups as one row with their number; only terms that two groups share are joined.

How it scales: each task counts terms by group before anything moves, in tables of FLUSH entries at most, so a source or a term on a third of all rows arrives as one
row from each of them. Postings are a row a group and term. Pairs of postings are added up where the join makes
them and leave as one row a pair of groups and task; a term of many sources is cut into blocks of BLOCK sources on one side. Term ranks are cut to the top before they move. Group
totals are broadcast up to MAX_GROUPS of them, and joined beyond.

Defined cases: null text, lang and source are empty strings; a group without kept terms takes part with count zero everywhere, and where a language keeps no
term every pair's value is 0; repeated rows and null ids are documents of their own; a very long text or term is counted whole; ties go to the
item that is less in UTF-8; an empty table gives an empty result; other columns, of any name, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, written

MIN_DOCS, TOP = 3, 200
#: Entries of a task's table of counts before it is sent on.
FLUSH = 200_000
#: Groups whose totals may be broadcast (some 100 bytes each).
MAX_GROUPS = 100_000
#: Sources of a term that one task joins with all of its sources.
BLOCK = 4096
#: a-z and all bytes of code points above U+007F stay; A-Z are lower-cased before.
_KEPT = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in UTF-8."""
    return (text or "").encode().lower().translate(_KEPT).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs summed over runs of rows; a null term for each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> pa.RecordBatch:
        keys, terms, n, docs = [], [], [], []
        for group, (times, texts) in held.items():
            keys += [group] * (len(times) + 1)
            terms += [None, *times]
            n += [0, *times.values()]
            docs += [0, *map(texts.__getitem__, times)]
        found = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*found, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            times, texts = held.setdefault((lang, source), (Counter(), Counter()))
            found = terms_of(text)
            times.update(found)
            texts.update(set(found))
        if sum(len(x) for x, _ in held.values()) > FLUSH:
            yield rows()
            held.clear()
    if held:
        yield rows()


def frequency(count: Column, of: Column) -> Column:
    """1 + floor(10^9 (count + 1) / of) by long division, three digits a step: no product leaves 64 bits while of < 9 * 10^15."""
    rest, out = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        wider = rest * 1000
        out = out * 1000 + _over(wider, of)
        rest = wider % of
    return out + 1


def _over(a: Column, b: Column) -> Column:
    """Whole quotient of two longs."""
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return _over((p - q) * (p - q), q)


def postings(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, postings): lang, source, v, n (kept occurrences), of (n + v), of_lang, zero (the frequency of count 0) of every group,
    and lang, source, term, p, q, zero of every kept term that a group has."""
    empty = F.lit("")
    own = [F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")]
    seen = docs.select(*own).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    seen = written(seen.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    term = Window.partitionBy("lang", "term")
    kept = seen.where("term is not null").select("*", F.sum("docs").over(term).alias("in_docs"), F.sum("n").over(term).alias("total"), (F.col("source") == F.min("source").over(term)).alias("leads"))
    kept = written(kept.where(F.col("in_docs") >= min_docs).drop("in_docs", "docs"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("leads").alias("led"))
    langs = sums.groupBy("lang").agg(F.sum("n").alias("of_lang"), F.sum("led").alias("v"))
    groups = seen.where("term is null").select("lang", "source").join(sums.drop("led"), ["lang", "source"], "left").join(langs, "lang", "left")
    none = F.lit(0).cast("long")
    groups = groups.select("lang", "source", F.coalesce("v", none).alias("v"), F.coalesce("n", none).alias("n"), F.coalesce("of_lang", none).alias("of_lang"))
    groups = groups.withColumn("of", F.col("n") + F.col("v")).withColumn("of_lang", F.col("of_lang") + F.col("v"))
    groups = written(groups.withColumn("zero", F.when(F.col("v") > 0, frequency(none, F.col("of")))))
    p, q = frequency(F.col("n"), F.col("of")), frequency(F.col("total"), F.col("of_lang"))
    weighed = kept.join(_maybe(groups.drop("n", "v")), ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q"), "zero")
    return groups, written(weighed)


def _maybe(groups: DataFrame) -> DataFrame:
    return F.broadcast(groups) if groups.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS else groups


def pairs(groups: DataFrame, posted: DataFrame) -> DataFrame:
    """lang, source, item, value of every ordered pair of a language's sources."""
    small = groups.select("lang", "source", "v", "zero")
    others = small.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    f = divergence
    zero, other, p = F.col("zero"), F.col("other"), F.col("p")
    base = small.join(_maybe(others), "lang").where("source <> item").select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * f(zero, other)).otherwise(0).alias("value"))

    # terms of one group: those of one frequency are one row with their number
    alike = written(posted.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("k")))
    met = alike.join(F.broadcast(others), "lang") if groups.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS else spread_join(alike, others, "lang")
    ahead = F.struct("source", "item", (F.col("k") * (f(p, other) - f(zero, other))).alias("value"))
    back = F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("k") * (f(other, p) - f(other, zero))).alias("value"))
    own = met.where("source <> item").select("lang", F.inline(F.array(ahead, back)))

    # terms of two groups
    blocks = -(-groups.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] // BLOCK)
    left = posted.select("lang", "term", "source", "p", "zero", F.pmod(F.xxhash64("source"), F.lit(max(1, blocks))).alias("block"))
    right = posted.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p_other"), F.col("zero").alias("other"), F.explode(F.expr(f"sequence(0L, {max(0, blocks - 1)}L)")).alias("block"))
    both = left.join(right, ["lang", "term", "block"]).where("source <> item")
    q = F.col("p_other")
    shared = both.groupBy("lang", "source", "item").agg(F.sum(f(p, q) - f(p, other) - f(zero, q) + f(zero, other)).alias("value"))
    own = own.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return base.unionByName(own).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def terms(posted: DataFrame) -> DataFrame:
    """lang, source, item, value of every term that a group has and uses more than its language."""
    return posted.where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` for every other source of the language, part `term` for the `top` terms."""
    groups, posted = postings(docs, min_docs)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), place.alias("rank"))
    return ranked(pairs(groups, posted), "pair").unionByName(ranked(terms(posted), "term").where(F.col("rank") <= top))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS size FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS size FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.size + l.v) AS p, 1 + (1000000000 * (k.total + 1)) // (l.size + l.v) AS q
  FROM g JOIN l USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
