"""URL filter: host and path rules first, then a Bloom filter cascade over the corpus's own hosts.

The cascade is exact on its key universe. Level 0 encodes the listed keys; level 1 the keys of the
universe that level 0 wrongly admits; level 2 the listed keys that level 1 wrongly admits, and so on
until a level admits no wrong key. A key's answer is the parity of the first level that rejects it.
Since every key that is asked is in the universe, no join is needed to look keys up.

The list is a table of hosts; one join with the distinct hosts of the corpus marks the members when the cascade
is built, and none is needed when pages are judged.

Everything is built and asked with DataFrame functions.

Defined cases: null urls and urls without `://` have an empty host and path, fit no rule, and are allowed unless the empty
key is listed; of rules that fit the longest (host and path together) wins, of equally long ones the last of the list; null and
repeated keys of the list count for nothing more; very long urls are parsed whole; repeated rows give repeated rows; other
columns, of any name, are not read; an empty table gives an empty result, an empty list blocks nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bits that a byte of a filter's table holds.
BYTE_BITS = 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule(rules: tuple, host_: Column, path_: Column, of) -> Column:
    """of(rule) for the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host_ == r[0]) | host_.endswith(f".{r[0]}")) & path_.startswith(r[1])
        out = F.when(fits, F.lit(of(r))).otherwise(out)
    return out


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    one = F.xxhash64(F.lit(f"a{level}"), key)
    two = F.xxhash64(F.lit(f"b{level}"), key)
    return [F.pmod(F.xxhash64(one, two, F.lit(i)), F.lit(bits)) for i in range(hashes)]


@dataclass(frozen=True)
class Cascade:
    """levels: (bits, hashes, table of 7 bits a byte) of each filter."""

    levels: tuple[tuple[int, int, bytes], ...]

    def contains(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(admits(self.levels[level], level, key), answer).otherwise(F.lit(level % 2 == 1))
        return F.lit(False) if not self.levels else answer


def admits(level: tuple[int, int, bytes], number: int, key: Column) -> Column:
    """Are all of the key's bits set? Seven bits a byte, so that ascii() reads a byte of the literal."""
    bits, hashes, table = level

    def is_set(at: Column) -> Column:
        byte = F.ascii(F.substring(F.lit(table), F.floor(at / BYTE_BITS).cast("int") + 1, F.lit(1)).cast("string"))
        return F.call_function("shiftright", byte, F.pmod(at, F.lit(BYTE_BITS)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return F.forall(F.array(*_positions(key, number, bits, hashes)), is_set)


def encode(keys: DataFrame, number: int, count: int, bits_per_key: float, hashes: int) -> tuple[int, int, bytes]:
    """One Bloom filter over the column `key`: positions, or-ed into bytes by aggregation."""
    bits = (int(count * bits_per_key) // BYTE_BITS + 9) * BYTE_BITS
    at = F.explode(F.array(*_positions(F.col("key"), number, bits, hashes)))
    found = (
        keys.select(at.alias("at"))
        .groupBy(F.floor(F.col("at") / BYTE_BITS).cast("int").alias("byte"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod("at", F.lit(BYTE_BITS)).cast("int"))).alias("set"))
    )
    table = bytearray(bits // BYTE_BITS)
    for r in found.collect():  # the filter itself: max_bits / 7 rows at most
        table[r.byte] = r.set
    return bits, hashes, bytes(table)


def cascade(universe: DataFrame, listed: Column, bits_per_key: float = 10.0, hashes: int = 5, max_bits: int = 1 << 22) -> Cascade | None:
    """The cascade for the distinct keys of `universe` (column key); listed says which are members.

    None if a filter would pass max_bits (0.6 MB as a literal): keys are then looked up by a join.
    """
    keys = written(universe.select("key", F.coalesce(listed, F.lit(False)).alias("listed")))
    levels: list[tuple[int, int, bytes]] = []
    inside, outside = keys.where("listed"), keys.where("not listed")
    while True:
        number = len(levels)
        count = inside.count()
        if not count:
            return Cascade(tuple(levels))
        if count * bits_per_key + 9 * BYTE_BITS > max_bits:
            return None
        levels.append(encode(inside, number, count, bits_per_key if number == 0 else 4.0, hashes if number == 0 else 2))
        wrong = outside.where(admits(levels[-1], number, F.col("key")))
        inside, outside = wrong, inside


#: A title is stuffed from so many separators on; a host is listed if such a share of its pages has one.
SEPARATORS, STUFFED_SHARE = 3, 0.02


def stuffed_hosts(pages: DataFrame) -> DataFrame:
    """The list of the registered query, a table of hosts: those where titles are lists of keywords.

    A host is listed for what its pages say, so nothing in its name gives it away. Pages without html or title count as ordinary.
    """
    title = F.regexp_extract(F.coalesce(F.col("html"), F.lit("")), r"(?s)<title>([^<]*)</title>", 1)
    stuffed = (F.regexp_count(title, F.lit(r" \| ")) >= SEPARATORS).cast("long")
    by_host = pages.select(host(F.col("url")).alias("host"), stuffed.alias("stuffed")).groupBy("host").agg(F.sum("stuffed").alias("stuffed"), F.count("*").alias("n"))
    return by_host.where((F.col("stuffed") > 0) & (F.col("stuffed") >= F.col("n") * F.lit(STUFFED_SHARE)) & (F.col("host") != "")).select("host")


def judge(pages: DataFrame, rules: tuple = RULES, listed: DataFrame | None = None, **options) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict, listed (is the host on the list).

    listed: a table whose first column is a host a row.
    """
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    hosts = parsed.select(F.col("host").alias("key")).distinct()
    if listed is None:
        universe = hosts.withColumn("listed", F.lit(False))
    else:
        members = listed.select(F.col(f"`{listed.columns[0]}`").cast("string").alias("key")).where("key is not null").distinct().withColumn("listed", F.lit(True))
        universe = hosts.join(members, "key", "left")
    found = cascade(universe, F.col("listed"), **options)
    if found is None:
        parsed = parsed.join(universe.where("listed").select(F.col("key").alias("host"), "listed"), "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        parsed = parsed.withColumn("listed", found.contains(F.col("host")))
    by_rule = rule(rules, F.col("host"), F.col("path"), lambda r: r[2])
    return parsed.select(
        "page_id",
        "host",
        "path",
        rule(rules, F.col("host"), F.col("path"), lambda r: r[0] + r[1]).alias("rule"),
        F.coalesce(by_rule, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed",
    )


SQL = r"""
WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
titles AS (SELECT translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(html, ''), '(?s)<title>([^<]*)</title>', 1) AS title FROM pages),
stuffed AS (SELECT host FROM (SELECT host, count(*) AS n, count(*) FILTER (len(regexp_extract_all(title, ' \| ')) >= 3) AS k FROM titles GROUP BY host) WHERE k > 0 AND k >= n * 0.02::DOUBLE AND host <> ''),
keyed AS (SELECT row_number() OVER () AS rid, *, host IN (SELECT host FROM stuffed) AS listed FROM parsed),
fit AS (
  SELECT rid, rh || rp AS rule, v,
         row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC) AS k
  FROM keyed JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict,
       listed
FROM keyed LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (rid)
"""
