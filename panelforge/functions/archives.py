"""Nested archives compared value by value: JSON records as VARIANT, unfolded level by level to typed paths.

A record's text is parsed once. Each level of nesting is one `variant_explode`, so the plan has as many as the deepest record has levels; rows
that are values already pass through. What remains is a table of nodes, which a full join compares by record and path; the cost follows the
number of values, and records are spread like any other rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that may differ between runs of the same study.
VOLATILE = ("generated_at", "runtime_seconds", "fetched_at", "git", "environment")
#: Levels of nesting that a record may have.
MAX_DEPTH = 64


def depth(texts: DataFrame, body: str = "body") -> int:
    """Levels of the deepest record: brackets outside of strings, counted in one pass."""
    bare = F.regexp_replace(F.regexp_replace(body, r'"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]{}]", "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, c: Column) -> Column:
        now = state["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    found = texts.agg(F.max(F.aggregate(F.split(bare, ""), zero, step, lambda s: s["most"]))).first()[0] or 0
    if found > MAX_DEPTH:
        raise ValueError(f"a record has {found} levels; {MAX_DEPTH} are allowed")
    return found


def _kind(v: Column) -> Column:
    name = F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)
    return F.when(name == "OBJECT", "object").when(name == "ARRAY", "list").when(name == "VOID", "null").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").otherwise("number")


def _described(v: Column, path: Column) -> Column:
    """path, kind, number (of a list: its length) and text of a node; objects have neither."""
    kind = _kind(v)
    number = F.when(kind == "number", F.try_variant_get(v, "$", "double")).when(kind == "list", F.size(F.try_variant_get(v, "$", "array<variant>")).cast("double"))
    text = F.when(kind.isin("string", "boolean"), F.try_variant_get(v, "$", "string"))
    return F.struct(path.alias("path"), kind.alias("kind"), number.alias("number"), text.alias("text"))


def nodes(archive: DataFrame, volatile: Sequence[str] = VOLATILE) -> DataFrame:
    """record, path, kind, number, text, above (paths of the nodes that hold it) of every node of an archive (record, body as JSON).

    Paths are keys after slashes and places in brackets: /years[0]/total. Volatile keys go with all they hold. A body that is no JSON is an error;
    a null body is a record without nodes.
    """
    levels = depth(archive)
    rows = archive.where("body is not null").select("record", F.lit("").alias("path"), F.parse_json("body").alias("v"))
    rows = rows.withColumn("holders", F.array().cast("array<struct<path: string, kind: string, number: double, text: string>>"))
    for _ in range(levels):
        inside = rows.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).select(F.col("pos"), F.col("key"), F.col("value"))
        rows = rows.lateralJoin(inside)
        if volatile:
            rows = rows.where(F.col("key").isNull() | ~F.col("key").isin(*volatile))
        leaf = F.col("pos").isNull()
        step = F.when(F.col("key").isNotNull(), F.concat("path", F.lit("/"), "key")).otherwise(F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        rows = rows.select(
            "record",
            F.when(leaf, F.col("path")).otherwise(step).alias("path"),
            F.when(leaf, F.col("v")).otherwise(F.col("value")).alias("v"),
            F.when(leaf, F.col("holders")).otherwise(F.array_append("holders", _described(F.col("v"), F.col("path")))).alias("holders"),
        )
    # an object or list stands once in each of its values' rows
    every = F.array_append("holders", _described(F.col("v"), F.col("path")))
    each = rows.select("record", F.posexplode(F.transform(every, lambda x, i: F.struct(x.alias("node"), F.transform(F.slice(every, 1, i), lambda h: h["path"]).alias("above")))).alias("i", "x"))
    return each.select("record", "x.node.*", "x.above").groupBy("record", "path").agg(*[F.first(c).alias(c) for c in ("kind", "number", "text", "above")])


def verified(old: DataFrame, new: DataFrame, volatile: Sequence[str] = VOLATILE, tolerance: float = 0.0) -> DataFrame:
    """record, path, difference, and number and text of both sides, of every deviation of two archives (record, body).

    difference: missing (only the old archive has it), added, kind, length (of a list, whose elements are then not compared) or value. What a deviating
    node holds is not told again. Numbers are equal as doubles, whole or not.
    """
    sides = [nodes(df, volatile).select("record", "path", *[F.col(c).alias(f"{side}_{c}") for c in ("kind", "number", "text", "above")]) for side, df in (("old", old), ("new", new))]
    both = sides[0].join(sides[1], ["record", "path"], "full")
    a, b = F.col("old_number"), F.col("new_number")
    near = a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)) if tolerance else a.eqNullSafe(b)
    same_list = F.col("old_kind") == "list"
    difference = (
        F.when(F.col("new_kind").isNull(), "missing")
        .when(F.col("old_kind").isNull(), "added")
        .when(F.col("old_kind") != F.col("new_kind"), "kind")
        .when(same_list & ~a.eqNullSafe(b), "length")
        .when(~same_list & ~(near & F.col("old_text").eqNullSafe(F.col("new_text"))), "value")
    )
    found = both.withColumn("difference", difference).where("difference is not null").select("record", "path", "difference", "old_number", "new_number", "old_text", "new_text", F.coalesce("old_above", "new_above").alias("above"))
    # only deviating rows meet: those held by one of them go
    held = found.select("record", F.col("path").alias("self"), F.explode("above").alias("path")).join(found.select("record", "path"), ["record", "path"], "left_semi").select("record", F.col("self").alias("path"))
    return found.drop("above").join(held, ["record", "path"], "left_anti")
