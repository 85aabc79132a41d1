"""Fingerprints of panels and comparison of archived results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def panel_hash(returns: DataFrame, digits: int = 12) -> DataFrame:
    """One row: rows, assets, first, last, dataset_hash (16 hex digits over dates, assets and values).

    Rows are hashed on the executors and summed, so no order and no collection is needed; a changed, moved or
    renamed value changes the sum. Nulls differ from zeros, minus zero doesn't.
    """
    value = F.coalesce(F.format_string(f"%.{digits}f", F.round(F.col("r"), digits) + 0.0), F.lit("null"))
    row = F.sha2(F.concat_ws("|", F.col("date").cast("string"), "asset", value), 256)
    part = lambda i: F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")
    sums = returns.agg(F.count("*").alias("rows"), F.countDistinct("asset").alias("assets"), F.min("date").alias("first"), F.max("date").alias("last"), *[F.sum(part(i)).alias(f"s{i}") for i in range(3)])
    whole = F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("")) for i in range(3)]), 256)
    return sums.select("rows", "assets", "first", "last", F.substring(whole, 1, 16).alias("dataset_hash"))


def differences(old: DataFrame, new: DataFrame, keys: list[str], value: str = "value", tolerance: float = 0.0) -> DataFrame:
    """keys, old, new, kind (missing, added or changed) of every record that differs; a full join on the keys.

    A row that both sides have with null values is the same.
    """
    a = old.select(*keys, F.col(value).alias("old"), F.lit(True).alias("__a"))
    b = new.select(*keys, F.col(value).alias("new"), F.lit(True).alias("__b"))
    numeric = a.schema["old"].dataType.typeName() in ("double", "float", "integer", "long")
    same = F.col("old").eqNullSafe(F.col("new"))
    if numeric and tolerance:
        same = same | F.coalesce(F.abs(F.col("old") - F.col("new")) <= tolerance, F.lit(False))
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "missing").when(~same, "changed")
    return a.join(b, keys, "full").withColumn("kind", kind).where("kind is not null").select(*keys, "old", "new", "kind")


def records(table: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """path, value of every number of a result table: the form that archives are compared in."""
    numbers = [c for c, t in table.dtypes if c not in keys and t in ("double", "float", "int", "bigint")]
    path = F.concat_ws("/", F.lit(prefix), *[F.col(k).cast("string") for k in keys], "metric")
    doubles = table.select(*keys, *[F.col(c).cast("double").alias(c) for c in numbers])
    return doubles.unpivot(keys, numbers, "metric", "value").select(path.alias("path"), "value")
