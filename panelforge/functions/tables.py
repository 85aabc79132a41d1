"""Small tables of constants as part of the plan, so that the optimizer knows their size and no job makes them; and tables that
end a plan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def constants(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """rows of plain values as a table; schema: "name type, name type"."""
    columns = [c.strip().split(" ", 1) for c in schema.split(",")]

    def row(values: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(values, columns, strict=True)])

    return spark.range(1, numPartitions=1).select(F.inline(F.array(*map(row, rows))))


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


def settled(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: the plan ends here, so what is built on it is small, and a lost executor loses
    nothing. The table goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/panelforge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes a settled table before the JVM ends."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def side_by_side(spark: SparkSession, *parts: Callable[[], DataFrame]) -> list[DataFrame]:
    """The settled tables of several plans, built and run at the same time: small jobs leave most cores idle one by one."""
    with ThreadPoolExecutor(len(parts)) as pool:
        return list(pool.map(lambda part: inheritable_thread_target(spark)(lambda: settled(part()))(), parts))
