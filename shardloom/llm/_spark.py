"""Session helpers shared by the operators: shared folder and staged tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shardloom.functions.shipping import ship as _ship
from shardloom.operators.fixpoint import shared_dir, shuffles_dropped

__all__ = ["discard", "remove", "shared_dir", "ship", "spare", "staged", "table", "without", "workspace"]


#: Bytes of an Arrow batch on its way to a worker, where the session sets none (Spark's default is 64 MB): texts are long, and a task holds a batch on either side.
BATCH_BYTES = 16 << 20


def ship(spark: SparkSession) -> None:
    """Make the package importable by the workers and bound the batches they are sent."""
    _ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the table has a column of that name: for columns that an operator needs for a while."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, names: tuple[str, ...] | list[str], needed: tuple[str, ...] = ()) -> DataFrame:
    """The table without columns of the names that an operator adds: its own replace them.  A column it reads can't be replaced."""
    if clash := {n.lower() for n in names} & {n.lower() for n in needed}:
        raise ValueError(f"columns that are read can't be replaced: {sorted(clash)}")
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def workspace(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = workspace(spark, what)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        remove(spark, df._staged_path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
