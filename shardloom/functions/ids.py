"""Identifier rules shared by readers, preparation and algorithms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(pid: Column, counter: Column, bits: int = 32) -> Column:
    """counter | pid << bits, for subgraph and edge ids."""
    return F.shiftleft(pid.cast("long"), bits).bitwiseOR(counter.cast("long"))


def hash_partition(vid: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(vid), F.lit(parts)).cast("int")


def modulo_partition(vid: Column, parts: int) -> Column:
    return F.pmod(vid, F.lit(parts)).cast("int")


def range_partition(vid: Column, low: int, high: int, parts: int) -> Column:
    width = max(1, -(-(high - low + 1) // parts))
    return F.least(F.floor((vid - low) / width), F.lit(parts - 1)).cast("int")


def number_within(rows: DataFrame, group: str | None, order: list[str], name: str, cut) -> DataFrame:
    """The rows with a number from 0, by ``order`` within each ``group`` (or all of them).

    Rows are dealt by range of group and order, numbered in each range, and each
    range's first number comes from the counts of those before: one sort, and a
    large group is as many tasks as it has ranges.  ``cut``: writes a table and
    reads it back, so the ranges are the same for both uses.
    """
    key = [group, *order] if group else order
    own = ["_part", group] if group else ["_part"]
    dealt = rows.repartitionByRange(*key).withColumn("_part", F.spark_partition_id())
    ranked = cut(dealt.withColumn("_pos", F.row_number().over(Window.partitionBy(*own).orderBy(*order)) - 1))
    counts = ranked.groupBy(*own).agg(F.count("*").alias("_n"))
    # one row for each range, and one more for each group
    over = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(over), F.lit(0))).drop("_n")
    return ranked.join(before, own).withColumn(name, F.col("_before") + F.col("_pos")).drop("_part", "_pos", "_before")
