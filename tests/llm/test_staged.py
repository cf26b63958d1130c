"""What staged tables leave on the executors' disks."""

import time

from pyspark.sql import functions as F

from shardloom.llm._spark import staged
from shardloom.operators.fixpoint import cut


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffles_go_when_a_table_is_staged(spark):
    before = shuffle_files(spark)
    rows = spark.range(20_000).select("id", (F.col("id") % 977).alias("k"))
    kept = []
    for write in (staged, cut):
        out = write(rows.repartition(4, "k").groupBy("k").agg(F.sum("id").alias("s")), "test-staged")
        kept.append(sorted(out.collect()))
    until = time.time() + 5
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and kept[0] == kept[1] and len(kept[0]) == 977
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(name) == "false"  # the session's own setting is back
