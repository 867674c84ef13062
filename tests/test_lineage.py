"""What a written table leaves behind."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from corpuslens.plans import lineage


def _shuffle_bytes(spark):
    return sum(p.stat().st_size for p in Path(spark.sparkContext.getConf().get("spark.local.dir")).rglob("shuffle_*.data"))


def test_a_written_table_leaves_no_shuffle_files(spark):
    rows = spark.range(200_000).select((F.col("id") % 1000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    before, setting = _shuffle_bytes(spark), spark.conf.get(lineage.CLEANUP, None)
    written = lineage.cut(rows.repartition(4, "k").groupBy("k").agg(F.max("x").alias("x")))
    for _ in range(50):
        if (left := _shuffle_bytes(spark) - before) < 1_000_000:
            break
        time.sleep(0.1)
    assert left < 1_000_000  # else they stay until the driver happens to collect its garbage
    assert written.count() == 1000 and spark.conf.get(lineage.CLEANUP, None) == setting
    assert spark.range(10).repartition(2).groupBy().count().first()[0] == 10
