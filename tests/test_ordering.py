"""Row numbers, trailing windows and lookups with one key that holds most rows."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wireloom.operators.features import ip_diversity, port_diversity
from wireloom.operators.lookups import key_lookup
from wireloom.operators.ordering import distributed_row_number, with_trailing


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds two thirds of the rows; key null exists too."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, 0).when(F.col("id") % 30 == 2, None).otherwise(F.col("id") % 7).alias("key"),
        (F.xxhash64("id") % 100000).alias("order"), "id",
    )


def test_row_number_over_buckets_equals_plain(skewed):
    buckets = skewed.withColumn("bucket", F.floor(F.col("order") / 5000))
    ours = distributed_row_number(buckets, ["key"], ["bucket"], ["order", "id"], "pos")
    plain = F.row_number().over(W.partitionBy("key").orderBy("order", "id")) - 1
    both = ours.withColumn("want", plain)
    assert both.count() == 3000
    assert both.filter("pos <> want").count() == 0


@pytest.mark.parametrize("rows", [20, 21, 64, 1000])
def test_split_window_equals_whole_window(skewed, rows):
    events = skewed.select(
        "key", (F.row_number().over(W.partitionBy("key").orderBy("order", "id")) - 1).alias("seq"),
        (F.col("id") % 17).cast("string").alias("source_ip"), (F.col("id") % 5).cast("string").alias("destination_ip"),
    )
    columns = {"ip": ip_diversity, "n": port_diversity}
    whole = with_trailing(events, ["key"], "seq", 20, columns, None)
    split = with_trailing(events, ["key"], "seq", 20, columns, rows)
    assert whole.exceptAll(split).count() == 0
    assert split.exceptAll(whole).count() == 0


def test_block_must_hold_a_window(skewed):
    with pytest.raises(ValueError):
        with_trailing(skewed, ["key"], "id", 20, {}, 19)


def _plain(left, table):
    renamed = table.withColumnRenamed("key", "k2")
    return left.join(renamed, left["key"].eqNullSafe(renamed["k2"]), "left").drop("k2")


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_key_lookup_equals_join(spark, skewed, limit):
    table = spark.createDataFrame([(0, "a"), (1, "b"), (None, "n"), (99, "z")], "key long, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        ours, want = key_lookup(skewed, table, ["key"]), _plain(skewed, table)
        assert ours.count() == 3000
        assert ours.exceptAll(want.select(ours.columns)).count() == 0
        inner = key_lookup(skewed, table, ["key"], how="inner")
        assert inner.count() == want.filter("name is not null").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_keys_of_any_number_are_split(spark):
    """5,000 keys with 20 rows each and one key with half of all rows: no task gets the hot key whole."""
    rows = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 5000).alias("key"),
                                       F.md5(F.col("id").cast("string")).alias("load"))
    table = spark.range(5000).select(F.col("id").alias("key"), F.col("id").cast("string").alias("name"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = key_lookup(rows.repartition(32), table, ["key"]).withColumn("p", F.spark_partition_id())
        sizes = joined.groupBy("p").agg(F.count("*").alias("rows"), F.max("load"), F.max("name"))
        per_task = [r["rows"] for r in sizes.collect()]
    finally:
        for k in settings:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(per_task) == 200_000 and max(per_task) < 40_000
