from pyspark.sql import functions as F

from runlens.session import materialise


def test_packed_table_is_not_broadcast(spark):
    # a few MB of Parquet, tens of MB of rows: planned by its files it would come to the driver whole
    small = materialise(spark.range(1_000_000).select((F.col("id") % 1000).alias("k"), "id", F.lit("the same words in every row").alias("w")), "packed")
    large = materialise(spark.range(1_500_000).select((F.col("id") % 1000).alias("k"), F.col("id")), "other")
    both = large.join(small, ["k", "id"])
    assert both.count() == 1_000_000
    assert "BroadcastHashJoin" not in both._jdf.queryExecution().executedPlan().toString()
