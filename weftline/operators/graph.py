"""Connected components of links inside conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import discard, scratch


def components(edges: DataFrame) -> DataFrame:
    """(conv_id, node, root) from (conv_id, a, b): the smallest node of each component, for every node that has a link.

    Alternating large-star and small-star steps, each written to the shared folder, the one before removed; the number
    of rounds grows with the logarithm of the longest chain. No links give no rows.
    """
    spark = edges.sparkSession

    def written(df: DataFrame, before: str | None) -> tuple[DataFrame, str]:
        at = scratch(spark, "links")
        df.select("conv_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).write.parquet(at)
        if before:
            discard(spark, before)
        return spark.read.parquet(at), at

    edges, at = written(edges.where("a <> b"), None)
    while True:
        both = edges.select("conv_id", "a", "b").union(edges.select("conv_id", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("conv_id", "a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, ["conv_id", "a"]).where("b > a").select("conv_id", F.col("low").alias("a"), "b").where("a <> b").distinct()
        down = large.select("conv_id", F.greatest("a", "b").alias("top"), F.least("a", "b").alias("to"))
        linked = down.join(down.groupBy("conv_id", "top").agg(F.min("to").alias("low")), ["conv_id", "top"])
        small = linked.select("conv_id", F.col("low").alias("a"), F.col("to").alias("b")).union(linked.select("conv_id", F.col("low").alias("a"), F.col("top").alias("b"))).where("a <> b").distinct()
        edges, at = written(small, at)
        # Done when every node hangs on one root that itself hangs on nothing.
        twice = edges.groupBy("conv_id", "b").count().where("count > 1").limit(1).count()
        if not twice and not edges.join(edges.select("conv_id", F.col("b").alias("a")), ["conv_id", "a"], "left_semi").limit(1).count():
            return edges.select("conv_id", F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("conv_id", F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
