"""Connected components by alternating large and small stars, distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, discard


def components(edges: DataFrame, home: str) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the least node it is connected with.

    Each round links every node to the least of its neighbours, first the larger neighbours, then the
    smaller; at the end each component is a star. Minima are aggregated before they are shuffled. A
    round's edges are a written table; the number of rounds grows with the logarithm of the nodes.
    """
    spark = edges.sparkSession
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{home}/edges0")
    before, k = None, 0
    while True:
        facts = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if facts == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
        before, k = facts, k + 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = cut(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), f"{home}/large{k}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{home}/edges{k}")
        discard(spark, f"{home}/large{k}", f"{home}/edges{k - 1}")
