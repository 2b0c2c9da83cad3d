"""What larger tables need: equal texts compared once, work dealt out over tasks."""

import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docloom.operators import match
from docloom.plans.render import render_pages

SF = "/root/testdata/sf0.001"


def test_pages_and_parts_of_one_file_go_to_many_tasks(spark):
    least = 4 * spark.sparkContext.defaultParallelism
    keys = spark.range(0, 100, 1, 1).select(F.col("id").alias("key"))
    assert render_pages(keys).rdd.getNumPartitions() >= least
    for name in ("degraded_pages", "page_marks", "model_candidates"):
        assert entry.queries()[name](spark, SF).rdd.getNumPartitions() >= least, name


def test_equal_texts_are_compared_once():
    asked = []

    def found(own):
        asked.append(own)
        return [(own, 100.0, 0.98, "exact", {}), ("b", 80.0, 0.7, "fuzzy", {})]

    out = match._each_text(pd.Series(["A  x", "a x", None, "a X"]), found, 1)
    assert sorted(asked) == ["", "a x"] and [r[0]["name"] for r in out] == ["a x", "a x", "", "a x"]
