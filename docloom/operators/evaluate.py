"""Predictions against ground truth: per field, per document, latency; ablation and robustness tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import edit_distance_share, values_match


def compare(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Ground truth (doc_id, field_name, expected) with predictions (doc_id, field_name, actual).

    Adds match, distance and the outcome: a wrong value that is there is a false positive only.
    """
    rows = truth.join(predicted, ["doc_id", "field_name"], "left")
    wanted, got = F.coalesce("expected", F.lit("")), F.coalesce("actual", F.lit(""))
    has_wanted, has_got = wanted != "", got != ""
    both = has_wanted & has_got
    match = F.when(both, values_match(wanted, got)).otherwise(False)
    rows = rows.withColumn("match", match)
    return rows.withColumns({
        "distance": F.when(F.col("match") | (~has_wanted & ~has_got), 0.0).otherwise(edit_distance_share(wanted, got)),
        "outcome": F.when(F.col("match"), "tp").when(has_got, "fp").when(has_wanted, "fn").otherwise("none"),
    })


def field_metrics(compared: DataFrame) -> DataFrame:
    """Exact match, edit distance, precision, recall, F1 and support per field."""
    n = lambda kind: F.count_if(F.col("outcome") == kind)
    rows = compared.groupBy("field_name").agg(F.avg(F.col("outcome").isin("tp", "none").cast("double")).alias("em"), F.avg("distance").alias("nled"), n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn"), F.count("*").alias("support"))
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.try_divide("tp", F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.try_divide("tp", F.col("tp") + F.col("fn")))
    f1 = lambda a, b: F.when(a + b == 0, 0.0).otherwise(F.try_divide(2 * a * b, a + b))
    rows = rows.withColumns({"precision": p, "recall": r})
    rows = rows.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return rows.select("field_name", *[F.round(c, 4).alias(c) for c in ("em", "nled", "precision", "recall", "f1")], "support")


def document_accuracy(compared: DataFrame) -> DataFrame:
    """Share of documents without a false positive or negative."""
    docs = compared.groupBy("doc_id").agg(F.bool_and(~F.col("outcome").isin("fp", "fn")).alias("ok"))
    return docs.agg(F.round(F.avg(F.col("ok").cast("double")), 4).alias("document_accuracy"))


def macro_f1(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.round(F.avg("f1"), 4).alias("macro_f1"))


def latency(times: DataFrame, value: Column | str) -> DataFrame:
    """Mean and exact percentiles (linear between ranks)."""
    return times.agg(F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"))


def truth_keys(truth: DataFrame) -> DataFrame:
    """All field names of the ground truth, in order."""
    return truth.select("field_name").distinct().orderBy("field_name")


def accuracy_drop(metrics: DataFrame, baseline: str = "clean") -> DataFrame:
    """(condition, accuracy, drop) against the baseline's accuracy, not below 0. One row of baseline is broadcast."""
    base = metrics.filter(F.col("condition") == baseline).agg(F.max("accuracy").alias("base"))
    return metrics.crossJoin(F.broadcast(base)).select("condition", "accuracy", F.round(F.greatest(F.lit(0.0), F.col("base") - F.col("accuracy")), 4).alias("drop"))


#: Stages of the ablation, each with those before it.
ABLATION = ("lines only", "+ patterns", "+ catalogs", "+ validation", "full")


def ablation(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Document accuracy and macro F1 as methods are added.

    ``candidates``: doc_id, field_name, actual, stage (the first of ABLATION, from 0, that may use it),
    confidence; of the allowed ones the surest counts.
    """
    out = None
    for k, name in enumerate(ABLATION):
        best = candidates.filter(F.col("stage") <= k).groupBy("doc_id", "field_name").agg(F.max_by("actual", F.struct("confidence", "actual")).alias("actual"))
        compared = compare(truth, best)
        row = document_accuracy(compared).crossJoin(macro_f1(field_metrics(compared))).select(F.lit(k).alias("step"), F.lit(name).alias("stage"), "document_accuracy", "macro_f1")
        out = row if out is None else out.unionByName(row)
    return out


def markdown(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """A table's rows as markdown lines, in order of the first column."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |"))
    return metrics.select(F.col(columns[0]).alias("_key"), line.alias("line")).orderBy("_key").select("line")
