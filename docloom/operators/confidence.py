"""Confidence of fields, weighted and overall; the stand-alone decision; calibration and its measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reliability of methods, shares, penalties, thresholds.
METHODS = {
    "layout_kv": 1.00, "layout_kv_inline": 1.00, "layout_kv_right": 0.96, "layout_kv_below": 0.92, "exact_match": 0.98, "exact_normalized": 0.98, "regex": 0.92, "regex_hp": 0.95, "regex_cost": 0.92,
    "regex_invoice_num": 0.90, "regex_date": 0.91, "regex_phone": 0.92, "regex_reg_no": 0.89, "regex_serial_no": 0.88, "fuzzy_candidate": 0.88, "fuzzy_ocr_scan": 0.82, "model_candidate_match": 0.90,
    "model_ocr_scan": 0.85, "regex_numeric_fallback": 0.80, "rule_default": 0.50,
}
OTHER_METHOD, RAW, RELIABILITY, INVALID, WARNED = 0.85, 0.7, 0.3, 0.40, 0.80
CRITICAL = 0.65


def field_confidence(raw: Column, method: Column, status: Column, there: Column) -> Column:
    """Raw confidence and the method's reliability, less what the status costs; 0 for an absent field."""
    known = F.create_map(*[x for k, v in METHODS.items() for x in (F.lit(k), F.lit(v))])
    score = raw * RAW + F.coalesce(F.try_element_at(known, F.coalesce(method, F.lit("regex"))), F.lit(OTHER_METHOD)) * RELIABILITY
    score = score * F.when(status == "invalid", INVALID).when(status == "warning", WARNED).otherwise(1.0)
    return F.when(there, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(score, 4)))).otherwise(0.0)


def weighted_confidence(fields: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, confidence): weights of absent fields count with confidence 0. ``weights``: field_name, weight."""
    docs = fields.select("doc_id").distinct()
    held = docs.crossJoin(F.broadcast(weights)).join(fields.select("doc_id", "field_name", "confidence"), ["doc_id", "field_name"], "left")
    return held.groupBy("doc_id").agg(F.round(F.sum(F.col("weight") * F.coalesce("confidence", F.lit(0.0))) / F.sum("weight"), 4).alias("confidence"))


def mean_confidence(fields: DataFrame) -> DataFrame:
    return fields.groupBy("doc_id").agg(F.round(F.avg("confidence"), 4).alias("confidence"))


def decision(confidence: Column, reasons: Column, low_fields: Column, *, auto: float = 0.88, review: float = 0.70) -> Column:
    """(decision, reasons): any reason bars approval. ``low_fields``: array<struct<field, confidence>>."""
    low = F.transform(F.filter(low_fields, lambda f: f["confidence"] < CRITICAL), lambda f: F.concat(F.lit("Field '"), f["field"], F.lit("' has critically low confidence ("), F.format_string("%.2f", f["confidence"]), F.lit(").")))
    below = F.concat(F.lit("Overall confidence ("), F.format_string("%.2f", confidence), F.lit(f") below auto-approve threshold ({auto:.2f}).")) 
    all_ = F.concat(reasons, F.when(confidence < auto, F.array(below)).otherwise(F.array().cast("array<string>")), low)
    kind = F.when((confidence >= auto) & (F.size(all_) == 0), "AUTO_APPROVE").when(confidence >= review, "REVIEW").otherwise("MANUAL_REVIEW")
    return F.struct(kind.alias("decision"), all_.alias("reasons"))


def brier(scored: DataFrame) -> DataFrame:
    """``scored``: y (0 or 1), p."""
    return scored.agg(F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 4).alias("brier"))


def ece(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed; values outside fall in none."""
    edges = [k / bins for k in range(bins + 1)]
    number = F.lit(None).cast("int")
    for k in range(bins - 1, -1, -1):
        inside = (F.col("p") >= edges[k]) & ((F.col("p") <= edges[k + 1]) if k == bins - 1 else (F.col("p") < edges[k + 1]))
        number = F.when(inside, k).otherwise(number)
    per_bin = scored.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"))
    return per_bin.agg(F.round(F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("p") - F.col("y")))) / F.sum("n"), 4).alias("ece"))


class Calibrator:
    """Platt or isotonic calibration of scores; unfitted, it gives scores back as they are."""

    def __init__(self, method: str = "platt"):
        self.method, self.model = method, None

    def fit(self, scored: DataFrame) -> Calibrator:
        """``scored``: y, p. Fitted by distributed optimisers over all rows."""
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import IsotonicRegression

        rows = scored.select(F.col("y").cast("double").alias("label"), F.col("p").cast("double").alias("p"))
        if self.method == "isotonic":
            self.model = IsotonicRegression(featuresCol="p", labelCol="label").fit(rows)
        else:
            n = rows.count()
            rows = VectorAssembler(inputCols=["p"], outputCol="features").transform(rows)
            self.model = LogisticRegression(regParam=1 / n, elasticNetParam=0.0, standardization=False, maxIter=200).fit(rows)
        return self

    def calibrate(self, scored: DataFrame) -> DataFrame:
        """Add ``calibrated`` to a table with p."""
        if self.model is None:
            return scored.withColumn("calibrated", F.col("p"))
        if self.method == "isotonic":
            out = self.model.transform(scored.withColumn("p", F.col("p").cast("double")))
            return out.withColumn("calibrated", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction")))).drop("prediction")
        w, b = float(self.model.coefficients[0]), float(self.model.intercept)
        return scored.withColumn("calibrated", 1 / (1 + F.exp(-(F.col("p") * w + b))))
