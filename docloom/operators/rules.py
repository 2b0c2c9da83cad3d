"""Pluggable rules: functions from a table of fields to a table of messages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import valid_date, valid_mobile

# The fields that must be there and the ranges of numbers.
REQUIRED = ("dealer_name", "model_name", "horse_power", "asset_cost")
RANGES = {"horse_power": (5.0, 250.0), "asset_cost": (1000.0, 100_000_000.0)}

#: fields (doc_id, field_name, value_str, value_num) to (doc_id, field_name, severity, message)
RuleFn = Callable[[DataFrame], DataFrame]


def required_fields(names: tuple[str, ...] = REQUIRED) -> RuleFn:
    def rule(fields: DataFrame) -> DataFrame:
        docs = fields.select("doc_id").distinct()
        wanted = docs.select("doc_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("field_name")) if names else docs.select("doc_id", F.lit("").alias("field_name")).limit(0)
        there = fields.filter(F.trim("value_str") != "").select("doc_id", "field_name")
        return wanted.join(there, ["doc_id", "field_name"], "left_anti").select("doc_id", "field_name", F.lit("error").alias("severity"), F.lit("required field is missing").alias("message"))

    return rule


def numeric_range(name: str, least: float, most: float) -> RuleFn:
    def rule(fields: DataFrame) -> DataFrame:
        n = F.coalesce(F.col("value_num"), F.col("value_str").try_cast("double"))
        said = F.concat(F.lit("value "), F.col("value_str"), F.lit(f" is outside [{least}, {most}]"))
        return fields.filter((F.col("field_name") == name) & ~n.between(least, most)).select("doc_id", "field_name", F.lit("error").alias("severity"), said.alias("message"))

    return rule


def date_format(name: str = "invoice_date") -> RuleFn:
    def rule(fields: DataFrame) -> DataFrame:
        rows = fields.filter((F.col("field_name") == name) & (F.trim("value_str") != "")).withColumn("v", valid_date(F.col("value_str")))
        return rows.filter("v.status <> 'ok'").select("doc_id", "field_name", F.col("v.status").alias("severity"), F.col("v.message").alias("message"))

    return rule


def phone_number(name: str = "phone_number") -> RuleFn:
    def rule(fields: DataFrame) -> DataFrame:
        rows = fields.filter((F.col("field_name") == name) & (F.trim("value_str") != "") & ~valid_mobile(F.col("value_str")))
        return rows.select("doc_id", "field_name", F.lit("warning").alias("severity"), F.concat(F.lit("phone number '"), F.col("value_str"), F.lit("' is not a mobile number")).alias("message"))

    return rule


class RuleEngine:
    """A list of rules; their messages, the status of fields, and whether a document is barred."""

    def __init__(self, rules: list[RuleFn] | None = None):
        self.rules = rules if rules is not None else [required_fields(), *[numeric_range(n, a, b) for n, (a, b) in RANGES.items()], date_format(), phone_number()]

    def add_rule(self, rule: RuleFn) -> None:
        self.rules.append(rule)

    def messages(self, fields: DataFrame) -> DataFrame:
        """A rule that cannot be planned over these fields gives a warning in place of its messages."""
        found = []
        for rule in self.rules:
            try:
                found.append(rule(fields))
            except Exception as e:  # a rule is foreign code
                found.append(fields.select("doc_id").distinct().select("doc_id", F.lit("").alias("field_name"), F.lit("warning").alias("severity"), F.lit(f"rule failed: {type(e).__name__}").alias("message")))
        return reduce(DataFrame.unionByName, found)

    def validate(self, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Fields with ``validation_status``, and (doc_id, messages, blocking) per document."""
        said = self.messages(fields)
        worst = said.groupBy("doc_id", "field_name").agg(F.max(F.when(F.col("severity") == "error", 2).otherwise(1)).alias("w"))
        status = F.when(F.col("w") == 2, "invalid").when(F.col("w") == 1, "warning").otherwise("valid")
        marked = fields.join(worst, ["doc_id", "field_name"], "left").withColumn("validation_status", status).drop("w")
        text = F.concat("field_name", F.lit(": "), "message")
        docs = said.groupBy("doc_id").agg(F.sort_array(F.collect_list(text)).alias("messages"), F.bool_or(F.col("severity") == "error").alias("blocking"))
        every = fields.select("doc_id").distinct().join(docs, "doc_id", "left")
        return marked, every.select("doc_id", F.coalesce("messages", F.array().cast("array<string>")).alias("messages"), F.coalesce("blocking", F.lit(False)).alias("blocking"))
