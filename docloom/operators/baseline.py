"""Fixed patterns without schemas: horse power, cost and the eight fields of the evaluation baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import java_pattern
from ..functions.text import plain_number, strip

# Patterns, confidences, least lengths and plausible ranges.
HP = (
    r"(?:horse\s*power|engine\s*power|power|hp)\s*[:\-]\s*(\d{1,3}(?:\.\d+)?)\s*(?:h\.?p\.?|hp)?",
    r"(?:horse\s*power|engine\s*power|power)\s*[:\-]?\s*(\d{1,3}(?:\.\d+)?)\s*(?:h\.?p\.?|hp)?",
    r"(\d{1,3}(?:\.\d+)?)\s*(?:h\.?\s*p\.?|hp)\b",
    r"\bhp\s*[:\-]?\s*(\d{1,3}(?:\.\d+)?)\b",
)
COST = (
    r"(?:asset\s*cost|total\s*cost|grand\s*total|invoice\s*total|net\s*total|invoice\s*value|total\s*amount(?:\s*payable)?|amount\s*payable|total\s*(?:\([^)]*\))?)\s*[:\-]?\s*(?:rs\.?|inr|₹)?\s*([\d,]+(?:\.\d{1,2})?)\s*(?:/-)?",
)
COST_OTHER = (
    r"(?:cost|amount|price|base\s*price|sub\s*total)\s*[:\-]?\s*(?:rs\.?|inr|₹)?\s*([\d,]+(?:\.\d{1,2})?)\s*(?:/-)?",
    r"(?:rs\.?|inr|₹)\s*([\d,]+(?:\.\d{1,2})?)\s*(?:/-)?",
)
HP_RANGE, COST_LEAST = (5.0, 250.0), 1000.0
INVOICE = (r"(?:invoice\s*(?:no\.?|num\.?|number|#)|bill\s*(?:no\.?|number)|inv\s*no\.?)\s*[:\-]?\s*([a-zA-Z0-9\-\/]+)", r"\b(?:inv|bill)[/\-_](?:20\d{2}[/\-_])?[a-zA-Z0-9\-]+\b")
DATE = (r"(?:date|dated|invoice\s*date|bill\s*date)\s*[:\-]?\s*(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4})", r"\b(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4})\b")
PHONE = (r"(?:phone|mobile|mob|contact|tel)\s*(?:no\.?|number)?\s*[:\-]?\s*(?:\+91[\-\s]?)?([6-9]\d{9})\b", r"\b(?:\+91[\-\s]?)?([6-9]\d{4}[\-\s]?\d{5})\b")
DEALER = (r"(?:dealer\s*name|dealer|m/s\.?|authorized\s*dealer|authorised\s*dealer)\s*[:\-]?\s*(.+)",)
MODEL = (r"(?:model\s*name|model|tractor\s*model)\s*[:\-]?\s*(.+)",)
CUSTOMER = (r"(?:customer\s*name|buyer\s*name|bill\s*to|purchaser|sold\s*to)\s*[:\-]?\s*(.+)",)
CONFIDENCE = {"horse_power": 0.95, "asset_cost": 0.92, "invoice_number": 0.90, "invoice_date": 0.91, "phone_number": 0.92, "dealer_name": 0.75, "model_name": 0.75, "customer_name": 0.75}
SHORTEST = {"invoice_number": 3, "dealer_name": 3, "model_name": 2, "customer_name": 3}
METHOD = {"horse_power": "regex_hp", "asset_cost": "regex_cost", "invoice_number": "regex_inv", "invoice_date": "regex_date", "phone_number": "regex_phone", "dealer_name": "regex_dealer", "model_name": "regex_model", "customer_name": "regex_cust"}


def _captures(pattern: str) -> bool:
    return "(" in pattern.replace("(?", "")


def first_value(text: Column, patterns: tuple[str, ...], accept=None) -> Column:
    """The first pattern's value, trimmed, that ``accept`` takes."""
    tries = []
    for p in patterns:
        java = java_pattern(p)
        value = F.when(F.regexp_like(text, F.lit(java)), strip(F.regexp_extract(text, java, 1 if _captures(p) else 0)))
        tries.append(F.when(accept(value), value) if accept else value)
    return F.coalesce(*tries)


def horse_power(text: Column) -> Column:
    """A line's plausible horse power, by the first of four patterns that gives one."""
    return plain_number(first_value(text, HP, lambda v: plain_number(v).between(*HP_RANGE)))


def asset_cost(text: Column, *, secondary: bool = True) -> Column:
    """A line's cost of at least a thousand; totals first, then other prices."""
    return plain_number(first_value(text, COST + (COST_OTHER if secondary else ()), lambda v: plain_number(v) >= COST_LEAST))


def first_matches(lines: DataFrame, patterns: dict[str, tuple[str, ...]], *, confidence: float = 0.90, shortest: int = 1) -> DataFrame:
    """Per document and field the first line (and on it the first pattern) with a value of enough characters.

    (doc_id, field_name, value, line_idx, confidence, method)
    """
    found = [F.struct(F.lit(name).alias("field_name"), first_value(F.col("text"), ps, lambda v: F.length(v) >= shortest).alias("value")) for name, ps in patterns.items()]
    rows = lines.select("doc_id", "line_idx", F.explode(F.filter(F.array(*found), lambda x: x["value"].isNotNull())).alias("x"))
    rows = rows.groupBy("doc_id", "x.field_name").agg(F.min(F.struct("line_idx", "x.value")).alias("m"))
    return rows.select("doc_id", "field_name", "m.value", "m.line_idx", F.lit(confidence).alias("confidence"), F.concat(F.lit("regex_"), "field_name").alias("method"))


def baseline_fields(lines: DataFrame) -> DataFrame:
    """The evaluation baseline: eight fields, the first line that gives each, with fixed confidences.

    For dates and phones only the first pattern that matches is asked on a line.
    """
    text = strip(F.col("text"))
    long = lambda name: lambda v: F.length(v) >= SHORTEST[name]
    values = {
        "horse_power": first_value(text, HP, lambda v: plain_number(v).between(*HP_RANGE)), "asset_cost": first_value(text, COST, lambda v: plain_number(v) >= COST_LEAST),
        "invoice_number": first_value(text, INVOICE, long("invoice_number")), "invoice_date": first_value(text, DATE), "phone_number": first_value(text, PHONE),
        "dealer_name": first_value(text, DEALER, long("dealer_name")), "model_name": first_value(text, MODEL, long("model_name")), "customer_name": first_value(text, CUSTOMER, long("customer_name")),
    }
    found = [F.struct(F.lit(k).alias("field_name"), v.alias("value"), F.lit(CONFIDENCE[k]).alias("confidence"), F.lit(METHOD[k]).alias("method")) for k, v in values.items()]
    rows = lines.select("doc_id", "line_idx", "bbox", F.explode(F.filter(F.array(*found), lambda x: x["value"].isNotNull())).alias("x"))
    first = F.row_number().over(Window.partitionBy("doc_id", "x.field_name").orderBy("line_idx"))
    rows = rows.withColumn("r", first).filter("r = 1")
    return rows.select("doc_id", "x.field_name", F.when(F.col("x.field_name").isin("horse_power", "asset_cost"), plain_number(F.col("x.value")).cast("string")).otherwise(F.col("x.value")).alias("value"), "line_idx", "bbox", "x.confidence", "x.method")
