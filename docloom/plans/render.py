"""Receipts rendered from orders: a document per order, with the shapes that the extraction reads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box
from ..operators.documents import spread
from ..operators.imaging import encode_png


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders with the figures that are printed: qty, unit price, amount.

    In every seventh order the first line's amount is less the discount, so its arithmetic is off.
    """
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    rows = lines.join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    off = (F.col("l_orderkey") % 7 == 0) & (F.col("l_linenumber") == 1)
    cents, qty = F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.col("l_quantity").cast("bigint")
    kept = F.when(off, 100 - F.round(F.col("l_discount") * 100).cast("bigint")).otherwise(F.lit(100))
    rows = rows.withColumns({"_cents": cents, "_qty": qty, "_kept": kept})
    return rows.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"), F.col("p_name").alias("item"), F.col("l_quantity").alias("qty"),
        (F.expr("(2 * _cents + _qty) div (2 * _qty)") / 100).alias("unit_price"), (F.expr("_cents * _kept div 100") / 100).alias("amount"),
    )


def render_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines (doc_id, line_idx, page, text, bbox, confidence) of all orders that have items.

    Line numbers leave gaps: head lines from 0, items from 100 by their number, feet from 10000.
    """
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    items = order_items(spark, sf_dir)
    sums = items.groupBy("order_key").agg(F.sum(F.col("amount").cast("decimal(18,2)")).alias("total"))
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate").join(sums, F.col("o_orderkey") == F.col("order_key"))
    orders = orders.join(t("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    key, total = F.col("o_orderkey").cast("string"), F.col("total").cast("string")
    heads = [
        (0, F.lit("SPICE GARDEN RESTAURANT")), (1, F.lit("TAX INVOICE (RECEIPT)")),
        (2, text("Invoice No : INV-", key, "    Date : ", F.date_format("o_orderdate", "dd/MM/yyyy"))), (3, text("Table No : T-", (F.col("o_orderkey") % 40).cast("string"), "    Cashier : ", F.col("c_name"))),
        (4, F.lit("S.No. Item Name Qty Unit Price Amount (₹)")),
        (10000, text("Subtotal ", total)), (10001, text("Grand Total ₹ ", total)), (10002, F.lit("Payment Mode : UPI")), (10003, F.lit("THANK YOU! VISIT AGAIN")),
    ]
    framed = orders.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(i).alias("line_idx"), x.alias("text")) for i, x in heads])).alias("l")).select(F.col("o_orderkey").alias("order_key"), "l.line_idx", "l.text")
    body = items.select("order_key", (F.col("line_number") + 100).alias("line_idx"), F.concat_ws(" ", F.col("line_number").cast("string"), "item", F.col("qty").cast("bigint").cast("string"), money(F.col("unit_price")), money(F.col("amount"))).alias("text"))
    y = F.col("line_idx") * 25.0
    return framed.unionByName(body).select(F.col("order_key").cast("string").alias("doc_id"), F.col("line_idx").cast("int").alias("line_idx"), F.lit(1).alias("page"), "text", box(50, y, 450, y + 20).alias("bbox"), F.lit(0.98).alias("confidence"))


#: Shapes that a tractor invoice has, by its order's number: all labels with their values; values to the
#: right of their labels; values below; horse power out of range; no cost; horse power in running text;
#: nothing that says what it is.
TRACTOR_SHAPES = ("inline", "right", "below", "out_of_range", "no_cost", "in_text", "unknown")


def tractor_lines(spark: SparkSession, sf_dir: str, dealers: list[str], models: list[str]) -> DataFrame:
    """Lines of one tractor invoice per order, its shape by the order's number."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderdate").join(t("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    shape = F.element_at(F.array(*[F.lit(x) for x in TRACTOR_SHAPES]), (key % len(TRACTOR_SHAPES) + 1).cast("int"))
    of = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (key % len(names) + 1).cast("int"))
    hp = F.when(shape == "out_of_range", 180 + key % 10).otherwise(20 + key % 60).cast("string")
    o = o.select(key.cast("string").alias("doc_id"), shape.alias("shape"), of(dealers).alias("dealer"), of(models).alias("model"), hp.alias("hp"), F.concat((300 + key % 500).cast("string"), F.lit("000.00")).alias("cost"), F.concat(F.lit("TR-"), key.cast("string")).alias("number"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("date"), "c_name")
    c = F.col
    labelled = [("Authorised Dealer", c("dealer")), ("Model Name", c("model")), ("Invoice No", c("number")), ("Invoice Date", c("date")), ("Customer Name", c("c_name")), ("Horse Power", c("hp")), ("Total Cost", c("cost"))]
    rows = [(0, 50, F.when(c("shape") == "unknown", "NOTE").otherwise("TRACTOR TAX INVOICE"), F.lit(True))]
    for k, (label, value) in enumerate(labelled, 1):
        there = (c("shape") != "unknown") & ~((c("shape") == "no_cost") & F.lit(label == "Total Cost"))
        spoken = (c("shape") == "in_text") & F.lit(label == "Horse Power")
        apart = c("shape").isin("right", "below")
        y = F.lit(100.0 * k)
        rows.append((10 * k, y, F.when(spoken, F.concat(F.lit("diesel engine of "), value, F.lit(" hp"))).when(apart, F.concat(F.lit(label), F.lit(" :"))).otherwise(F.concat(F.lit(label), F.lit(" : "), value)), there))
        rows.append((10 * k + 1, F.when(c("shape") == "below", y + 26.0).otherwise(y), value, there & apart))
    rows.append((900, F.lit(50.0), F.lit("horse power rating as per maker"), c("shape") == "in_text"))
    lines = F.array(*[F.struct(F.lit(i).alias("line_idx"), F.lit(y).cast("double").alias("y") if not isinstance(y, Column) else y.cast("double").alias("y"), (x if isinstance(x, Column) else F.lit(x)).alias("text"), there.alias("there")) for i, y, x, there in rows])
    found = o.select("doc_id", "shape", F.explode(lines).alias("l")).filter("l.there")
    x0 = F.when((c("shape") == "right") & (c("l.line_idx") % 10 == 1) & (c("l.line_idx") > 0), 260.0).otherwise(50.0)
    return found.select("doc_id", "l.line_idx", F.lit(1).alias("page"), "l.text", box(x0, c("l.y"), x0 + 180.0, c("l.y") + 20.0).alias("bbox"), F.lit(0.97).alias("confidence"))


PAGE_HEIGHT, PAGE_WIDTH = 320, 240
#: A pen stroke that a page may have in its lower half: corners (x, y) of a line drawn three pixels wide.
STROKE = ((40, 250), (55, 215), (65, 255), (80, 212), (95, 256), (108, 220), (120, 250), (140, 230))


def page_image(key: int) -> np.ndarray:
    """A page of text lines (blue, green, red): on its side for even keys, a stamp for every third, a signature for every fifth."""
    page = np.full((PAGE_HEIGHT, PAGE_WIDTH, 3), 255, np.uint8)
    for y in range(12, 140, 12):
        page[y : y + 4, 12 : PAGE_WIDTH - 12] = 0
    if key % 3 == 0:
        page[165 : 165 + 50, 170 : 170 + 50] = (200, 40, 40)
    if key % 5 == 0:
        for (x0, y0), (x1, y1) in zip(STROKE, STROKE[1:]):
            n = 2 * max(abs(x1 - x0), abs(y1 - y0))
            for x, y in zip(np.linspace(x0, x1, n).round().astype(int), np.linspace(y0, y1, n).round().astype(int)):
                page[y - 1 : y + 2, x - 1 : x + 2] = (30, 30, 30)
    return np.rot90(page).copy() if key % 2 == 0 else page


def render_pages(keys: DataFrame) -> DataFrame:
    """(key, content): a PNG file per key of ``keys`` (key).

    Keys are small and pages dear: they are dealt out by a fixed number, which neither the size of the
    table's file nor that of the shuffle lowers to one task.
    """

    def draw(batches):
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "content": [encode_png(page_image(int(k))) for k in batch["key"]]})

    return spread(keys).mapInPandas(draw, "key long, content binary")
