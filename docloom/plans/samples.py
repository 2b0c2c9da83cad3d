"""Five tractor invoices as lines with their ground truth: what an evaluation falls back on without data of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.lines import given_lines

# The samples' fields.
SAMPLES = (
    {"doc_id": "sample_01", "dealer_name": "Mahindra & Mahindra Ltd.", "model_name": "Arjun Novo 605 DI", "horse_power": 50.0, "asset_cost": 550000.0, "invoice_number": "INV-2026-001", "invoice_date": "15/02/2026", "customer_name": "Ramesh Kumar", "phone_number": "9876543210"},
    {"doc_id": "sample_02", "dealer_name": "Swaraj Tractors Ltd.", "model_name": "Swaraj 744 FE", "horse_power": 48.0, "asset_cost": 680000.0, "invoice_number": "SW-78901", "invoice_date": "20/01/2026", "customer_name": "Suresh Patel", "phone_number": "9123456780"},
    {"doc_id": "sample_03", "dealer_name": "John Deere India Pvt. Ltd.", "model_name": "John Deere 5050 D", "horse_power": 50.0, "asset_cost": 790000.0, "invoice_number": "JD/2026/88", "invoice_date": "05/03/2026", "customer_name": "Balwant Singh", "phone_number": "9845012345"},
    {"doc_id": "sample_04", "dealer_name": "Escorts Kubota Ltd.", "model_name": "Farmtrac 60", "horse_power": 55.0, "asset_cost": 720000.0, "invoice_number": "EK-5541", "invoice_date": "12/02/2026", "customer_name": "Manpreet Kaur", "phone_number": "9765432109"},
    {"doc_id": "sample_05", "dealer_name": "Sonalika Tractors Ltd.", "model_name": "Sonalika Sikander RX 50", "horse_power": 50.0, "asset_cost": 640000.0, "invoice_number": "SON-9921", "invoice_date": "28/02/2026", "customer_name": "Vikram Rathore", "phone_number": "9811223344"},
)
# Where the samples' lines begin (x, y) and what they say.
LAYOUT = (
    (60, 60, "TAX INVOICE / QUOTATION"), (60, 95, "Authorised Dealer: {dealer_name}"), (60, 125, "Phone: {phone_number}"), (60, 200, "Invoice No: {invoice_number}"), (550, 200, "Invoice Date: {invoice_date}"),
    (60, 240, "Customer Name: {customer_name}"), (60, 325, "Sl No."), (160, 325, "Description of Equipment / Model"), (600, 325, "Horse Power"), (780, 325, "Total Amount (Rs.)"),
    (60, 400, "01"), (160, 400, "{model_name} Tractor"), (600, 400, "{horse_power} HP"), (780, 400, "{asset_cost:,.2f}"), (550, 620, "Grand Total (Rs.):"), (780, 620, "{asset_cost:,.2f}"),
    (100, 1150, "Customer Signature"), (650, 1150, "Authorised Dealer Sign & Seal"),
)
#: Width of a character and height of a line, in pixels.
CHAR, HEIGHT = 7, 14


def sample_lines(spark: SparkSession) -> DataFrame:
    """The samples' lines, as a recogniser would give them."""
    said = [(s["doc_id"], i, text.format(**s), x, y) for s in SAMPLES for i, (x, y, text) in enumerate(LAYOUT)]
    return given_lines(spark, [(d, i, t, (x, y, x + CHAR * len(t), y + HEIGHT), 0.97) for d, i, t, x, y in said])


def sample_truth(spark: SparkSession) -> DataFrame:
    """(doc_id, field_name, expected)."""
    return spark.createDataFrame([(s["doc_id"], k, str(v)) for s in SAMPLES for k, v in s.items() if k != "doc_id"], "doc_id string, field_name string, expected string")
