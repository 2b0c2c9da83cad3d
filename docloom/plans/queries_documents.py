"""Queries over receipts rendered from orders: classification to decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box
from ..operators import tables as tables_, vision
from ..operators.classify import classify
from ..operators.documents import gather, gather_texts
from ..operators.fields import key_values
from ..operators.vision import text_marks
from ..sources import sinks
from ..sources.schemas import Registry
from .extraction import RESULT, extract_documents, field_rows, sections, table_rows
from .render import order_items, render_lines, render_pages, tractor_lines

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_ITEMS = """items AS (SELECT l_orderkey AS k, l_linenumber AS n, p_name AS item, l_quantity AS qty, (2 * cents + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT)) / 100 AS unit_price,
        cents * (CASE WHEN l_orderkey % 7 = 0 AND l_linenumber = 1 THEN 100 - CAST(round(l_discount * 100) AS BIGINT) ELSE 100 END) // 100 / 100 AS amount
        FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem) JOIN part ON l_partkey = p_partkey),
    sums AS (SELECT k, count(*) AS n_items, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS VARCHAR) AS total, count(*) FILTER (abs(qty * unit_price - amount) > 1.0) AS off FROM items GROUP BY k),
    docs AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, * FROM sums JOIN orders ON k = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
_BODY = "CAST(n AS VARCHAR) || ' ' || item || ' ' || CAST(CAST(qty AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(unit_price AS DECIMAL(18,2)) AS VARCHAR) || ' ' || CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR)"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = Registry.shared()
    return tables_.exclude_tables(tables_.detect_tables(classify(gather(render_lines(spark, sf_dir)), registry), registry))


@query(f"""WITH {_ITEMS}, h AS (SELECT doc_id, unnest([0, 1, 2, 3, 4, 10000, 10001, 10002, 10003]) AS line_idx, unnest(['SPICE GARDEN RESTAURANT', 'TAX INVOICE (RECEIPT)', 'Invoice No : INV-' || doc_id || '    Date : ' || strftime(o_orderdate, '%d/%m/%Y'),
        'Table No : T-' || CAST(o_orderkey % 40 AS VARCHAR) || '    Cashier : ' || c_name, 'S.No. Item Name Qty Unit Price Amount (₹)', 'Subtotal ' || total, 'Grand Total ₹ ' || total, 'Payment Mode : UPI', 'THANK YOU! VISIT AGAIN']) AS text FROM docs)
    SELECT doc_id, line_idx, text FROM h UNION ALL SELECT CAST(k AS VARCHAR), n + 100, {_BODY} FROM items WHERE k IN (SELECT k FROM docs)""")
def render_invoice_lines(spark, sf_dir):
    lines = render_lines(spark, sf_dir).select("doc_id", "line_idx", "text")
    return lines.join(gather_keys(spark, sf_dir), "doc_id", "left_semi")


def gather_keys(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").join(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return o.select(F.col("o_orderkey").cast("string").alias("doc_id"))


@query(f"WITH {_ITEMS} SELECT doc_id, 'restaurant_receipt' AS document_type FROM docs")
def classify_documents(spark, sf_dir):
    return classify(gather(render_lines(spark, sf_dir)), Registry.shared()).select("doc_id", "document_type")


@query(f"WITH {_ITEMS} SELECT doc_id, 'line_items' AS name, 4 AS header_idx, 5 + n_items AS end_idx, n_items AS n_body FROM docs")
def table_regions(spark, sf_dir):
    return _typed(spark, sf_dir).select("doc_id", F.explode_outer("regions").alias("r")).filter("r IS NOT NULL").select("doc_id", "r.name", "r.header_idx", "r.end_idx", F.size("r.body").alias("n_body"))


@query(f"WITH {_ITEMS} SELECT doc_id, 9 + n_items AS n_lines, 8 AS n_active FROM docs")
def table_line_exclusion(spark, sf_dir):
    return _typed(spark, sf_dir).select("doc_id", F.size("lines").alias("n_lines"), F.size("active").alias("n_active"))


@query(f"""WITH {_ITEMS}, b AS (SELECT CAST(k AS VARCHAR) AS doc_id, *, {_BODY} AS text FROM items WHERE k IN (SELECT k FROM docs))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, text) AS row_index, CAST(n AS DOUBLE) AS sno, item, qty, unit_price, amount FROM b""")
def extracted_table_rows(spark, sf_dir):
    docs = tables_.extract_tables(_typed(spark, sf_dir), Registry.shared())
    cell = lambda n: F.col("cells")[n]
    return table_rows(docs).select("doc_id", "row_index", cell("sno")["value_num"].alias("sno"), cell("item")["value_str"].alias("item"), *[cell(n)["value_num"].alias(n) for n in ("qty", "unit_price", "amount")])


@query(f"""WITH {_ITEMS} SELECT CAST(k AS VARCHAR) AS doc_id, count(*) AS n_rows, round(sum(qty), 2) AS qty, round(sum(amount), 2) AS amount FROM items WHERE k IN (SELECT k FROM docs) GROUP BY k""")
def table_token_fallback(spark, sf_dir):
    items = order_items(spark, sf_dir).join(gather_keys(spark, sf_dir), F.col("order_key").cast("string") == F.col("doc_id"), "left_semi")
    key = F.col("order_key").cast("string").alias("doc_id")
    text = F.concat_ws("|", F.col("line_number").cast("string"), F.concat("item", F.lit(" *")), F.col("qty").cast("string"), F.col("unit_price").cast("string"), F.concat(F.lit("Rs."), F.col("amount").cast("decimal(18,2)").cast("string")))
    body = items.select(key, F.col("line_number").alias("line_idx"), F.lit(1).alias("page"), text.alias("text"), box(0, 0, 0, 0).alias("bbox"), F.lit(1.0).alias("confidence"))
    head = items.select(key).distinct().select("doc_id", F.lit(-1).alias("line_idx"), F.lit(1).alias("page"), F.lit("S.No | Item | Qty | Price | Amount").alias("text"), box(0, 0, 0, 0).alias("bbox"), F.lit(1.0).alias("confidence"))
    registry = Registry.shared()
    docs = classify(gather(head.unionByName(body)), registry, forced="restaurant_receipt")
    rows = table_rows(tables_.extract_tables(tables_.detect_tables(docs, registry), registry))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.round(F.sum(F.col("cells")["qty"]["value_num"]), 2).alias("qty"), F.round(F.sum(F.col("cells")["amount"]["value_num"]), 2).alias("amount"))


@query(f"WITH {_ITEMS} SELECT doc_id, off AS mismatches FROM docs")
def row_formula_check(spark, sf_dir):
    docs = tables_.extract_tables(_typed(spark, sf_dir), Registry.shared())
    return docs.select("doc_id", tables_.row_mismatches(F.get("tables", F.lit(0))["rows"], "qty * unit_price == amount").cast("long").alias("mismatches"))


@query(f"""WITH {_ITEMS} SELECT doc_id, unnest(['invoice_number', 'invoice_date', 'table_number', 'cashier', 'subtotal', 'grand_total', 'payment_mode']) AS field,
    unnest(['INV-' || doc_id, strftime(o_orderdate, '%d/%m/%Y'), 'T-' || CAST(o_orderkey % 40 AS VARCHAR), c_name, total, '₹ ' || total, 'UPI']) AS value FROM docs""")
def kv_inline_fields(spark, sf_dir):
    docs = key_values(_typed(spark, sf_dir), Registry.shared())
    return docs.select("doc_id", F.explode_outer("kv").alias("p")).filter("p IS NOT NULL").select("doc_id", "p.field", "p.value")


@query(f"""WITH {_ITEMS} SELECT doc_id, unnest(['invoice_no', 'table_no']) AS field_name,
    unnest(['INV-' || doc_id || '    Date : ' || strftime(o_orderdate, '%d/%m/%Y'), 'T-' || CAST(o_orderkey % 40 AS VARCHAR) || '    Cashier : ' || c_name]) AS value FROM docs""")
def generic_kv(spark, sf_dir):
    """Without a schema's stop words the table reaches down to the thanks, and what it takes is no field."""
    docs = extract_documents(render_lines(spark, sf_dir), document_type="generic", columns=_OF_FIELDS)
    return field_rows(docs).select("doc_id", "field_name", F.col("value_str").alias("value"))


#: What queries take of extracted documents.
_OF_FIELDS = ("doc_id", "document_type", "fields")
_DECIDED = "CASE WHEN off > 0 THEN 0.909 ELSE 0.959 END"


@query(f"WITH {_ITEMS} SELECT doc_id, 'restaurant_receipt' AS document_type, CAST({_DECIDED} AS DOUBLE) AS overall_confidence, 'AUTO_APPROVE' AS decision, CAST(off > 0 AS INT) AS n_warnings, 0 AS n_errors FROM docs")
def overall_confidence_decision(spark, sf_dir):
    docs = extract_documents(render_lines(spark, sf_dir), columns=("doc_id", "document_type", "overall_confidence", "decision", "warnings", "errors"))
    return docs.select("doc_id", "document_type", "overall_confidence", "decision", F.size("warnings").alias("n_warnings"), F.size("errors").alias("n_errors"))


@query(f"""WITH {_ITEMS} SELECT doc_id, unnest(['merchant_name', 'invoice_number', 'invoice_date', 'table_number', 'cashier', 'subtotal', 'grand_total', 'payment_mode']) AS field_name,
    unnest(['position_header_first', 'layout_kv_inline', 'layout_kv_inline', 'layout_kv_inline', 'layout_kv_inline', 'layout_kv_inline', 'layout_kv_inline', 'layout_kv_inline']) AS method,
    unnest([0.931, 0.96, 0.96, 0.96, 0.96, 0.96, 0.96, 0.96]) AS confidence, unnest([NULL, NULL, NULL, NULL, NULL, CAST(total AS DOUBLE), CAST(total AS DOUBLE), NULL]) AS value_num FROM docs""")
def extracted_fields(spark, sf_dir):
    return field_rows(extract_documents(render_lines(spark, sf_dir), columns=_OF_FIELDS)).select("doc_id", "field_name", "method", "confidence", "value_num")


@query(f"WITH {_ITEMS} SELECT count(*) AS total_processed, count(*) AS successful, 0 AS failed, count(*) AS auto_approve, 0 AS review, 0 AS manual_review FROM docs")
def batch_summary(spark, sf_dir):
    return sinks.batch_summary(extract_documents(render_lines(spark, sf_dir), columns=("decision",)))


@query(f"WITH {_ITEMS} SELECT doc_id, 1 AS merchant, 4 AS metadata, 2 AS totals, 1 AS payment FROM docs")
def sections_nested(spark, sf_dir):
    docs = extract_documents(render_lines(spark, sf_dir), columns=_OF_FIELDS).withColumn("s", sections(Registry.shared()))
    return docs.select("doc_id", *[F.size(F.try_element_at("s", F.lit(n))).alias(n) for n in ("merchant", "metadata", "totals", "payment")])


@query()
def result_json(spark, sf_dir):
    return sinks.result_json(extract_documents(render_lines(spark, sf_dir), columns=RESULT))


@query(f"WITH {_ITEMS} SELECT doc_id, 'INV-' || doc_id AS invoice_number, strftime(o_orderdate, '%d/%m/%Y') AS invoice_date, CAST(NULL AS VARCHAR) AS dealer_name, 'restaurant_receipt' AS document_type FROM docs")
def flat_record(spark, sf_dir):
    return sinks.flat_record(extract_documents(render_lines(spark, sf_dir), columns=(*_OF_FIELDS, "overall_confidence", "decision"))).select("doc_id", "invoice_number", "invoice_date", "dealer_name", "document_type")


@query(f"""WITH {_ITEMS}, f AS (SELECT doc_id, k, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS i, unnest(['Merchant Name', 'Invoice Number', 'Invoice Date', 'Table Number', 'Cashier', 'Subtotal', 'Grand Total', 'Payment Mode']) AS label,
        unnest(['SPICE GARDEN RESTAURANT', 'INV-' || doc_id, strftime(o_orderdate, '%d/%m/%Y'), 'T-' || CAST(o_orderkey % 40 AS VARCHAR), c_name, CAST(CAST(total AS DOUBLE) AS VARCHAR), CAST(CAST(total AS DOUBLE) AS VARCHAR), 'UPI']) AS value FROM docs),
    g AS (SELECT doc_id, string_agg('  ' || rpad(label, 24, ' ') || value || CASE WHEN i = 0 THEN ' (0.93)' ELSE ' (0.96)' END, chr(10) ORDER BY i) AS fields FROM f GROUP BY doc_id),
    r AS (SELECT CAST(k AS VARCHAR) AS doc_id, string_agg(rpad(CAST(n AS VARCHAR), 18, ' ') || rpad(item, 18, ' ') || rpad(CAST(CAST(qty AS BIGINT) AS VARCHAR), 18, ' ') || rpad(CAST(CAST(unit_price AS DECIMAL(18,2)) AS VARCHAR), 18, ' ')
        || rpad(CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR), 18, ' '), chr(10) || '  ' ORDER BY n, {_BODY}) AS rows FROM items GROUP BY k)
    SELECT doc_id, 'Restaurant Receipt / Food Tax Invoice (0.98)' || chr(10) || fields || chr(10) || '  [line_items]' || chr(10) || '  ' || rows || chr(10) || 'Decision: AUTO_APPROVE' AS card FROM g JOIN r USING (doc_id)""")
def result_cards(spark, sf_dir):
    return sinks.cards(extract_documents(render_lines(spark, sf_dir), columns=("doc_id", "title", "type_confidence", "fields", "tables", "decision")))


@query(f"WITH {_ITEMS} SELECT doc_id, 2 AS n_marks, 0 AS n_present FROM docs")
def text_document_marks(spark, sf_dir):
    docs = text_marks(classify(gather(render_lines(spark, sf_dir)), Registry.shared(), forced="tractor_invoice"), Registry.shared())
    return docs.select("doc_id", F.size("marks").alias("n_marks"), F.size(F.filter("marks", lambda m: m["present"])).alias("n_present"))


@query(f"WITH {_ITEMS} SELECT doc_id, 'INV-' || doc_id AS invoice_number, n_items AS n_rows, CASE WHEN off > 0 THEN 1 ELSE 0 END AS n_warnings FROM docs")
def stream_extract(spark, sf_dir):
    """Whole texts through the streaming plan, read back from its sink."""
    from ..sources.files import work_dir
    from ..streaming.extract import extract_texts, write_stream

    home = work_dir(spark, "stream")
    gather_texts(render_lines(spark, sf_dir)).write.option("compression", "zstd").parquet(f"{home}/in")
    stream = spark.readStream.schema("doc_id string, text string").option("maxFilesPerTrigger", 1000).parquet(f"{home}/in")
    write_stream(extract_texts(stream, columns=("doc_id", "fields", "tables", "warnings")), f"{home}/out", f"{home}/state").awaitTermination()
    docs = spark.read.parquet(f"{home}/out")
    value = F.get(F.filter("fields", lambda f: f["field"] == "invoice_number"), F.lit(0))["value_str"]
    return docs.select("doc_id", value.alias("invoice_number"), F.size(F.get("tables", F.lit(0))["rows"]).alias("n_rows"), F.size("warnings").alias("n_warnings"))


@query("""WITH d AS (SELECT s_suppkey AS key, unnest(['clean', 'blur', 'noise', 'rotation_90', 'rotation_180', 'low_contrast', 'downscale']) AS condition FROM supplier),
    p AS (SELECT *, CASE WHEN key % 2 = 0 THEN 240 ELSE 320 END AS h, CASE WHEN key % 2 = 0 THEN 320 ELSE 240 END AS w FROM d)
    SELECT key, condition, CASE WHEN condition = 'rotation_90' THEN w ELSE h END AS height, CASE WHEN condition = 'rotation_90' THEN h ELSE w END AS width,
    CASE WHEN (key % 2 = 0) <> (condition = 'rotation_90') THEN 90 ELSE 0 END AS angle FROM p""")
def degraded_pages(spark, sf_dir):
    """Every page under every robustness condition: its size and its orientation."""
    pages = render_pages(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("key")))

    def of(page):
        made = {c: vision.degrade(page, c) for c in vision.CONDITIONS}
        return {"found": [{"condition": c, "height": x.shape[0], "width": x.shape[1], "angle": vision.orientation(x)} for c, x in made.items()]}

    rows = vision.apply_kernel(pages.select(F.col("key").cast("string").alias("path"), "content"), None, of, "found array<struct<condition:string,height:int,width:int,angle:int>>")
    return rows.select(F.col("path").cast("long").alias("key"), F.explode("found").alias("f")).select("key", "f.*")


@query("""SELECT s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN 90 ELSE 0 END AS angle, s_suppkey % 3 = 0 AS stamp, s_suppkey % 5 = 0 AS signature,
    CASE WHEN s_suppkey % 3 = 0 THEN 0.96 ELSE 0.15 END AS stamp_confidence, CASE WHEN s_suppkey % 3 = 0 THEN 170 ELSE -1 END AS stamp_x0, CASE WHEN s_suppkey % 3 = 0 THEN 215 ELSE -1 END AS stamp_y1 FROM supplier""")
def page_marks(spark, sf_dir):
    """The marks of every page, set upright first."""
    pages = render_pages(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("key")))

    def of(page):
        upright, done = vision.preprocess(page, deskew=False, contrast=False, noise=False)
        stamp, signature = (vision.detect_mark(k, upright) for k in ("stamp", "signature"))
        at = stamp["bbox"] or [-1.0] * 4
        return {"angle": done["orientation_angle_corrected"], "stamp": stamp["present"], "signature": signature["present"], "stamp_confidence": stamp["confidence"], "stamp_x0": at[0], "stamp_y1": at[3]}

    rows = vision.apply_kernel(pages.select(F.col("key").cast("string").alias("path"), "content"), None, of, "angle int, stamp boolean, signature boolean, stamp_confidence double, stamp_x0 double, stamp_y1 double")
    return rows.select(F.col("path").cast("long").alias("key"), "angle", "stamp", "signature", "stamp_confidence", F.col("stamp_x0").cast("int").alias("stamp_x0"), F.col("stamp_y1").cast("int").alias("stamp_y1"))


def _catalogs() -> tuple[list[str], list[str]]:
    """Dealers and models; a model that holds a label's words is left out, as it would be read as that label."""
    fields = {f.name: f for f in Registry.shared().get("tractor_invoice").fields}
    labels = [a for f in fields.values() for a in f.aliases]
    return list(fields["dealer_name"].catalog), [m for m in fields["model_name"].catalog if not any(a in m.lower() for a in labels)]


def _tractors_sql() -> str:
    of = lambda names: "['" + "', '".join(n.replace("'", "''") for n in names) + f"'][CAST(o_orderkey % {len(names)} AS INT) + 1]"
    dealers, models = _catalogs()
    return f"""t AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, ['inline', 'right', 'below', 'out_of_range', 'no_cost', 'in_text', 'unknown'][CAST(o_orderkey % 7 AS INT) + 1] AS shape, {of(dealers)} AS dealer, {of(models)} AS model,
        CASE WHEN o_orderkey % 7 = 3 THEN 180 + o_orderkey % 10 ELSE 20 + o_orderkey % 60 END AS hp, (300 + o_orderkey % 500) * 1000 AS cost, 'TR-' || CAST(o_orderkey AS VARCHAR) AS number, strftime(o_orderdate, '%d/%m/%Y') AS date, c_name
        FROM orders JOIN customer ON o_custkey = c_custkey),
    m AS (SELECT *, CASE shape WHEN 'right' THEN 'layout_kv_right' WHEN 'below' THEN 'layout_kv_below' ELSE 'layout_kv_inline' END AS method, CASE shape WHEN 'right' THEN 0.94 WHEN 'below' THEN 0.95 ELSE 0.96 END AS sure FROM t)"""


@query(f"""WITH {_tractors_sql()} SELECT doc_id, f.name AS field_name, f.value AS value, f.num AS value_num, CASE WHEN f.name = 'horse_power' AND shape = 'in_text' THEN 'regex_pattern' ELSE method END AS method,
        CASE WHEN f.name = 'horse_power' AND shape = 'in_text' THEN 0.9215 ELSE sure END AS confidence FROM (SELECT *, unnest([
            {{'name': 'dealer_name', 'value': dealer, 'num': CAST(NULL AS DOUBLE)}}, {{'name': 'model_name', 'value': model, 'num': NULL}}, {{'name': 'invoice_number', 'value': number, 'num': NULL}}, {{'name': 'invoice_date', 'value': date, 'num': NULL}},
            {{'name': 'customer_name', 'value': c_name, 'num': NULL}}, {{'name': 'horse_power', 'value': CAST(hp AS VARCHAR), 'num': CAST(hp AS DOUBLE)}}, {{'name': 'asset_cost', 'value': CAST(cost AS VARCHAR) || '.0', 'num': CAST(cost AS DOUBLE)}}]) AS f FROM m)
    WHERE shape <> 'unknown' AND NOT (shape = 'no_cost' AND f.name = 'asset_cost')""")
def tractor_fields(spark, sf_dir):
    """Fields of tractor invoices of all shapes: from the label's line, from beside it, from below, from a pattern."""
    rows = field_rows(extract_documents(tractor_lines(spark, sf_dir, *_catalogs()), columns=_OF_FIELDS))
    return rows.select("doc_id", "field_name", F.col("value_str").alias("value"), "value_num", "method", "confidence")


@query(f"""WITH {_tractors_sql()}, d AS (SELECT doc_id, shape, hp,
        CASE shape WHEN 'right' THEN 0.94 WHEN 'below' THEN 0.95 WHEN 'out_of_range' THEN 0.66 WHEN 'no_cost' THEN 0.81 WHEN 'in_text' THEN 0.955 WHEN 'unknown' THEN 0.5 ELSE 0.96 END AS c FROM m)
    SELECT doc_id, CASE WHEN shape = 'unknown' THEN 'generic' ELSE 'tractor_invoice' END AS document_type, CAST(c AS DOUBLE) AS overall_confidence,
        CASE WHEN shape = 'unknown' OR c < 0.70 THEN 'MANUAL_REVIEW' WHEN c < 0.88 THEN 'REVIEW' ELSE 'AUTO_APPROVE' END AS decision,
        CASE shape WHEN 'out_of_range' THEN '[horse_power_range] Field ''horse_power'' value ' || CAST(hp AS VARCHAR) || ' exceeds maximum allowed (150.0).' WHEN 'no_cost' THEN '[required_field] Mandatory field ''asset_cost'' is missing.' ELSE '' END AS first_error,
        CASE shape WHEN 'out_of_range' THEN 3 WHEN 'no_cost' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END AS n_reasons FROM d""")
def tractor_decisions(spark, sf_dir):
    """Approved, to be reviewed, to be done by hand: decisions on tractor invoices of all shapes."""
    docs = extract_documents(tractor_lines(spark, sf_dir, *_catalogs()), columns=("doc_id", "document_type", "overall_confidence", "decision", "errors", "review_reasons"))
    first = F.coalesce(F.get("errors", F.lit(0)), F.lit(""))
    return docs.select("doc_id", "document_type", F.round("overall_confidence", 3).alias("overall_confidence"), "decision", first.alias("first_error"), F.size("review_reasons").alias("n_reasons"))


@query(f"""WITH {_ITEMS} SELECT count(*) AS total_processed, count(*) FILTER (k % 10 <> 0) AS successful, count(*) FILTER (k % 10 = 0) AS failed,
    count(*) FILTER (k % 10 <> 0) AS auto_approve, 0 AS review, 0 AS manual_review FROM docs""")
def batch_with_broken_documents(spark, sf_dir):
    """A batch in which every tenth file is no text: each fails by itself, the others go through."""
    from ..service import extract_files

    texts = gather_texts(render_lines(spark, sf_dir))
    broken = F.col("doc_id").cast("long") % 10 == 0
    files = texts.select(F.concat("doc_id", F.lit(".txt")).alias("path"), F.when(broken, F.concat(F.unhex(F.lit("FFFE")), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary")).alias("content"))
    docs = extract_files(files, columns=("decision",))
    return sinks.batch_summary(docs, F.col("error").isNotNull())
