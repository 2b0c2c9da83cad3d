import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import confidence, evaluate, match, rules, spatial
from docloom.plans.extraction import extract_documents, field_rows, table_rows
from docloom.sources import sinks
from docloom.sources.files import ground_truth, load_config
from docloom.sources.lines import given_lines, recognised_lines, text_lines
from docloom.sources.schemas import Registry, dimension, load_schema, parse_schema

RECEIPT = [
    ("SPICE GARDEN RESTAURANT", (100, 50, 400, 80), 0.98), ("GOOD FOOD • GOOD MOOD", (120, 85, 380, 105), 0.95), ("123, Green Park Extension", (130, 110, 370, 130), 0.96), ("New Delhi - 110016", (160, 135, 340, 155), 0.96),
    ("Phone: 011-41234567", (150, 160, 350, 180), 0.97), ("TAX INVOICE (RECEIPT)", (140, 200, 360, 225), 0.99), ("Invoice No : SG/24-25/0789    Date : 16/05/2025", (50, 240, 450, 260), 0.98),
    ("Order No : 45    Time : 08:35 PM", (50, 265, 450, 285), 0.97), ("Table No : T-07    Cashier : Rahul", (50, 290, 450, 310), 0.97), ("S.No. Item Name Qty Unit Price Amount (₹)", (50, 330, 450, 350), 0.98),
    ("1 Vegetable Spring Roll 1 120.00 120.00", (50, 360, 450, 380), 0.98), ("6 Garlic Naan 2 60.00 120.00", (50, 485, 450, 505), 0.98), ("Subtotal 1,210.00", (200, 600, 450, 620), 0.98), ("Discount (10%) -121.00", (200, 625, 450, 645), 0.97),
    ("Taxable Amount 1,089.00", (200, 660, 450, 680), 0.98), ("CGST (2.5%) 27.23", (200, 685, 450, 705), 0.97), ("SGST (2.5%) 27.23", (200, 710, 450, 730), 0.97), ("Grand Total ₹ 1,143.00", (200, 745, 450, 770), 0.99),
    ("Amount in Words: One Thousand One Hundred Forty Three Only", (50, 785, 450, 805), 0.97), ("Payment Mode : UPI", (50, 825, 300, 845), 0.98), ("UPI Ref No : 512345678901", (50, 850, 350, 870), 0.98),
    ("Payment Status : Paid", (50, 875, 300, 895), 0.98), ("THANK YOU! VISIT AGAIN", (120, 920, 380, 945), 0.99),
]
TRACTOR = ["TAX INVOICE", "M/s Mahindra Tractors Ltd.", "Tractor Arjun Novo 605 DI", "Horse Power: 50 HP", "Asset Cost: 5,50,000"]
GENERIC = ["City Hospital", "Patient Name: John Doe", "Age: 45", "Age: 46"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("r", i, t, b, c) for i, (t, b, c) in enumerate(RECEIPT)] + [("t", i, t, None, 0.95) for i, t in enumerate(TRACTOR)] + [("g", i, t, None, 0.9) for i, t in enumerate(GENERIC)]
    rows += [("k", 0, "TAX INVOICE tractor dealer hp", (0, 0, 9, 9), 0.9), ("k", 1, "Horse Power:", (10, 100, 120, 120), 0.9), ("k", 2, "50 HP", (140, 100, 200, 120), 0.9), ("k", 3, "Asset Cost:", (10, 200, 120, 220), 0.9), ("k", 4, "732,780.00", (15, 240, 120, 260), 0.9)]
    return extract_documents(given_lines(spark, rows)).persist()


@pytest.fixture(scope="module")
def by_doc(docs):
    return {r.doc_id: r for r in docs.collect()}


def test_receipt(by_doc):
    r = by_doc["r"]
    f = {x.field: x for x in r.fields}
    assert r.document_type == "restaurant_receipt" and r.type_confidence >= 0.85
    want = {"merchant_name": "SPICE GARDEN RESTAURANT", "invoice_number": "SG/24-25/0789", "invoice_date": "16/05/2025", "order_number": "45", "table_number": "T-07", "cashier": "Rahul", "payment_mode": "UPI", "upi_ref_no": "512345678901", "payment_status": "Paid", "merchant_phone": "011-41234567"}
    assert {k: f[k].value_str for k in want} == want
    assert "Green Park Extension" in f["merchant_address"].value_str and "GOOD FOOD" in f["merchant_tagline"].value_str
    numbers = {"subtotal": 1210, "discount_amount": 121, "taxable_amount": 1089, "cgst_amount": 27.23, "sgst_amount": 27.23, "grand_total": 1143}
    assert {k: f[k].value_num for k in numbers} == numbers
    assert not {"model_name", "horse_power", "asset_cost"} & set(f)
    assert len(r.errors) == 0 and any("Totals balance" in w for w in r.warnings)


def test_receipt_rows(docs):
    rows = {r.row_index: r.cells for r in table_rows(docs).filter("doc_id = 'r'").collect()}
    assert len(rows) == 2 and rows[1]["item"].value_str == "Vegetable Spring Roll" and (rows[2]["qty"].value_num, rows[2]["amount"].value_num) == (2, 120)


def test_tractor_catalogs(by_doc):
    f = {x.field: x for x in by_doc["t"].fields}
    assert by_doc["t"].document_type == "tractor_invoice" and f["horse_power"].value_num == 50 and f["asset_cost"].value_num == 550000
    assert f["dealer_name"].value_str.startswith("Mahindra")


def test_neighbours_fill_empty_labels(by_doc):
    f = {x.field: x for x in by_doc["k"].fields}
    assert (f["horse_power"].value_num, f["horse_power"].method) == (50, "layout_kv_right")
    assert (f["asset_cost"].value_num, f["asset_cost"].method) == (732780, "layout_kv_below")


def test_generic_keeps_the_last_of_a_key(docs, by_doc):
    assert by_doc["g"].document_type == "generic"
    assert {r.field_name: r.value_str for r in field_rows(docs).filter("doc_id = 'g'").collect()} == {"patient_name": "John Doe", "age": "46"}


def test_published_json_and_summary(docs):
    out = {r.doc_id: json.loads(r.json) for r in sinks.result_json(docs).collect()}
    assert out["r"]["decision"] in ("AUTO_APPROVE", "REVIEW") and "merchant" in out["r"]["sections"]
    assert sinks.batch_summary(docs).first().total_processed == 4
    assert sinks.flat_record(docs).filter("doc_id = 't'").first().horse_power == "50"
    assert "Decision:" in sinks.cards(docs).first().card and sinks.result_schema(docs)["type"] == "struct"


def test_empty_documents(spark):
    assert extract_documents(given_lines(spark, [])).count() == 0
    rows = given_lines(spark, [("b", 0, "   ", None, 0.5)])
    r = extract_documents(rows).first()
    assert (r.document_type, r.type_confidence, r.fields, r.overall_confidence) == ("generic", 0.10, [], 0.50)


def test_schemas(tmp_path):
    registry = Registry.shared()
    assert list(registry.schemas) == ["restaurant_receipt", "tractor_invoice", "generic"]
    receipt, tractor = registry.get("restaurant_receipt"), registry.get("tractor_invoice")
    assert (len(receipt.fields), len(receipt.tables[0].columns), len(receipt.rules)) == (23, 5, 2)
    assert (len(tractor.fields), len(tractor.fields[0].catalog), len(tractor.fields[1].catalog), len(tractor.rules), len(tractor.marks)) == (11, 20, 38, 2, 2)
    for shape in ({"a": {"type": "x"}}, {"a": ["b"]}, [{"name": "a"}], ["a"]):
        assert parse_schema({"document_type": "d", "tables": {"t": {"columns": shape}}}).tables[0].columns == ("a",)
    (tmp_path / "bad.yaml").write_text(":\n  - {")
    (tmp_path / "new.yaml").write_text("document_type: new\nfields: {x: {aliases: [x]}}\n")
    assert load_schema(tmp_path / "bad.yaml") is None and list(Registry.load(tmp_path).schemas) == ["new"]


def test_dimensions(spark):
    registry = Registry.shared()
    counts = {n: dimension(spark, registry, n).count() for n in ("schema", "field", "catalog", "rule", "mark", "table")}
    assert counts == {"schema": 3, "field": 35, "catalog": 58, "rule": 4, "mark": 2, "table": 2}


def test_sources(spark, tmp_path):
    (tmp_path / "s1.json").write_text(json.dumps({"doc_id": "s1", "dealer_name": "A", "asset_cost": 5}))
    assert {(r.field_name, r.expected) for r in ground_truth(spark, str(tmp_path)).collect()} == {("dealer_name", "A"), ("asset_cost", "5")}
    assert load_config(str(tmp_path / "none.json")) == {} and load_config(str(tmp_path / "s1.json"))["doc_id"] == "s1"
    pages = spark.createDataFrame([("a", '[[[[1,2],[5,2],[5,9],[1,9]],["Hi",0.9]]]'), ("b", '{"texts":["x"," "],"boxes":[[1,2]]}'), ("c", None)], "doc_id string, ocr string")
    got = {r.doc_id: r for r in recognised_lines(pages).collect()}
    assert set(got) == {"a", "b"} and got["a"].text == "Hi" and tuple(got["a"].bbox) == (1, 2, 5, 9) and got["a"].confidence == 0.9 and tuple(got["b"].bbox) == (0, 0, 0, 0)
    assert text_lines(spark.createDataFrame([(1, None), (2, "a\nb")], "doc_id int, text string")).count() == 2


def test_catalog_scans(spark):
    lines = spark.createDataFrame([("d", 0, "Dealer: Swaraj Tractors Ltd", 0.9), ("d", 1, "abc", 0.9)], "doc_id string, line_idx int, text string, confidence double")
    dealers = ["Mahindra Tractors Ltd.", "Swaraj Tractors Ltd."]
    assert match.scan_lines(lines, dealers, "dealer").first().name == "Swaraj Tractors Ltd."
    q = spark.createDataFrame([("Tractor Arjun Novo 605 DI sale",), ("",)], "q string").select(match.model_candidates(F.col("q"), ["Arjun Novo 605 DI", "Yuvraj 215"]).alias("c")).collect()
    assert (q[0].c[0].name, q[0].c[0].match_type, q[0].c[0].confidence) == ("Arjun Novo 605 DI", "exact", 0.98) and q[1].c == []


def test_rules(spark):
    fields = spark.createDataFrame([("a", "horse_power", "600", 600.0), ("a", "model_name", "", None), ("b", "dealer_name", "D", None), ("b", "model_name", "M", None), ("b", "horse_power", "50", 50.0), ("b", "asset_cost", "550000", 550000.0)], "doc_id string, field_name string, value_str string, value_num double")
    docs_ = {r.doc_id: r for r in rules.RuleEngine().validate(fields)[1].collect()}
    assert docs_["a"].blocking and any("is outside" in m for m in docs_["a"].messages) and any("model_name: required field is missing" == m for m in docs_["a"].messages)
    assert not docs_["b"].blocking and docs_["b"].messages == []


def test_calibration(spark):
    y, p = (1, 1, 0, 1, 0, 1, 1, 0, 1, 0), (0.9, 0.8, 0.2, 0.7, 0.3, 0.95, 0.85, 0.4, 0.6, 0.1)
    scored = spark.createDataFrame(list(zip(y, p)), "y int, p double")
    assert 0 <= confidence.ece(scored, 5).first().ece <= 1 and confidence.brier(scored).first().brier == pytest.approx(sum((a - b) ** 2 for a, b in zip(y, p)) / 10, abs=1e-4)
    assert confidence.Calibrator().calibrate(scored).first().calibrated == 0.9
    fitted = confidence.Calibrator().fit(scored).calibrate(spark.createDataFrame([(0.85,), (0.1,)], "p double")).collect()
    assert fitted[0].calibrated > fitted[1].calibrated


def test_evaluation(spark):
    truth = spark.createDataFrame([("1", "a", "x"), ("1", "b", "5"), ("2", "a", "y"), ("2", "b", "")], "doc_id string, field_name string, expected string")
    got = spark.createDataFrame([("1", "a", "x ltd"), ("1", "b", "6"), ("2", "b", "")], "doc_id string, field_name string, actual string")
    compared = evaluate.compare(truth, got)
    assert {(r.doc_id, r.field_name): r.outcome for r in compared.collect()} == {("1", "a"): "tp", ("1", "b"): "fp", ("2", "a"): "fn", ("2", "b"): "none"}
    m = {r.field_name: r for r in evaluate.field_metrics(compared).collect()}
    assert (m["a"].recall, m["b"].recall, m["b"].f1) == (0.5, 1.0, 0.0) and evaluate.document_accuracy(compared).first()[0] == 0.0
    stages = got.withColumns({"stage": F.lit(1), "confidence": F.lit(0.9)})
    assert [r.stage for r in evaluate.ablation(stages, truth).orderBy("step").collect()] == list(evaluate.ABLATION)


def test_spatial_join_agrees_with_all_pairs(spark):
    rows = [("d", i, (float(x), float(y), float(x + 30), float(y + 12))) for i, (x, y) in enumerate([(0, 0), (50, 2), (400, 0), (-900, 4), (0, 60), (5, 400)])]
    boxes = spark.createDataFrame(rows, "doc_id string, line_idx int, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert {(r.line_idx, r.right_idx) for r in spatial.right_neighbors(boxes).collect()} == {(0, 1), (1, 2)}
    assert (0, 4) in {(r.line_idx, r.below_idx) for r in spatial.below_neighbors(boxes).collect()}

def test_stream_matches_batch(spark, tmp_path):
    from docloom.streaming.extract import extract_texts, read_stream, write_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(GENERIC))
    (tmp_path / "in" / "b.txt").write_text("\n".join(t for t, _, _ in RECEIPT))
    stream = extract_texts(read_stream(spark, str(tmp_path / "in"))).select("doc_id", "document_type", F.size("fields").alias("n"))
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.doc_id[-5:]: (r.document_type, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["a.txt"] == ("generic", 2) and got["b.txt"][0] == "restaurant_receipt"
