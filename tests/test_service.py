"""Files in, results out: command line, batches, evaluation, robustness."""

import json

import numpy as np
import pytest

from docloom import service
from docloom.__main__ import main
from docloom.operators import imaging, vision

INVOICE = "TRACTOR TAX INVOICE\nAuthorised Dealer : Swaraj Tractors Ltd.\nModel Name : Swaraj 744 FE\nHorse Power : 48\nTotal Cost : Rs. 6,80,000.00\nInvoice No : SW-78901\n"


def test_help_and_missing_files(capsys):
    with pytest.raises(SystemExit) as e:
        main(["--help"])
    assert e.value.code == 0 and "predict" in capsys.readouterr().out
    assert main(["no_such_file.pdf"]) == 1 and "Input file not found" in capsys.readouterr().err
    assert main(["batch", "no_such_folder"]) == 1 and main([]) == 1


def test_predict_writes_the_result(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text(INVOICE)
    assert main([str(tmp_path / "a.txt"), "--output", str(tmp_path / "out" / "a.json")]) == 0
    assert "EXTRACTION RESULT" in (out := capsys.readouterr().out) and "Swaraj Tractors Ltd." in out
    found = json.loads((tmp_path / "out" / "a.json").read_text())
    assert found["document_type"] == "tractor_invoice" and found["fields"]["horse_power"]["value"] == 48.0 and found["fields"]["asset_cost"]["value"] == 680000.0
    assert found["visual_marks"]["stamp"]["status"] == "not_implemented" and not found["review_required"]


def test_each_file_of_a_batch_fails_by_itself(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text(INVOICE)
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe not text")
    (tmp_path / "c.png").write_bytes(b"broken")
    (tmp_path / "d.txt").write_text("")
    assert main(["batch", str(tmp_path), "-o", str(tmp_path / "out")]) == 0
    out = capsys.readouterr().out
    assert "total_processed=4 successful=2 failed=2" in out and "no recogniser" in out
    assert json.loads((tmp_path / "out" / "b_result.json").read_text())["status"] == "error"
    rows = service.extract_files(service.read_files(spark, [f"file://{tmp_path}/a.txt", f"file://{tmp_path}/none.txt"])).collect()
    assert sorted((r.error or "")[:17] for r in rows) == ["", "FileNotFoundError"]


def recognise(page):
    """A recogniser of pages whose first pixels say what they are, if they have their brightness."""
    if page[0, 0, 0] != 7:
        return []
    return [(t, (10.0, 30.0 * k, 300.0, 30.0 * k + 20), 0.97) for k, t in enumerate(INVOICE.strip().split("\n"))]


def test_evaluation_falls_back_on_the_samples(spark, tmp_path, capsys):
    found = service.evaluate_folder(spark, f"file://{tmp_path}")
    by = {f["field_name"]: f for f in found["fields"]}
    assert found["documents"] == 5 and set(by) == {"dealer_name", "model_name", "horse_power", "asset_cost", "invoice_number", "invoice_date", "customer_name", "phone_number"}
    assert all(f["support"] == 5 for f in by.values())
    # in the table's heads and in the total's line, words stand where a value would, so two fields are not found
    assert {k for k, f in by.items() if f["em"] == 1.0} == set(by) - {"model_name", "asset_cost"} and found["document_accuracy"] == 0.0


def test_evaluation_and_robustness(spark, tmp_path):
    for d in ("samples", "ground_truth"):
        (tmp_path / d).mkdir()
    for k in range(3):
        (tmp_path / "samples" / f"s{k}.txt").write_text(INVOICE if k else INVOICE.replace("48", "52"))
        (tmp_path / "ground_truth" / f"s{k}.json").write_text(json.dumps({"doc_id": f"s{k}", "horse_power": 48.0, "dealer_name": "Swaraj Tractors Ltd."}))
    found = service.evaluate_folder(spark, f"file://{tmp_path}")
    assert found["documents"] == 3 and abs(found["document_accuracy"] - 0.6667) < 1e-3
    report = service.evaluation_report(found)
    assert "| Dealer Name | 100.0% |" in report and "| Horse Power | 66.7% |" in report
    page = np.full((40, 60, 3), 7, np.uint8)
    images = spark.createDataFrame([("p.png", imaging.encode_png(page))], "path string, content binary")
    truth = spark.createDataFrame([("p.png", "horse_power", "48")], "doc_id string, field_name string, expected string")
    rows = {r["condition"]: r for r in service.robustness(images, truth, recognise, {k: service.CONDITIONS[k] for k in ("clean", "rotation_90", "low_contrast")})}
    assert rows["clean"]["document_accuracy"] == rows["rotation_90"]["document_accuracy"] == 1.0 and rows["low_contrast"]["drop"] == 1.0
    assert "| low_contrast | underexposed | 0.0% | 0.0% | -100.0% |" in service.robustness_report(list(rows.values()))
    assert set(service.CONDITIONS) <= set(vision.CONDITIONS)
