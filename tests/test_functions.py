import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import similarity as S
from docloom.functions import text as T
from docloom.functions.expressions import names, parse_formula, to_column
from docloom.functions.patterns import alias_pattern, match_spans
from docloom.operators import baseline


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t"))).collect()]


def test_numbers(spark):
    assert values(spark, T.parse_numeric, ["5,50,000", "Rs. 1,200.50", "Discount (10%) -121.00", "abc", "", None]) == [550000.0, 1200.5, 121.0, None, None, None]
    assert values(spark, T.plain_number, ["55,00,000.50", "abc", ""]) == [5500000.5, None, None]


def test_values_and_labels(spark):
    assert values(spark, T.clean_value, [" : - x y | ", "--", "a-b"]) == ["x y", "", "a-b"]
    assert values(spark, T.normalize_text, ["  A \t B\n", ""]) == ["a b", ""]
    cut = values(spark, T.split_label, ["Name : John: x", "none"])
    assert (cut[0].label, cut[0].value, cut[1]) == ("Name", "John: x", None)


def test_lines_drop_blanks_and_renumber(spark):
    found = values(spark, T.split_lines, ["a\r\n\n  \n b\x0bc", "", None])
    assert [(x.line_idx, x.text) for x in found[0]] == [(0, "a"), (1, " b"), (2, "c")]
    assert found[1] == [] and found[2] is None


@pytest.mark.parametrize("text,status", [("16/05/2025", "ok"), ("2025-5-6", "ok"), ("1/1/1990", "error"), ("31/31/2020", "warning"), ("x", "warning")])
def test_dates(spark, text, status):
    assert values(spark, T.valid_date, [text])[0].status == status


def test_phones(spark):
    assert values(spark, T.valid_mobile, ["+91 9876543210", "9876543210", "1234567890", "98765"]) == [True, True, False, False]


def test_match_values(spark):
    rows = spark.createDataFrame([("621000", "621000.00"), ("abc ltd", "abc"), ("a", "b")], "a string, b string")
    assert [r[0] for r in rows.select(T.values_match(F.col("a"), F.col("b"))).collect()] == [True, True, False]


def test_horse_power_and_cost(spark):
    assert values(spark, baseline.horse_power, ["Horse Power: 50 HP", "50 hp", "HP - 300", "none", "Engine Power 45"]) == [50.0, 50.0, None, None, 45.0]
    assert values(spark, baseline.asset_cost, ["Grand Total: Rs. 5,50,000/-", "Total (Rs.) 900", "price 2000"]) == [550000.0, None, 2000.0]


def test_label_spans_match_python(spark):
    import re

    texts = ["Date : 1 date: 2 Dated", "x date", "DATE-1\tdate", "update", ""]
    spans = lambda c: F.transform(match_spans(c, F.lit(alias_pattern("date"))), lambda m: F.struct(m["start"], m["end"]))
    want = [[m.span() for m in re.finditer(r"(?:^|[\x08\s])date\s*[:\-]?", t, re.I)] for t in texts]
    assert [[tuple(x) for x in r] for r in values(spark, spans, texts)] == want


def test_expressions(spark):
    assert names("abs(a - b) <= 1 and max(a, 0) > 0") == ["a", "b"]
    assert parse_formula("qty * price == amount") == ("qty * price", "amount")
    row = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    assert row.select(to_column("1 < a < b and not a == b", F.col), to_column("a / 0", F.col)).first()[:] == (True, None)
    with pytest.raises(ValueError):
        to_column("__import__('os')", F.col)


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert S.common_length(a, b) == table[-1][-1]


def test_ratios():
    assert S.token_sort_ratio("b a", "a b") == 100 and S.token_set_ratio("a b c", "a b") == 100
    assert S.partial_ratio("abc", "xxabcxx") == 100 and S.token_set_ratio("", "a") == 0
    assert S.composite_score(S.normalized("M/s Mahindra Tractor Ltd"), S.normalized("Mahindra Tractors Ltd.")) >= 80


def test_boxes(spark):
    row = spark.range(1).select(G.iou(G.box(0, 0, 10, 10), G.box(0, 0, 10, 10)), G.iou(G.box(0, 0, 1, 1), G.box(5, 5, 6, 6)), G.width(G.box(10, 20, 50, 40)), G.center_y(G.box(10, 20, 50, 40))).first()
    assert tuple(row) == (1.0, 0.0, 40.0, 30.0)
    poly = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((1, 5), (9, 5), (9, 7), (1, 7))])
    assert tuple(spark.range(1).select(G.from_polygon(poly)).first()[0]) == (1.0, 5.0, 9.0, 7.0)


def test_reading_order(spark):
    items = spark.createDataFrame([("2R", 200, 52), ("1L", 10, 10), ("2L", 10, 50), ("1R", 200, 12)], "t string, x int, y int")
    docs = items.select(F.struct("t", G.box(F.col("x"), F.col("y"), F.col("x") + 50, F.col("y") + 20).alias("bbox")).alias("i")).agg(F.collect_list("i").alias("items"))
    assert [x.t for x in docs.select(G.reading_order(F.col("items"))).first()[0]] == ["1L", "1R", "2L", "2R"]
