"""Queries over whole tables, against plain versions."""

import random

import __spark_entry__ as entry

from docloom.operators.match import nearest_entries

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_nearest_entries(spark):
    random.seed(2)
    word = lambda: "".join(random.choice("abcd") for _ in range(random.randrange(12)))
    texts, names = [*{word() for _ in range(150)}, "zzzz", "", "zzzzzzzzzzzzzzzzzzzz"], sorted({word() for _ in range(60)})
    got = {r.text: (r.entry, r.nled) for r in nearest_entries(spark.createDataFrame([(t,) for t in [*texts, *texts, None]], "text string"), spark.createDataFrame([(n,) for n in [*names, None]], "entry string")).collect()}
    want = {t: min(((distance(t, n) / max(len(t), len(n)) if t or n else 0.0), n) for n in names) for t in texts}
    assert {t: (v[1], v[0]) for t, v in got.items()} == want


def test_every_part_has_a_match(spark):
    part = spark.read.parquet(f"{SF}/../sf0.01/part.parquet")
    names = sorted({r.p_name for r in part.select("p_name").collect()})
    want = {}
    for r in part.collect():
        typed = r.p_name.replace("a", "o")
        want[r.p_partkey] = min((round(distance(typed, n) / max(len(typed), len(n)), 6), n) for n in names)[::-1]
    assert {r.p_partkey: (r.entry, r.nled) for r in entry.queries()["entity_match_levenshtein"](spark, f"{SF}/../sf0.01").collect()} == want


def test_every_line_is_a_box(spark):
    """Each box's nearest right neighbour and its overlap with the next, over all rows."""
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").collect()
    docs = {}
    for r in sorted(rows, key=lambda r: (r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_quantity)):
        x, y = r.l_partkey % 400, r.l_suppkey % 90 * 7
        docs.setdefault(r.l_orderkey, []).append((x, y, x + 20 + float(r.l_quantity), y + 12 + r.l_linenumber))
    right = {}
    for d, boxes in docs.items():
        for i, a in enumerate(boxes, 1):
            found = []
            for j, b in enumerate(boxes, 1):
                ya, yb, ha, hb = (a[1] + a[3]) / 2, (b[1] + b[3]) / 2, a[3] - a[1], b[3] - b[1]
                level = max(0, min(a[3], b[3]) - max(a[1], b[1])) / min(ha, hb) >= 0.3 or abs(ya - yb) <= max(10, (ha + hb) / 2 * 0.6)
                if i != j and -10 <= b[0] - a[2] <= 600 and level:
                    found.append(((max(0, b[0] - a[2]) ** 2 + (ya - yb) ** 2) ** 0.5, j))
            if found:
                right[d, i] = min(found)[1]
    assert len(rows) > len({(r.l_orderkey, r.l_linenumber) for r in rows})
    got = entry.queries()
    assert {(r.doc_id, r.line_idx): r.right_idx for r in got["spatial_right_neighbor"](spark, SF).collect()} == right
    assert {(r.doc_id, r.line_idx) for r in got["box_iou_overlap"](spark, SF).collect()} == {(d, i) for d, b in docs.items() for i in range(1, len(b))}
