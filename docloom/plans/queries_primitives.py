"""Queries over single operators: text, numbers, boxes, similarity, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions.expressions import to_column
from ..functions.similarity import composite, partial, token_set, token_sort
from ..operators import baseline, confidence, evaluate, match, rules, spatial
from ..operators.classify import schema_score
from ..operators.documents import spread
from ..sources.lines import recognised_lines, text_lines
from ..sources.schemas import Registry

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LINES = """
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
    lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS line_idx, text FROM l WHERE trim(text) <> '')
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(_t(spark, sf_dir, "documents")).withColumn("doc_id", F.col("doc_id").cast("long"))


@query(f"WITH {_LINES} SELECT doc_id, line_idx, 1 AS page, text, 1.0 AS confidence FROM lines")
def lines_scan(spark, sf_dir):
    return _lines(spark, sf_dir).drop("bbox")


@query(f"""WITH {_LINES} SELECT doc_id, count(*) AS n_lines, md5(string_agg(text, chr(10) ORDER BY line_idx)) AS full_md5,
    string_agg(lower(text), ' ' ORDER BY line_idx) FILTER (line_idx < 6) AS header_text FROM lines GROUP BY doc_id""")
def full_text_header(spark, sf_dir):
    from ..operators.documents import full_text, gather, header_text

    return gather(_lines(spark, sf_dir)).select("doc_id", F.size("lines").alias("n_lines"), F.md5(full_text(F.col("lines"))).alias("full_md5"), header_text(F.col("lines")).alias("header_text"))


@query("SELECT doc_id, md5(regexp_replace(trim(lower(text), chr(32) || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g')) AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("normalized"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(': - ' || p_name || ' | -', '^[:\\-|\\s]+', ''), '[:\\-|\\s]+$', '') AS cleaned,
    replace(lower(p_name), ' ', '_') AS slug, p_name AS label, p_brand AS value FROM part""")
def clean_and_split(spark, sf_dir):
    rows = _t(spark, sf_dir, "part")
    cut = T.split_label(F.concat("p_name", F.lit(" : "), "p_brand", F.lit(" |")))
    return rows.select("p_partkey", T.clean_value(F.concat(F.lit(": - "), "p_name", F.lit(" | -"))).alias("cleaned"), T.key_slug(F.col("p_name")).alias("slug"), cut["label"].alias("label"), cut["value"].alias("value"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice AS parsed, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END AS plain, l_quantity AS cell
    FROM lineitem""")
def numeric_normalize(spark, sf_dir):
    price = F.format_number("l_extendedprice", 2)
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Rs.(10%) -"), price, F.lit(" only")).alias("a"), F.when(F.col("l_linenumber") % 2 == 0, price).otherwise("n/a").alias("b"), F.concat(F.lit("₹ "), F.col("l_quantity").cast("string")).alias("c"))
    return rows.select("l_orderkey", "l_linenumber", T.parse_numeric(F.col("a")).alias("parsed"), T.plain_number(F.col("b")).alias("plain"), T.cell_number(F.col("c")).alias("cell"))


_SHAPES = ("dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy-MM-dd", "MM!yyyy")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'warning' WHEN year(o_orderdate) NOT BETWEEN 2000 AND 2035 THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN o_orderkey % 5 <> 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed,
    CASE WHEN o_orderkey % 5 = 4 THEN 'Date ''' || strftime(o_orderdate, '%m!%Y') || ''' format unrecognized or unparseable.'
         WHEN year(o_orderdate) NOT BETWEEN 2000 AND 2035 THEN 'Date year ' || year(o_orderdate) || ' outside plausible range [2000, 2035].' END AS message FROM orders""")
def date_rule(spark, sf_dir):
    shown = F.coalesce(*[F.when(F.col("o_orderkey") % 5 == k, F.date_format("o_orderdate", f)) for k, f in enumerate(_SHAPES)])
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", T.valid_date(shown).alias("v"))
    return rows.select("o_orderkey", "v.status", F.col("v.date").cast("string").alias("parsed"), "v.message")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '+91 ' ELSE '' END || CAST(6000000000 + c_custkey * 1777777 % 4999999999 AS VARCHAR) AS phone,
    6000000000 + c_custkey * 1777777 % 4999999999 < 10000000000 AS valid FROM customer""")
def phone_rule(spark, sf_dir):
    number = (F.lit(6000000000) + F.col("c_custkey") * 1777777 % 4999999999).cast("string")
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, "+91 ").otherwise(""), number).alias("phone"))
    return rows.withColumn("valid", T.valid_mobile(F.col("phone")))


@query(f"""WITH {_LINES}, m AS (SELECT doc_id, line_idx, regexp_extract(text, '([6-9][0-9]{{9}})', 1) AS value FROM lines WHERE regexp_matches(text, '[6-9][0-9]{{9}}'))
    SELECT doc_id, 'phone' AS field_name, arg_min(value, line_idx) AS value, min(line_idx) AS line_idx, 0.9 AS confidence, 'regex_phone' AS method FROM m GROUP BY doc_id""")
def phone_regex_first(spark, sf_dir):
    return baseline.first_matches(_lines(spark, sf_dir), {"phone": (r"([6-9]\d{9})",)})


@query(f"""WITH {_LINES}, m AS (SELECT doc_id, line_idx, regexp_extract(text, '([0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{2,4}})', 1) AS value FROM lines)
    SELECT doc_id, 'date' AS field_name, arg_min(value, line_idx) AS value, min(line_idx) AS line_idx, 0.9 AS confidence, 'regex_date' AS method FROM m WHERE value <> '' GROUP BY doc_id""")
def date_regex_first(spark, sf_dir):
    return baseline.first_matches(_lines(spark, sf_dir), {"date": (r"(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4})",)})


@query("""SELECT p_partkey, CASE WHEN p_size >= 5 THEN CAST(p_size AS DOUBLE) END AS horse_power, CASE WHEN p_retailprice >= 1000 THEN round(p_retailprice, 2) END AS asset_cost FROM part""")
def horse_power_and_cost(spark, sf_dir):
    rows = _t(spark, sf_dir, "part")
    hp = F.concat("p_name", F.lit(" Horse Power : "), F.col("p_size").cast("string"), F.lit(" HP"))
    cost = F.concat(F.lit("Grand Total: Rs. "), F.format_number("p_retailprice", 2), F.lit("/-"))
    return rows.select("p_partkey", baseline.horse_power(hp).alias("horse_power"), baseline.asset_cost(cost).alias("asset_cost"))


@query("""SELECT o_orderkey, 'INV/' || o_orderkey AS invoice_number, strftime(o_orderdate, '%d/%m/%Y') AS invoice_date, CAST(5 + o_orderkey % 200 AS DOUBLE) AS horse_power FROM orders""")
def baseline_fields(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    lines = rows.select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.array(F.concat(F.lit("Invoice No: INV/"), key), F.concat(F.lit("Dated "), F.date_format("o_orderdate", "dd/MM/yyyy")), F.concat(F.lit("Engine Power: "), (F.col("o_orderkey") % 200 + 5).cast("string"), F.lit(" HP")))).alias("line_idx", "text"), G.box(0, 0, 0, 0).alias("bbox"))
    found = baseline.baseline_fields(lines).groupBy("doc_id").pivot("field_name", ["invoice_number", "invoice_date", "horse_power"]).agg(F.first("value"))
    return found.select(F.col("doc_id").alias("o_orderkey"), "invoice_number", "invoice_date", F.col("horse_power").cast("double").alias("horse_power"))


def _score_sql(schema) -> str:
    q = lambda w: w.lower().replace("'", "''")
    import re

    title = " + ".join(f"CASE WHEN contains(h, '{q(w)}') THEN 1.0 WHEN contains(t, '{q(w)}') THEN 0.5 ELSE 0.0 END" for w in schema.title_keywords)
    words = " + ".join(f"CAST(regexp_matches(t, '\\b{re.escape(q(w))}\\b') AS DOUBLE)" for w in schema.keywords)
    held = lambda ws: " + ".join(f"CAST(contains(t, '{q(w)}') AS DOUBLE)" for w in ws)
    return f"""round(least(0.35, ({title}) / {len(schema.title_keywords)} * 0.70) + least(1.0, ({words}) / {max(3, len(schema.keywords) * 0.4)}) * 0.35
        + ({held(schema.anchors)}) / {len(schema.anchors)} * 0.20 + least(1.0, ({held(schema.table_indicators)}) / {len(schema.table_indicators)}) * 0.10, 4)"""


_TRACTOR = Registry.shared().get("tractor_invoice")


@query(f"""WITH {_LINES}, d AS (SELECT doc_id, lower(string_agg(text, chr(10) ORDER BY line_idx)) AS t, string_agg(lower(text), ' ' ORDER BY line_idx) FILTER (line_idx < 6) AS h FROM lines GROUP BY doc_id)
    SELECT doc_id, CAST({_score_sql(_TRACTOR)} AS DOUBLE) AS score FROM d""")
def keyword_score(spark, sf_dir):
    from ..operators.documents import full_text, gather, header_text

    docs = gather(_lines(spark, sf_dir))
    return docs.select("doc_id", schema_score(_TRACTOR, F.lower(full_text(F.col("lines"))), header_text(F.col("lines"))).alias("score"))


#: All rows: lines numbered anew, as line numbers repeat within an order.
_BOX_SQL = """rows AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS line FROM lineitem),
    boxes AS (SELECT l_orderkey AS doc_id, line AS line_idx, CAST(l_partkey % 400 AS DOUBLE) AS x0, CAST(l_suppkey % 90 * 7 AS DOUBLE) AS y0,
    CAST(l_partkey % 400 + 20 + l_quantity AS DOUBLE) AS x1, CAST(l_suppkey % 90 * 7 + 12 + l_linenumber AS DOUBLE) AS y1 FROM rows)"""


def _boxes(spark, sf_dir) -> DataFrame:
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    x, y = F.col("l_partkey") % 400, F.col("l_suppkey") % 90 * 7
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), line.alias("line_idx"), G.box(x, y, x + 20 + F.col("l_quantity"), y + 12 + F.col("l_linenumber")).alias("bbox"))


_NEAR = """SELECT doc_id, line_idx, {name}_idx, dist, greatest(0.5, 1 - dist / {most}) AS score FROM (
    SELECT a.doc_id, a.line_idx, b.line_idx AS {name}_idx, {dist} AS dist, row_number() OVER (PARTITION BY a.doc_id, a.line_idx ORDER BY {dist}, b.line_idx) AS r
    FROM b1 a JOIN b1 b ON a.doc_id = b.doc_id AND a.line_idx <> b.line_idx WHERE {where}) WHERE r = 1"""
_RIGHT = _NEAR.format(name="right", most=600.0, dist="sqrt(pow(greatest(0, b.x0 - a.x1), 2) + pow(abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2), 2))", where="""b.x0 - a.x1 BETWEEN -10 AND 600
    AND (greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0) >= 0.3
         OR abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) <= greatest(10, ((a.y1 - a.y0) + (b.y1 - b.y0)) / 2 * 0.6))""")
_BELOW = _NEAR.format(name="below", most=200.0, dist="sqrt(pow(abs(a.x0 - b.x0) * 0.5, 2) + pow(greatest(0, b.y0 - a.y1), 2))", where="""b.y0 - a.y1 BETWEEN -5 AND 200
    AND (greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0) >= 0.2 OR abs(a.x0 - b.x0) <= 100)""")


def _near_query(name, find):
    @query(f"WITH {_BOX_SQL}, b1 AS (SELECT * FROM boxes), r AS ({_RIGHT if name == 'right' else _BELOW}) SELECT doc_id, line_idx, {name}_idx, round(dist, 6) AS dist, round(score, 6) AS score FROM r")
    def run(spark, sf_dir):
        return find(_boxes(spark, sf_dir)).withColumns({"dist": F.round("dist", 6), "score": F.round("score", 6)})

    QUERIES[f"spatial_{name}_neighbor"], ORACLES[f"spatial_{name}_neighbor"] = QUERIES.pop("run"), ORACLES.pop("run")


_near_query("right", spatial.right_neighbors)
_near_query("below", spatial.below_neighbors)


@query(f"""WITH {_BOX_SQL}, p AS (SELECT a.doc_id, a.line_idx, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0, b.y0, b.x1, b.y1,
        greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS w, greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS h
    FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND b.line_idx = a.line_idx + 1)
    SELECT doc_id, line_idx, round(w * h / ((ax1 - ax0) * (ay1 - ay0) + (x1 - x0) * (y1 - y0) - w * h), 6) AS iou, round(h / least(ay1 - ay0, y1 - y0), 6) AS v_overlap,
        round(w / least(ax1 - ax0, x1 - x0), 6) AS h_overlap FROM p""")
def box_iou_overlap(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    pairs = b.join(b.select("doc_id", (F.col("line_idx") - 1).alias("line_idx"), F.col("bbox").alias("o")), ["doc_id", "line_idx"])
    x, o = F.col("bbox"), F.col("o")
    return pairs.select("doc_id", "line_idx", F.round(G.iou(x, o), 6).alias("iou"), F.round(G.vertical_overlap(x, o), 6).alias("v_overlap"), F.round(G.horizontal_overlap(x, o), 6).alias("h_overlap"))


@query("""WITH g AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem)
    SELECT doc_id, i AS item, row_number() OVER (PARTITION BY doc_id ORDER BY n % 3, -n, i) AS place FROM g""")
def reading_order(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem")
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    n = F.col("l_linenumber")
    items = rows.select(F.col("l_orderkey").alias("doc_id"), i.alias("item"), G.box(1000 - n * 50, n % 3 * 100, 1040 - n * 50, n % 3 * 100 + 20).alias("bbox"))
    docs = items.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("item", "bbox"))).alias("items"))
    return docs.select("doc_id", F.posexplode(G.reading_order(F.col("items"))).alias("k", "x")).select("doc_id", "x.item", (F.col("k") + 1).alias("place"))


@query("""WITH q AS (SELECT p_partkey, p_name, replace(p_name, 'a', 'o') AS typed, CAST(p_partkey % 8 AS INT) AS part FROM part),
    c AS (SELECT DISTINCT p_name AS entry FROM part),
    s AS (SELECT p_partkey, entry, levenshtein(typed, entry) / greatest(length(typed), length(entry)) AS nled FROM q CROSS JOIN c)
    SELECT p_partkey, entry, round(nled, 6) AS nled FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY nled, entry) AS r FROM s) WHERE r = 1""")
def entity_match_levenshtein(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    typed = part.select("p_partkey", F.replace("p_name", F.lit("a"), F.lit("o")).alias("text"))
    best = match.nearest_entries(typed, part.select(F.col("p_name").alias("entry")))
    return typed.join(best, "text", "left").select("p_partkey", "entry", F.round("nled", 6).alias("nled"))


@query("SELECT s_suppkey, 100.0 AS sorted_score, 100.0 AS set_score, 100.0 AS part_score, 100.0 AS composite_score FROM supplier")
def similarity_identities(spark, sf_dir):
    a, b = F.col("s_name"), F.concat(F.lit("  "), F.upper("s_name"), F.lit(" "))
    return _t(spark, sf_dir, "supplier").select("s_suppkey", token_sort(a, b).alias("sorted_score"), token_set(a, F.concat(b, F.lit(" ltd"))).alias("set_score"), partial(a, F.concat(F.lit("m/s "), b)).alias("part_score"), composite(a, b).alias("composite_score"))


def _dealers_sql() -> str:
    return "['" + "', '".join(c.replace("'", "''") for c in Registry.shared().get("tractor_invoice").fields[0].catalog) + "']"


@query(f"""WITH c AS (SELECT unnest({_dealers_sql()}) AS entry, generate_subscripts({_dealers_sql()}, 1) AS i), n AS (SELECT count(*) AS n FROM c),
    l AS (SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, 'M/s ' || entry || ' Dealer' AS text FROM supplier, n, c WHERE i = s_suppkey % n + 1)
    SELECT doc_id, 0 AS line_idx, text, first(entry ORDER BY i) AS name, 100.0 AS score, 0.9 AS confidence, 'fuzzy_ocr_scan' AS method
    FROM l JOIN c ON list_has_all(string_split(text, ' '), string_split(entry, ' ')) GROUP BY doc_id, text""")
def entity_match_token_sort(spark, sf_dir):
    catalog = list(Registry.shared().get("tractor_invoice").fields[0].catalog)
    lines = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), F.lit(0).alias("line_idx"), F.concat(F.lit("M/s "), F.element_at(F.array(*[F.lit(c) for c in catalog]), (F.col("s_suppkey") % len(catalog) + 1).cast("int")), F.lit(" Dealer")).alias("text"), F.lit(0.9).alias("confidence"))
    return match.scan_lines(lines, catalog, "dealer")


@query()
def model_candidates(spark, sf_dir):
    catalog = list(Registry.shared().get("tractor_invoice").fields[1].catalog)
    asked = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Tractor "), F.element_at(F.array(*[F.lit(c) for c in catalog]), (F.col("p_partkey") % len(catalog) + 1).cast("int"))).alias("q"))
    found = spread(asked).withColumn("c", match.model_candidates(F.col("q"), catalog))
    return found.select("p_partkey", F.get("c", F.lit(0))["name"].alias("best"), F.size(match.alternatives(F.col("c"))).alias("others"), match.model_by_substring(F.col("q"), catalog).alias("by_substring"))


_TRUTH = """t AS (SELECT o_orderkey AS doc_id, 'status' AS field_name, CAST(o_orderstatus AS VARCHAR) AS expected, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN 'zz' ELSE lower(o_orderstatus) END AS actual FROM orders
    UNION ALL SELECT o_orderkey, 'total', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), CASE WHEN o_orderkey % 17 = 0 THEN CAST(CAST(o_totalprice + 1 AS DECIMAL(18,2)) AS VARCHAR) ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END FROM orders),
    c AS (SELECT doc_id, field_name, lower(expected) AS e, actual AS a, actual <> '' AND (CASE WHEN try_cast(expected AS DOUBLE) IS NOT NULL AND try_cast(actual AS DOUBLE) IS NOT NULL THEN abs(try_cast(expected AS DOUBLE) - try_cast(actual AS DOUBLE)) < 0.01
        ELSE lower(expected) = actual OR contains(lower(expected), actual) OR contains(actual, lower(expected)) END) AS match FROM t),
    o AS (SELECT *, CASE WHEN match THEN 'tp' WHEN a <> '' THEN 'fp' WHEN e <> '' THEN 'fn' ELSE 'none' END AS outcome, CASE WHEN match THEN 0.0 ELSE levenshtein(e, a) / greatest(length(e), length(a)) END AS distance FROM c)"""


def _compared(spark, sf_dir) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    money = lambda c: c.cast("decimal(18,2)").cast("string")
    key = F.col("o_orderkey")
    status = F.when(key % 11 == 0, "").when(key % 13 == 0, "zz").otherwise(F.lower("o_orderstatus"))
    total = F.when(key % 17 == 0, money(F.col("o_totalprice") + 1)).otherwise(money(F.col("o_totalprice")))
    rows = o.select(key.alias("doc_id"), F.explode(F.array(F.struct(F.lit("status").alias("field_name"), T.eval_text(F.col("o_orderstatus").cast("string"), F.lit(None).cast("double")).alias("expected"), status.alias("actual")), F.struct(F.lit("total").alias("field_name"), money(F.col("o_totalprice")).alias("expected"), total.alias("actual")))).alias("x")).select("doc_id", "x.*")
    return evaluate.compare(rows.drop("actual"), rows.drop("expected"))


@query(f"""WITH {_TRUTH}, m AS (SELECT field_name, avg(CASE WHEN outcome IN ('tp', 'none') THEN 1.0 ELSE 0.0 END) AS em, avg(distance) AS nled, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp,
        count(*) FILTER (outcome = 'fn') AS fn, count(*) AS support FROM o GROUP BY field_name),
    p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS re FROM m)
    SELECT field_name, round(em, 4) AS em, round(nled, 4) AS nled, round(pr, 4) AS precision, round(re, 4) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 4) AS f1, support FROM p""")
def eval_field_metrics(spark, sf_dir):
    return evaluate.field_metrics(_compared(spark, sf_dir))


@query(f"WITH {_TRUTH}, d AS (SELECT doc_id, bool_and(outcome NOT IN ('fp', 'fn')) AS ok FROM o GROUP BY doc_id) SELECT round(avg(CAST(ok AS DOUBLE)), 4) AS document_accuracy FROM d")
def eval_document_accuracy(spark, sf_dir):
    return evaluate.document_accuracy(_compared(spark, sf_dir))


@query(f"WITH {_TRUTH} SELECT DISTINCT field_name FROM o ORDER BY field_name")
def eval_truth_keys(spark, sf_dir):
    return evaluate.truth_keys(_compared(spark, sf_dir))


@query("SELECT avg(value) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events")
def latency_percentiles(spark, sf_dir):
    return evaluate.latency(_t(spark, sf_dir, "events"), "value")


_SCORED = "s AS (SELECT quality AS y, (doc_id % 100) / 100.0 AS p FROM labels)"


def _scored(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "labels").select(F.col("quality").alias("y"), (F.col("doc_id") % 100 / 100.0).alias("p"))


@query(f"""WITH {_SCORED}, b AS (SELECT CASE WHEN p < 0.2 THEN 0 WHEN p < 0.4 THEN 1 WHEN p < 0.6 THEN 2 WHEN p < 0.8 THEN 3 ELSE 4 END AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM s GROUP BY 1)
    SELECT round(sum(n * abs(p - y)) / sum(n), 4) AS ece, (SELECT round(avg(pow(p - y, 2)), 4) FROM s) AS brier FROM b""")
def ece_brier(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return confidence.ece(s, 5).crossJoin(F.broadcast(confidence.brier(s)))


@query(f"""WITH RECURSIVE {_SCORED}, b AS (SELECT p, count(*) AS n, sum(y) AS y FROM s GROUP BY p),
    fit(i, w, c) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL
        SELECT i + 1, w - (gw * hcc - gc * hwc) / (hww * hcc - hwc * hwc), c - (hww * gc - hwc * gw) / (hww * hcc - hwc * hwc) FROM (
            SELECT i, w, c, sum((n * m - y) * p) + w AS gw, sum(n * m - y) AS gc, sum(n * m * (1 - m) * p * p) + 1 AS hww, sum(n * m * (1 - m) * p) AS hwc, sum(n * m * (1 - m)) AS hcc
            FROM (SELECT i, w, c, p, n, y, 1 / (1 + exp(-(w * p + c))) AS m FROM fit, b WHERE i < 30) GROUP BY i, w, c))
    SELECT b.p, round(1 / (1 + exp(-(w * b.p + c))), 3) AS calibrated FROM b, fit WHERE i = 30""")
def platt_calibration(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return confidence.Calibrator().fit(s).calibrate(s.select("p").distinct()).select("p", F.round("calibrated", 3).alias("calibrated"))


@query(f"""WITH {_SCORED}, b AS (SELECT p, count(*) AS n, sum(y) AS y FROM s GROUP BY p), c AS (SELECT p, sum(n) OVER (ORDER BY p) AS n, sum(y) OVER (ORDER BY p) AS y FROM b),
    i AS (SELECT lo.p AS lo, hi.p AS hi, (hi.y - (lo.y - b.y)) / (hi.n - (lo.n - b.n)) AS mean FROM c lo JOIN b ON lo.p = b.p JOIN c hi ON hi.p >= lo.p),
    m AS (SELECT b.p, i.lo, min(i.mean) AS least FROM b JOIN i ON i.lo <= b.p AND i.hi >= b.p GROUP BY b.p, i.lo)
    SELECT p, round(max(least), 4) AS calibrated FROM m GROUP BY p""")
def isotonic_calibration(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return confidence.Calibrator("isotonic").fit(s).calibrate(s.select("p").distinct()).select("p", F.round("calibrated", 4).alias("calibrated"))


@query("""SELECT event_id, event_type, round(least(1.0, greatest(0.0, round((abs(value) % 1 * 0.7 + CASE event_type WHEN 'layout_kv_right' THEN 0.96 ELSE 0.85 END * 0.3)
    * CASE event_id % 3 WHEN 0 THEN 0.4 WHEN 1 THEN 0.8 ELSE 1.0 END, 4))), 4) AS confidence FROM events""")
def field_confidence(spark, sf_dir):
    status = F.when(F.col("event_id") % 3 == 0, "invalid").when(F.col("event_id") % 3 == 1, "warning").otherwise("valid")
    return _t(spark, sf_dir, "events").select("event_id", "event_type", confidence.field_confidence(F.abs("value") % 1, F.col("event_type"), status, F.lit(True)).alias("confidence"))


_WEIGHTS = [("a", 1.0), ("b", 0.8), ("c", 0.5)]


@query("""WITH f AS (SELECT user_id, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 'a' ELSE 'b' END AS n, max(abs(value) % 1) AS c FROM events GROUP BY ALL)
    SELECT user_id, round(coalesce(sum(c * CASE n WHEN 'a' THEN 1.0 ELSE 0.8 END), 0) / 2.3, 4) AS weighted, round(avg(c), 4) AS plain FROM f GROUP BY user_id""")
def weighted_confidence(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    first = F.broadcast(e.agg(F.min("event_type").alias("first")))
    f = e.crossJoin(first).groupBy(F.col("user_id").alias("doc_id"), F.when(F.col("event_type") == F.col("first"), "a").otherwise("b").alias("field_name")).agg(F.max(F.abs("value") % 1).alias("confidence"))
    weighted = confidence.weighted_confidence(f, spark.createDataFrame(_WEIGHTS, "field_name string, weight double")).withColumnRenamed("confidence", "weighted")
    return weighted.join(confidence.mean_confidence(f).withColumnRenamed("confidence", "plain"), "doc_id").withColumnRenamed("doc_id", "user_id")


@query("""SELECT event_id, CASE WHEN c >= 0.88 AND event_id % 4 <> 0 THEN 'AUTO_APPROVE' WHEN c >= 0.70 THEN 'REVIEW' ELSE 'MANUAL_REVIEW' END AS decision,
    CAST(event_id % 4 = 0 AS INT) + CAST(c < 0.88 AS INT) + CAST(c < 0.65 AS INT) AS n_reasons FROM (SELECT event_id, round(abs(value) % 1, 4) AS c FROM events)""")
def standalone_decision(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", F.round(F.abs("value") % 1, 4).alias("c"))
    reasons = F.when(F.col("event_id") % 4 == 0, F.array(F.lit("given"))).otherwise(F.array().cast("array<string>"))
    d = confidence.decision(F.col("c"), reasons, F.array(F.struct(F.lit("value").alias("field"), F.col("c").alias("confidence"))))
    return rows.select("event_id", d["decision"].alias("decision"), F.size(d["reasons"]).alias("n_reasons"))


@query("""WITH m AS (SELECT event_type AS condition, round(avg(CAST(value > 50 AS DOUBLE)), 4) AS accuracy FROM events GROUP BY 1)
    SELECT condition, accuracy, round(greatest(0, (SELECT accuracy FROM m ORDER BY condition LIMIT 1) - accuracy), 4) AS drop FROM m""")
def accuracy_drop(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    m = e.groupBy(F.col("event_type").alias("condition")).agg(F.round(F.avg((F.col("value") > 50).cast("double")), 4).alias("accuracy"))
    return evaluate.accuracy_drop(m, e.agg(F.min("event_type")).first()[0] or "clean")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'required field is missing' WHEN o_totalprice NOT BETWEEN 1000 AND 200000 THEN 'value ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' is outside [1000.0, 200000.0]' END AS message
    FROM orders WHERE o_orderkey % 9 = 0 OR o_totalprice NOT BETWEEN 1000 AND 200000""")
def required_range_validation(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    fields = o.select(F.col("o_orderkey").alias("doc_id"), F.lit("total").alias("field_name"), value.alias("value_str"), F.lit(None).cast("double").alias("value_num"))
    engine = rules.RuleEngine([rules.required_fields(("total",)), rules.numeric_range("total", 1000.0, 200000.0)])
    return engine.messages(fields).select(F.col("doc_id").alias("o_orderkey"), "message")


@query("""WITH s AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS subtotal FROM lineitem GROUP BY 1)
    SELECT o_orderkey, abs(CAST(subtotal AS DOUBLE) - o_totalprice) <= 1.0 OR subtotal > o_totalprice AS balanced FROM orders JOIN s ON l_orderkey = o_orderkey""")
def totals_balance(spark, sf_dir):
    sums = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("subtotal"))
    rows = _t(spark, sf_dir, "orders").join(sums, F.col("l_orderkey") == F.col("o_orderkey")).withColumnRenamed("o_totalprice", "total")
    return rows.select("o_orderkey", to_column("abs(subtotal - total) <= 1.0 or subtotal > total", F.col).alias("balanced"))


@query("""SELECT event_id, 0 AS line_idx, event_type AS text, CAST(user_id AS DOUBLE) AS x0, CAST(user_id + 40 AS DOUBLE) AS x1, CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 1.0 END AS confidence FROM events""")
def recognised_json(spark, sf_dir):
    u = F.col("user_id").cast("string")
    far = (F.col("user_id") + 40).cast("string")
    boxed = F.concat(F.lit('{"rec_texts":["'), "event_type", F.lit('"," "],"rec_scores":[0.5],"rec_boxes":[['), u, F.lit(",1,"), far, F.lit(",9],[0,0,0,0]]}"))
    shaped = F.concat(F.lit('{"texts":["'), "event_type", F.lit('"],"dt_polys":[[['), u, F.lit(",1],["), far, F.lit(",1],["), far, F.lit(",9],["), u, F.lit(",9]]]}"))
    pages = _t(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.when(F.col("event_id") % 2 == 0, boxed).otherwise(shaped).alias("ocr"))
    found = recognised_lines(pages)
    return found.select(F.col("doc_id").cast("long").alias("event_id"), "line_idx", "text", "bbox.x0", "bbox.x1", "confidence")
