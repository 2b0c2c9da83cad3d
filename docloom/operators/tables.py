"""Tables in documents: header lines, extents, columns, rows, and the lines that they take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box, equal_columns
from ..functions.patterns import java_pattern
from ..functions.text import cell_number, column_tokens, header_tokens, is_integral, let, strip
from ..sources.schemas import Registry, Schema
from .documents import by_type, kept

# Words of a header without a schema's table, general ends of a table, the item line.
HEADER_WORDS = ("s.no", "sno", "sl no", "item", "item name", "description", "particulars", "qty", "quantity", "rate", "unit price", "price", "amount", "total", "hsn", "tax")
STOPS = (r"^thank\s*you\b", r"^authorized\s+signatory\b", r"^for\s+[A-Z]")
# The item line: number, item, quantity, price, amount. Groups go by number, as Java's names know no underscore.
ITEM = (
    r"(?iuU)^(?:(\d{1,4})\s+)?([A-Za-z0-9\s\.\&\-\(\)\/]+?)\s+(\d+(?:\.\d+)?)\s+"
    r"(?:(?:rs\.?|inr|₹)\s*)?([\d,]+(?:\.\d{1,2})?)\s+(?:(?:rs\.?|inr|₹)\s*)?([\d,]+(?:\.\d{1,2})?)$"
)
_MARK = "\x01"
NO_ROWS = 0.85

CELL = "struct<value_num:double,value_str:string,raw_text:string,confidence:double>"
ROW = f"struct<row_index:int,cells:map<string,{CELL}>,confidence:double>"


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + F.contains(text, F.lit(w.lower())).cast("int")
    return out


def header_table(schema: Schema, text: Column) -> Column:
    """Name of the table that a lowered line heads; null for other lines."""
    out = F.when(F.lit(False), "")
    for t in schema.tables:
        if len(t.header_keywords) > 1:
            out = out.when(_hits(text, t.header_keywords) >= 2, t.name)
    return out.when(_hits(text, HEADER_WORDS) >= 3, "generic_table")


def ends_table(schema: Schema, text: Column) -> Column:
    """Whether a lowered line ends a table."""
    out = F.lit(False)
    for w in schema.stop_keywords:
        out = out | F.contains(text, F.lit(w.lower()))
    for p in STOPS:
        out = out | F.regexp_like(text, F.lit(java_pattern(p)))
    return out


def _cell(number: Column, text: Column, raw: Column, confidence: Column) -> Column:
    return F.struct(number.cast("double").alias("value_num"), text.alias("value_str"), raw.alias("raw_text"), confidence.alias("confidence"))


def parse_row(line: Column, position: Column, names: Column) -> Column:
    """Cells of a body line: as an item line, else as three or more tokens under ``names``; null otherwise."""
    return let(strip(line["text"]), lambda text: _cells(text, line["confidence"], position, names))


def _cells(text: Column, confidence: Column, position: Column, names: Column) -> Column:
    # one pass of the pattern: its groups between marks that no text of an item line holds
    groups = F.split(F.regexp_replace(text, ITEM, F.lit(_MARK.join(f"${k}" for k in range(1, 6)))), _MARK, -1)

    def itemised(g: Column) -> Column:
        sno = F.coalesce(F.nullif(g[0], F.lit("")), position.cast("string"))
        none = F.lit(None).cast("string")
        number = lambda k: F.replace(g[k], F.lit(","), F.lit("")).try_cast("double")
        item = strip(g[1])
        cells = [
            (F.lit("sno"), _cell(sno.try_cast("double"), none, sno, confidence)), (F.lit("item"), _cell(F.lit(None), item, item, confidence)),
            (F.lit("qty"), _cell(number(2), none, g[2], confidence)), (F.lit("unit_price"), _cell(number(3), none, g[3], confidence)), (F.lit("amount"), _cell(number(4), none, g[4], confidence)),
        ]
        return F.create_map(*[x for pair in cells for x in pair]).cast(f"map<string,{CELL}>")

    loose = let(F.transform(column_tokens(text), strip), lambda tokens: _loose(tokens, confidence, names))
    matched = lambda g: (F.size(g) == 5) & ~F.contains(text, F.lit(_MARK))
    return let(groups, lambda g: F.when(matched(g), itemised(g)).otherwise(loose.cast(f"map<string,{CELL}>")))


def _loose(tokens: Column, confidence: Column, names: Column) -> Column:
    """Cells by position; a name met twice keeps its last token."""
    keys = F.transform(tokens, lambda t, i: F.coalesce(F.get(names, i), F.concat(F.lit("col_"), (i + 1).cast("string"))))

    def token_cell(t: Column) -> Column:
        n = cell_number(t)
        return _cell(n, F.when(n.isNull(), t), t, confidence)

    def cells(keys: Column) -> Column:
        pairs = F.transform(tokens, lambda t, i: F.struct(F.get(keys, i).alias("key"), token_cell(t).alias("value")))
        return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["key"])))

    return F.when(F.size(tokens) >= 3, let(keys, cells))


def detect_tables(docs: DataFrame, registry: Registry) -> DataFrame:
    """Add ``regions``: struct<name, header_idx, end_idx, header, body>, positions counting from 0 in ``lines``."""
    kind = F.col("document_type")
    lowered = F.transform("lines", lambda x: F.lower(strip(x["text"])))
    rows = docs.withColumn("_lowered", lowered)
    heads = kept(registry, "heads", lambda: by_type(registry, kind, lambda s: F.transform("_lowered", lambda t: header_table(s, t))))
    stops = kept(registry, "stops", lambda: by_type(registry, kind, lambda s: F.filter(F.transform("_lowered", lambda t, i: F.when(ends_table(s, t), i)), lambda i: i.isNotNull())))
    rows = rows.withColumns({"_heads": heads, "_stops": stops})
    n = F.size("lines")
    at = F.filter(F.transform("_heads", lambda name, i: F.struct(name.alias("name"), i.alias("header_idx"))), lambda h: h["name"].isNotNull())

    def region(h: Column) -> Column:
        i = h["header_idx"]
        end = F.coalesce(F.array_min(F.filter("_stops", lambda s: s > i)), n)
        return F.struct(h["name"].alias("name"), i.alias("header_idx"), end.alias("end_idx"), F.get("lines", i).alias("header"), F.slice("lines", i + 2, end - i - 1).alias("body"))

    return rows.withColumn("regions", F.transform(at, region)).drop("_lowered", "_heads", "_stops")


def exclude_tables(docs: DataFrame) -> DataFrame:
    """Add ``active``: the lines that are not in a region, nor equal one there in text and box."""
    key = lambda x: F.struct(x["text"].alias("text"), x["bbox"].alias("bbox"))
    taken = F.flatten(F.transform("regions", lambda r: F.transform(F.concat(F.array(r["header"]), r["body"]), key)))
    rows = docs.withColumn("_taken", F.array_distinct(taken))
    return rows.withColumn("active", F.filter("lines", lambda x: ~F.array_contains(F.col("_taken"), key(x)))).drop("_taken")


def extract_tables(docs: DataFrame, registry: Registry) -> DataFrame:
    """Add ``tables``: struct<name, header_idx, columns, rows, confidence, bbox> per region."""
    kind = F.col("document_type")
    names = by_type(registry, kind, lambda s: F.create_map(*[x for t in s.tables for x in (F.lit(t.name), F.array(*[F.lit(c) for c in t.columns]).cast("array<string>"))]) if s.tables else F.create_map().cast("map<string,array<string>>"))
    rows = docs.withColumn("_columns", names)

    def table(r: Column) -> Column:
        columns = F.coalesce(F.try_element_at("_columns", r["name"]), F.array().cast("array<string>"))
        found = F.transform(r["body"], lambda x, i: F.struct(parse_row(x, i + 1, columns).alias("cells"), x["confidence"].alias("confidence")))
        found = F.transform(F.filter(found, lambda x: x["cells"].isNotNull()), lambda x, i: F.struct((i + 1).alias("row_index"), x["cells"].alias("cells"), x["confidence"].alias("confidence")))
        h = r["header"]["bbox"]
        low = F.greatest(h["y1"], F.coalesce(F.array_max(F.transform(r["body"], lambda x: x["bbox"]["y1"])), h["y1"]))
        return F.struct(
            r["name"].alias("name"), r["header_idx"].alias("header_idx"), equal_columns(h, header_tokens(strip(r["header"]["text"]))).alias("columns"),
            found.alias("rows"), box(h["x0"], h["y0"], h["x1"], low).alias("bbox"),
        )

    def scored(t: Column) -> Column:
        total = F.aggregate(t["rows"], F.lit(0.0), lambda a, x: a + x["confidence"])
        mean = F.when(F.size(t["rows"]) > 0, total / F.size(t["rows"])).otherwise(F.lit(NO_ROWS))
        return F.struct(*[t[c].alias(c) for c in ("name", "header_idx", "columns", "rows", "bbox")], F.round(mean, 4).alias("confidence"))

    return rows.withColumn("tables", F.transform(F.transform("regions", table), scored)).drop("_columns")


def row_mismatches(table_rows: Column, formula: str | None, tolerance: float = 1.0) -> Column:
    """Rows whose cells are all there and whose left side misses the right by more than the tolerance."""
    from ..functions.expressions import parse_formula, to_column

    parsed = parse_formula(formula)
    if parsed is None:
        return F.lit(0)
    left, right = parsed
    cell = lambda x, name: F.try_element_at(x["cells"], F.lit(name))["value_num"]
    off = lambda x: F.abs(to_column(left, lambda name: cell(x, name)) - cell(x, right)) > tolerance
    return F.size(F.filter(table_rows, lambda x: F.coalesce(off(x), F.lit(False))))


def whole(x: Column) -> Column:
    """A number as a whole one where it is."""
    return F.when(is_integral(x), x.cast("long"))
