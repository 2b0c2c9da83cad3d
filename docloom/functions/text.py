"""Column functions on text: cleaning, numbers, dates, phones, comparison of values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What must equal the established results.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
DATE = r"(?U)\b(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4})\b"
TIME = r"(?U)\b(\d{1,2}:\d{2}(?:\s*[apAP][mM])?)\b"
PERCENT = r"\(\s*[-+]?\d+(?:\.\d+)?\s*%\s*\)"
NUMBER = r"[-+]?\d+(?:\.\d+)?"
MOBILE = r"^(91)?[6-9]\d{9}$"
DATE_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d", "d/M/yy", "d-M-yy", "d MMM yyyy", "d MMMM yyyy")
YEARS = (2000, 2035)
BLANK = r"(?U)\s+"
#: All characters of ``(?U)\s``.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Letters that case folding takes for ASCII ones, and those.
FOLDED = ("\u017f\u0131\u0130\u212a", "siik")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def folded(c: Column) -> Column:
    """Lower case; an ASCII text that a pattern with ``(?iu)`` finds, this holds lowered."""
    return F.lower(F.translate(c, *FOLDED))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where there is none."""
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


def split_lines(text: Column) -> Column:
    """Array of (line_idx, text): physical lines with anything in them, numbered from 0 without the blank ones."""
    solid = F.filter(F.split(text, LINE_BREAK, -1), lambda t: strip(t) != "")
    return F.transform(solid, lambda t, i: F.struct(i.alias("line_idx"), t.alias("text")))


def normalize_text(c: Column) -> Column:
    """Lower case, ends stripped, runs of white space as one blank."""
    return F.regexp_replace(strip(F.lower(c)), BLANK, " ")


def clean_value(c: Column) -> Column:
    """Without colons, hyphens, bars and white space at both ends."""
    return F.btrim(c, F.lit(BLANKS + ":-|"))


def key_slug(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def title_label(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def split_label(c: Column) -> Column:
    """(label, value) around the first colon, both cleaned; null without a colon."""
    at = F.instr(c, ":")
    return F.when(at > 0, F.struct(strip(F.substring_index(c, ":", 1)).alias("label"), clean_value(F.substring(c, at + 1, F.length(c))).alias("value")))


def column_tokens(c: Column) -> Column:
    """Cells of a line: parts between two or more blanks, tabs or bars."""
    return F.split(c, r"\s{2,}|\t|\|", -1)


def header_tokens(c: Column) -> Column:
    """Cells of a header line: as ``column_tokens``, or its words where that gives one cell only."""
    wide = F.filter(F.transform(column_tokens(c), strip), lambda t: t != "")
    return let(wide, lambda w: F.when(F.size(w) > 1, w).otherwise(F.filter(F.split(c, r"\s+"), lambda t: t != "")))


def contains_ci(c: Column, needle: str | Column) -> Column:
    return F.contains(F.lower(c), F.lower(needle if isinstance(needle, Column) else F.lit(needle)))


def without_marks(c: Column, marks: tuple[str, ...]) -> Column:
    for m in marks:
        c = F.replace(c, F.lit(m), F.lit(""))
    return c


def parse_numeric(c: Column) -> Column:
    """The first number's absolute value, past thousands marks, currency and percentages in brackets."""
    bare = strip(without_marks(c, (",", "₹", "Rs.", "INR")))
    bare = strip(F.regexp_replace(bare, PERCENT, ""))
    return F.abs(first_group(bare, f"({NUMBER})").try_cast("double"))


def plain_number(c: Column) -> Column:
    """The value without thousands marks as a number, or null."""
    return strip(F.replace(c, F.lit(","), F.lit(""))).try_cast("double")


def cell_number(c: Column) -> Column:
    """A table cell's number, or null where it is text."""
    return strip(without_marks(c, (",", "₹", "Rs."))).try_cast("double")


def is_integral(c: Column) -> Column:
    return c % 1 == 0


def normalize_type(value: Column, kind: str) -> Column:
    """(value_str, value_num, ok) for a declared type."""
    return let(strip(value), lambda text: _typed(text, kind))


def _typed(text: Column, kind: str) -> Column:
    there = text != ""
    none, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    if kind in ("currency", "number"):
        def numbered(n: Column) -> Column:
            shown = F.when(n.isNotNull(), number_text(n, kind)).otherwise(text)
            return F.struct(F.when(there, shown).otherwise(none).alias("value_str"), n.alias("value_num"), F.coalesce(there & n.isNotNull(), F.lit(False)).alias("ok"))

        return let(F.round(parse_numeric(text), 2), numbered)
    if kind == "phone":
        ok = F.length(F.regexp_replace(text, r"[^\d\+]", "")) >= 8
    else:
        ok = F.lit(True)
    if kind == "date":
        text = F.coalesce(first_group(text, DATE), text)
    if kind == "time":
        text = F.coalesce(first_group(text, TIME), text)
    return F.struct(F.when(there, text).otherwise(none).alias("value_str"), no_number.alias("value_num"), F.coalesce(there & ok, F.lit(False)).alias("ok"))


def number_text(n: Column, kind: str = "number") -> Column:
    """A number as shown: whole ones of type number without a fraction."""
    whole = n.cast("decimal(38,0)").cast("string")
    full = F.regexp_replace(n.cast("decimal(38,2)").cast("string"), r"(\.\d)0$", "$1")
    return F.when(is_integral(n), whole).otherwise(full) if kind == "number" else full


def valid_date(c: Column) -> Column:
    """(status, message, date): of eight formats the first that fits; the year must be plausible."""
    text = strip(c)
    date = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS])
    year = F.year(date)
    unknown = F.concat(F.lit("Date '"), text, F.lit("' format unrecognized or unparseable."))
    outside = F.concat(F.lit("Date year "), year.cast("string"), F.lit(f" outside plausible range [{YEARS[0]}, {YEARS[1]}]."))
    out = ~year.between(*YEARS)
    return F.struct(
        F.when(date.isNull(), "warning").when(out, "error").otherwise("ok").alias("status"),
        F.when(date.isNull(), unknown).when(out, outside).alias("message"), date.alias("date"),
    )


def valid_mobile(c: Column) -> Column:
    return F.regexp_like(F.regexp_replace(c, r"\D", ""), F.lit(MOBILE))


def eval_text(text: Column, number: Column) -> Column:
    """A value as the evaluator compares it: whole numbers plain, others with two places, text lowered."""
    shown = F.when(is_integral(number), number.cast("decimal(38,0)").cast("string")).otherwise(number.cast("decimal(38,2)").cast("string"))
    return F.when(number.isNotNull(), shown).otherwise(F.lower(strip(text)))


def values_match(expected: Column, actual: Column) -> Column:
    """Equal numbers (to a hundredth), or one text holds the other."""
    near = F.abs(expected.try_cast("double") - actual.try_cast("double")) < 0.01
    return F.coalesce(near, (expected == actual) | F.contains(expected, actual) | F.contains(actual, expected))


def edit_distance_share(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 0.0).otherwise(F.levenshtein(a, b) / longer)
