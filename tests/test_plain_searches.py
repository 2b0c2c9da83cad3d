"""Plain searches where they decide, and patterns only after them."""

import re

from pyspark.sql import functions as F

from docloom.functions.patterns import java_pattern, needed
from docloom.functions.text import BLANKS, clean_value, folded, strip
from docloom.sources.schemas import Registry


def test_ends_are_stripped_without_a_pattern(spark):
    assert "regexp" not in str(strip(F.col("t"))) and "regexp" not in str(clean_value(F.col("t")))
    texts = [a + " b - c " + z for a in (*BLANKS, "", "::- |", "​", "᠎", "⁠") for z in (*BLANKS, "", "|:\n", "\r\n", "é")] + ["", " \n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(old, r"(?U)^[:\-|\s]+", ""), r"(?U)[:\-|\s]+$", ""), r"(?U)^\s+", ""), r"(?U)\s+$", "")
    assert rows.filter(~strip(F.col("t")).eqNullSafe(old) | ~clean_value(F.col("t")).eqNullSafe(cut)).count() == 0
    every = spark.range(1, 0xD800).select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    assert every.filter((strip(F.col("c")) == "") != F.regexp_like("c", F.lit(r"(?U)^\s$"))).count() == 0


def test_letters_that_a_match_needs(spark):
    assert needed(r"(?:phone|tel)\s*[:\-]?(\d+)") == ["phone", "tel"] and needed(r"\d+|x") is None and needed(r"a?\d") is None and needed(r"(?:pay\s*mode)?ab") == ["ab"]
    for s in Registry.shared().typed:
        for f in s.fields:
            for p in f.patterns:
                assert needed(p), p
    # what a pattern finds regardless of case, the folded text holds
    rows = spark.createDataFrame([("PAYMENT ſTATUS",), ("Taxİnvoice ınvoice INVOICE",), ("Keep",)], "t string")
    for word in ("status", "invoice", "keep"):
        missed = F.regexp_like("t", F.lit(java_pattern(word))) & ~F.contains(folded(F.col("t")), F.lit(word))
        assert rows.filter(missed).count() == 0 and rows.filter(F.regexp_like("t", F.lit(java_pattern(word)))).count() > 0
    assert re.compile("status", re.IGNORECASE).search("ſtatus")
