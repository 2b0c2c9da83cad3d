"""Document type by keyword evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import word_pattern
from ..functions.text import strip
from ..sources.schemas import Registry, Schema
from .documents import full_text, header_text

# Shares of the score and the map to confidence.
TITLE, TITLE_SCALE, BODY, ANCHOR, TABLE = 0.35, 0.70, 0.35, 0.20, 0.10
LOW, HIGH, BASE, SPAN = 0.65, 0.98, 0.60, 0.38


def _sum(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def _word(text: Column, word: str) -> Column:
    """Whether a lowered text holds a word; the pattern, far dearer, meets only texts with its letters."""
    return F.contains(text, F.lit(word.lower())) & F.regexp_like(text, F.lit(word_pattern(word)))


def schema_score(schema: Schema, text: Column, header: Column) -> Column:
    """Score of one schema for lowered text and header."""
    held = lambda words, t: _sum([F.contains(t, F.lit(w.lower())).cast("double") for w in words])
    parts = []
    if schema.title_keywords:
        hits = _sum([F.when(F.contains(header, F.lit(w.lower())), 1.0).when(F.contains(text, F.lit(w.lower())), 0.5).otherwise(0.0) for w in schema.title_keywords])
        parts.append(F.least(F.lit(TITLE), hits / len(schema.title_keywords) * TITLE_SCALE))
    if schema.keywords:
        hits = _sum([_word(text, w).cast("double") for w in schema.keywords])
        parts.append(F.least(F.lit(1.0), hits / max(3, len(schema.keywords) * 0.40)) * BODY)
    if schema.anchors:
        parts.append(held(schema.anchors, text) / len(schema.anchors) * ANCHOR)
    if schema.table_indicators:
        parts.append(F.least(F.lit(1.0), held(schema.table_indicators, text) / len(schema.table_indicators)) * TABLE)
    return F.round(_sum(parts), 4)


def matched_keywords(schema: Schema, text: Column, header: Column) -> Column:
    """Array of the evidence: titles (in header or body), words, anchors, table words."""
    found = [F.when(F.contains(header, F.lit(w.lower())), f"title:{w}").when(F.contains(text, F.lit(w.lower())), f"body_title:{w}") for w in schema.title_keywords]
    found += [F.when(_word(text, w), w) for w in schema.keywords]
    found += [F.when(F.contains(text, F.lit(w.lower())), f"{kind}:{w}") for kind, words in (("anchor", schema.anchors), ("table", schema.table_indicators)) for w in words]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def classify(docs: DataFrame, registry: Registry, *, forced: str | None = None) -> DataFrame:
    """Add document_type, type_confidence, title, matched_keywords and scores.

    The best score wins, the first registered of equals. A forced type other than ``auto`` is taken as
    it is, with confidence 1; where it is unknown, the generic schema serves under its name.
    """
    if forced and forced != "auto":
        schema = registry.get(forced) or registry.get("generic")
        return docs.withColumns({
            "document_type": F.lit(forced), "type_confidence": F.lit(1.0), "title": F.lit(schema.title if schema else forced),
            "matched_keywords": F.array().cast("array<string>"), "scores": F.create_map(F.lit(forced), F.lit(1.0)),
        })
    typed = registry.typed
    rows = docs.withColumns({"_text": F.lower(full_text(F.col("lines"))), "_header": header_text(F.col("lines"))})
    text, header = F.col("_text"), F.col("_header")
    blank = strip(text) == ""
    if not typed:
        return rows.withColumns({
            "document_type": F.lit("generic"), "type_confidence": F.when(blank, 0.10).otherwise(0.30), "title": F.when(blank, "Unknown Document").otherwise("Generic Document"),
            "matched_keywords": F.array().cast("array<string>"), "scores": F.create_map(F.lit("generic"), F.when(blank, 0.10).otherwise(0.30)),
        }).drop("_text", "_header")
    rows = rows.withColumn("_scores", F.array(*[schema_score(s, text, header) for s in typed]))
    score = F.array_max("_scores")
    at = F.array_position(F.col("_scores"), score)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    clears = (score >= pick([float(s.min_score) for s in typed])) & ~blank
    words = None
    for k, s in enumerate(typed, 1):
        words = F.when(at == k, matched_keywords(s, text, header)) if words is None else words.when(at == k, matched_keywords(s, text, header))
    scores = F.create_map(*[x for k, s in enumerate(typed) for x in (F.lit(s.document_type), F.col("_scores")[k])])
    confidence = F.round(F.least(F.lit(HIGH), F.greatest(F.lit(LOW), BASE + score * SPAN)), 4)
    return rows.withColumns({
        "document_type": F.when(clears, pick([s.document_type for s in typed])).otherwise("generic"),
        "type_confidence": F.when(clears, confidence).when(blank, 0.10).otherwise(F.round(F.greatest(F.lit(0.20), score), 4)),
        "title": F.when(clears, pick([s.title for s in typed])).when(blank, "Unknown Document").otherwise("Generic / Unknown Document"),
        "matched_keywords": F.when(clears, words).otherwise(F.array().cast("array<string>")),
        "scores": F.when(blank, F.create_map(F.lit("generic"), F.lit(0.10))).otherwise(scores),
    }).drop("_text", "_header", "_scores")
