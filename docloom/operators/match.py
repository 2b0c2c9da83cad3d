"""Names of catalogs found in texts: dealers by a composite score, models by substring or score."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import composite_score, normalized, partial_ratio, token_set_ratio, token_sort_ratio
from ..functions.text import edit_distance_share, normalize_text, strip

# Least scores, line lengths and shares.
DEALER_LEAST, MODEL_LEAST, SCAN_LEAST = 65.0, 75.0, 80.0
DEALER_CHARS, MODEL_CHARS = 4, 3
EXACT_CONFIDENCE, DEALER_SHARE, MODEL_SHARE = 0.98, 1.0, 0.95

CANDIDATE = "array<struct<name:string,score:double,confidence:double,match_type:string,metrics:map<string,double>>>"


def _top(rows: list[tuple], k: int) -> list[tuple]:
    return sorted(rows, key=lambda r: -r[1])[:k]


def _each_text(queries: pd.Series, found: Callable[[str], list[tuple]], top_k: int) -> pd.Series:
    """The candidates of a batch; texts of equal form are compared once."""
    known: dict[str, list[dict]] = {}
    for own in {normalized(q) for q in queries}:
        known[own] = [dict(zip(("name", "score", "confidence", "match_type", "metrics"), r, strict=True)) for r in _top(found(own), top_k)]
    return pd.Series([known[normalized(q)] for q in queries])


def dealer_candidates(query: Column, catalog: list[str], top_k: int = 3) -> Column:
    """The best entries by composite score, of equals the first of the catalog; none for a blank query."""
    names = [(e, normalized(e)) for e in catalog]

    @F.pandas_udf(CANDIDATE)
    def run(queries: pd.Series) -> pd.Series:
        def found(own: str) -> list[tuple]:
            out = []
            for entry, name in names if own else []:
                score = composite_score(own, name)
                if score >= DEALER_LEAST:
                    metrics = {"token_sort": token_sort_ratio(own, name), "token_set": token_set_ratio(own, name), "partial": partial_ratio(own, name)}
                    out.append((entry, score, round(score / 100 * DEALER_SHARE, 4), "fuzzy", metrics))
            return out

        return _each_text(queries, found, top_k)

    return run(query)


def model_candidates(query: Column, catalog: list[str], top_k: int = 3) -> Column:
    """The best entries: one that the query holds scores 100, others by sorted words or best part."""
    names = [(e, normalized(e)) for e in catalog]

    @F.pandas_udf(CANDIDATE)
    def run(queries: pd.Series) -> pd.Series:
        def found(own: str) -> list[tuple]:
            out = []
            for entry, name in names if own else []:
                if name in own:
                    out.append((entry, 100.0, EXACT_CONFIDENCE, "exact", {}))
                    continue
                metrics = {"token_sort": token_sort_ratio(own, name), "partial": partial_ratio(own, name)}
                score = max(metrics.values())
                if score >= MODEL_LEAST:
                    out.append((entry, score, round(score / 100 * MODEL_SHARE, 4), "fuzzy", metrics))
            return out

        return _each_text(queries, found, top_k)

    return run(query)


def model_by_substring(query: Column, catalog: list[str]) -> Column:
    """The first entry that holds the query or is held by it."""
    own = normalize_text(query)
    hits = [F.when(F.contains(own, F.lit(normalized(e))) | F.contains(F.lit(normalized(e)), own), e) for e in catalog]
    return F.when(own != "", F.coalesce(*hits))


def scan_lines(lines: DataFrame, catalog: list[str], kind: str) -> DataFrame:
    """Per document the line with the best match (of equals the first), if it scores enough.

    ``kind``: dealer or model. (doc_id, line_idx, text, name, score, confidence, method)
    """
    dealer = kind == "dealer"
    long = lines.filter(F.length(strip(F.col("text"))) >= (DEALER_CHARS if dealer else MODEL_CHARS))
    best = F.get((dealer_candidates if dealer else model_candidates)(F.col("text"), catalog, 1), F.lit(0))
    rows = long.withColumn("m", best).filter(F.col("m.score") >= SCAN_LEAST)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("m.score"), "line_idx"))
    rows = rows.withColumn("r", first).filter("r = 1")
    method = F.lit("fuzzy_ocr_scan" if dealer else "model_ocr_scan")
    return rows.select("doc_id", "line_idx", "text", "m.name", "m.score", F.round(F.col("m.confidence") * F.col("confidence"), 4).alias("confidence"), method.alias("method"))


def alternatives(candidates: Column, k: int = 3) -> Column:
    """The candidates after the best."""
    return F.slice(candidates, 2, k - 1)


#: Shares of differing characters up to which segments find the candidates; what is left meets all lengths.
NEAREST_ROUNDS = (0.25, 0.5)


def _reach(n: int, share: float) -> range:
    """Lengths of texts that can lie within ``share`` of one of ``n`` characters."""
    return range(math.ceil(n * (1 - share) - 1e-9), math.floor(n / (1 - share) + 1e-9) + 1)


def _segments(n: int, parts: int) -> list[tuple[int, int]]:
    return [(i * n // parts, (i + 1) * n // parts) for i in range(parts)]


def _keys(share: float, entry: bool):
    """Keys of a text: within ``share``, of k + 1 segments of an entry k edits leave one whole, moved by k at most."""

    @F.udf("array<string>")
    def run(text: str) -> list[str]:
        n, out = len(text), set()
        for other in _reach(n, share):
            size = n if entry else other
            k = math.floor(share * max(n, other) + 1e-9)
            for i, (a, b) in enumerate(_segments(size, k + 1)):
                for at in (a,) if entry else range(max(0, a - k), min(n - (b - a), a + k) + 1):
                    out.add(f"{other if entry else n}/{size}/{i}/{text[at : at + b - a]}")
        return sorted(out)

    return run


def nearest_entries(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """(text, entry, nled): each distinct text's entry at the least edit distance over the longer length, of equals the first.

    ``texts``: (text); ``entries``: (entry); nulls have no match. Round by round the pairs that share a
    segment key are compared, which are all pairs within the round's share, so a match in reach is final. Texts
    without one meet every distinct entry.
    """
    left, entries = texts.select("text").dropna().distinct(), entries.select("entry").dropna().distinct()
    found = None
    nled = edit_distance_share(F.col("text"), F.col("entry"))
    for share in (*NEAREST_ROUNDS, None):
        if share is None:
            met = left.crossJoin(entries)
        else:
            mine = left.withColumn("key", F.explode(_keys(share, False)("text")))
            met = mine.join(entries.withColumn("key", F.explode(_keys(share, True)("entry"))), "key").select("text", "entry").distinct()
        met = met.withColumn("nled", nled)
        met = met if share is None else met.filter(F.col("nled") <= share)
        best = met.groupBy("text").agg(F.min(F.struct("nled", "entry")).alias("m")).select("text", "m.entry", "m.nled")
        found = best if found is None else found.unionByName(best)
        left = left.join(best.select("text"), "text", "left_anti")
    return found
