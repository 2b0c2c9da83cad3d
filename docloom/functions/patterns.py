"""Regular expressions of schemas, as Spark's engine understands them."""

from __future__ import annotations

import re
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_pattern(pattern: str) -> str | None:
    """A schema's pattern with its syntax translated; null if it is broken. Case does not count."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    translated = pattern.replace("(?P<", "(?<")
    return "(?iuU)" + re.sub(r"\[([^\]]*)\\b([^\]]*)\]", r"[\1\\x08\2]", translated)


def escaped(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text, flags=re.ASCII) if text.isascii() else "".join(c if c.isalnum() or c.isspace() or c == "_" or ord(c) > 127 else "\\" + c for c in text)


def alias_pattern(alias: str) -> str:
    """A label: at the start or after white space, then perhaps a colon or hyphen."""
    return r"(?iuU)(?:^|[\x08\s])" + escaped(alias.strip()) + r"\s*[:\-]?"


def word_pattern(word: str) -> str:
    return r"(?U)\b" + escaped(word.lower()) + r"\b"


def needed(pattern: str) -> list[str] | None:
    """Lowered ASCII texts of which every match holds one; null where none can be told."""
    try:
        found = _needed(_parser.parse(pattern, re.IGNORECASE))
    except re.error:
        return None
    return sorted(found) if found else None


def _needed(parts) -> set[str] | None:
    """Of the parts in a row, the choice whose shortest text is longest."""
    choices, run = [], ""
    for op, what in [*parts, (None, None)]:
        if op is _parser.LITERAL and what < 128:
            run += chr(what).lower()
            continue
        if run:
            choices.append({run})
        run = ""
        inner = None
        if op is _parser.SUBPATTERN and not what[1] and not what[2]:
            inner = _needed(what[3])
        elif op is _parser.BRANCH:
            each = [_needed(x) for x in what[1]]
            inner = set().union(*each) if all(each) else None
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and what[0] > 0:
            inner = _needed(what[2])
        if inner:
            choices.append(inner)
    return max(choices, key=lambda c: (min(map(len, c)), -len(c)), default=None)


def match_spans(text: Column, pattern: Column) -> Column:
    """Array of (start, end, label) of all matches, offsets from 0.

    Right where no earlier occurrence of a matched text could be skipped, as with ``alias_pattern``.
    """
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    state = F.struct(F.lit(1).alias("at"), none.alias("spans"))

    def step(s: Column, m: Column) -> Column:
        begin = F.call_function("locate", m, text, s["at"])
        return F.struct((begin + F.length(m)).alias("at"), F.concat(s["spans"], F.array(F.struct((begin - 1).alias("start"), (begin - 1 + F.length(m)).alias("end"), m.alias("label")))).alias("spans"))

    return F.aggregate(found, state, step, lambda s: s["spans"])
