"""Lines gathered to documents: one shuffle by document, all later operators are narrow.

A document row holds ``lines``, an array in line order of
struct<line_idx int, page int, text string, bbox, confidence double>.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import BOX
from ..functions.text import strip
from ..sources.schemas import Registry, Schema

LINE = f"struct<line_idx:int,page:int,text:string,bbox:{BOX},confidence:double>"


def gather(lines: DataFrame) -> DataFrame:
    """Documents (doc_id, lines) from a table of lines."""
    names = ["line_idx", "page", "text", "bbox", "confidence"]
    return lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*names))).cast(f"array<{LINE}>").alias("lines"))


def gather_texts(lines: DataFrame) -> DataFrame:
    """Documents (doc_id, text) from a table of lines, in the order of ``gather``: boxes do not travel."""
    ordered = F.sort_array(F.collect_list(F.struct("line_idx", "page", "text")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def spread(rows: DataFrame) -> DataFrame:
    """Small rows with dear work ahead, over four tasks a core at least."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def full_text(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["text"]), "\n")


def header_text(lines: Column, n: int = 6) -> Column:
    """The first lines, lowered, on one line."""
    return F.array_join(F.transform(F.slice(lines, 1, n), lambda x: F.lower(x["text"])), " ")


def page_lines(lines: Column, page: int) -> Column:
    return F.filter(lines, lambda x: x["page"] == page)


def longer_lines(lines: Column, least: int) -> Column:
    """Lines of at least so many characters, ends not counted."""
    return F.filter(lines, lambda x: F.length(strip(x["text"])) >= least)


def by_type(registry: Registry, document_type: Column, expression: Callable[[Schema], Column]) -> Column:
    """The expression of the document's schema; that of the generic one for any other type."""
    out = None
    for s in registry.typed:
        out = F.when(document_type == s.document_type, expression(s)) if out is None else out.when(document_type == s.document_type, expression(s))
    rest = expression(registry.get("generic") or Schema("generic"))
    return rest if out is None else out.otherwise(rest)


def kept(registry: Registry, name: str, make: Callable[[], Column]) -> Column:
    """An expression that depends on the registry only, built once: large ones take seconds to build."""
    if name not in registry.built:
        registry.built[name] = make()
    return registry.built[name]
