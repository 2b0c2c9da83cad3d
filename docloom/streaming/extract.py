"""Extraction of documents as they arrive: every step is per document, so the stream needs no state.

A text file is a document. Lines of one document in several files are not joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.records import extract
from ..sources.lines import line_arrays
from ..sources.schemas import Registry


def extract_texts(texts: DataFrame, registry: Registry | None = None, *, text_col: str = "text", id_col: str = "doc_id", document_type: str | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Extracted documents from a table or stream of whole texts; no shuffle at all."""
    docs = texts.select(F.col(id_col).cast("string").alias("doc_id"), line_arrays(F.coalesce(F.col(text_col), F.lit(""))).alias("lines"))
    return extract(docs, registry or Registry.shared(), forced=document_type, columns=columns)


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of (doc_id, text): new text files of a folder, whole."""
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return rows.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def write_stream(docs: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append extracted documents to Parquet, each file once."""
    return docs.writeStream.format("parquet").option("compression", "zstd").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
