"""From documents to packed training sequences, in five stages.

Each stage takes the documents that the one before kept, written as Parquet and read again, and all
but the last return rows of the same columns. The last returns a row per piece of a document with
its place in a sequence of at most 2048 tokens.

The stages share executors, whose memory hardly shrinks by itself: what the buffers of one stage took,
the next finds taken. So each stage begins with a collection of garbage on the executors, and the pipeline's
batches, Arrow's and those of the Parquet reader, are smaller than those of a single operator.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import exact_dedup, jaccard_join, language_id, packing, suffix_dedup
from docloom.llm._common import bounded_batches, collect_garbage, cut, work_dir
from docloom.llm.queries import tokenizer_path

#: Bytes of an Arrow batch in any stage (a longer row is a batch of its own).
BATCH_BYTES = 2 << 20
#: Rows that the Parquet reader decodes at a time: whole texts, in one array that doubles as it grows.
READ_ROWS = 1024

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _frugal(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark, BATCH_BYTES)
        name = "spark.sql.parquet.columnarReaderBatchSize"
        spark.conf.set(name, str(min(READ_ROWS, int(spark.conf.get(name)))))
        collect_garbage(spark)
        return stage(spark, docs, sf_dir)

    return bounded


@_frugal
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in which no language has share enough, go."""
    return language_id.keep_identified(docs)


@_frugal
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_exact_copies(docs)


@_frugal
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join stays."""
    return jaccard_join.keep_one_each(docs)


@_frugal
def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that occur again are taken out of the texts, as whole characters; all rows stay."""
    return suffix_dedup.strip_repeats(docs)


@_frugal
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' tokens in sequences."""
    return packing.pack(packing.tokenise(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", remove_repeats),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the language model nor the packing; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    home = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"{home}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
