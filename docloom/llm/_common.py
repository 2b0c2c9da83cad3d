"""What the operators share: the shared work folder, written tables and text blocks."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass works on at a time (a longer text is a block of its own).
BLOCK_BYTES = 1 << 20


#: Bytes of an Arrow batch that a Python worker gets (a longer row is a batch of its own).
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Lower the session's Arrow batches to ``most`` bytes, if they are larger: the engine's rows hold whole texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= most:
        spark.conf.set(name, str(most))


def trimmed(batches: Iterator) -> Iterator:
    """What an iterator gives; at its end the memory that it freed is handed back."""
    yield from batches
    give_back()


def collect_garbage(spark: SparkSession) -> None:
    """Have the executors collect their garbage, a task a core: a heap that holds little then shrinks.

    Left alone it keeps what it grew to, and what comes next grows it from there.
    """
    tasks = max(1, spark.sparkContext.defaultParallelism)
    collected = F.reflect(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, tasks, 1, tasks).select(collected.alias("collected")).write.format("noop").mode("overwrite").save()


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    The setting is only filled in where the session has none and all tasks run in the driver's process,
    as in tests on one machine; a cluster without it is refused, as executors could not see the folder.
    """
    bounded_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a table and read it back: later plans start there, whoever is lost."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove written tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Plan nodes under which a row still is one row of one file.
_ROWWISE = {"Project", "Filter", "Relation", "SubqueryAlias"}


def with_locator(docs: DataFrame, path: str, name: str) -> DataFrame:
    """``docs`` with each row's place, file and row, as column ``name``; rows not straight from Parquet files are written to ``path`` first."""
    plan = docs._jdf.queryExecution().analyzed().toString()
    nodes = {m[1] for m in re.finditer(r"^[\s:+|-]*'?(\w+)", plan, re.M)}
    if not (nodes <= _ROWWISE and re.search(r"Relation\b.* parquet\s*$", plan)):
        docs = cut(docs, path)
    return docs.withColumn(name, F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")))


#: Buckets of a key filter: the broadcast holds at most so many longs (8 MB), however large the input.
FILTER_BUCKETS = 1 << 20


_BUCKET = "__docloom_bucket"


def _bucketed(df: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    bucket = F.pmod(F.xxhash64(*on), F.lit(FILTER_BUCKETS))
    return df.withColumn(_BUCKET, bucket), F.broadcast(keys.select(bucket.alias(_BUCKET)).distinct())


def only_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose ``on`` columns may be among ``keys``: a hashed-bucket filter.

    It never loses a matching row; others pass by chance, so an exact join follows. Its use is that
    wide rows without a partner are dropped before that join shuffles them. The broadcast side is
    bounded by ``FILTER_BUCKETS`` rows.
    """
    rows, hit = _bucketed(df, keys, on)
    return rows.join(hit, _BUCKET, "left_semi").drop(_BUCKET)


def never_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The other rows: those that ``only_keys`` drops."""
    rows, hit = _bucketed(df, keys, on)
    return rows.join(hit, _BUCKET, "left_anti").drop(_BUCKET)


def without_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose ``on`` columns (null equals null) are not among ``keys``; few are shuffled."""
    here, there = only_keys(df, keys, on).alias("d"), keys.select(*on).distinct().alias("k")
    same = [F.col(f"d.`{c}`").eqNullSafe(F.col(f"k.`{c}`")) for c in on]
    return never_keys(df, keys, on).unionByName(here.join(there, same, "left_anti"))


def give_back() -> None:
    """Hand a Python worker's freed memory back to the machine: workers stay alive between stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def blocks(lengths, limit: int = BLOCK_BYTES):
    """Row ranges (start, end) whose summed lengths stay within ``limit``, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
