"""Exact deduplication by a stream with keyed state on disk.

Each document becomes a narrow row: digest of its normalised text, stable id, length and content
locator (file and row). A Structured Streaming query reads these rows in bounded micro-batches and
keeps one state entry per digest, without watermark and so without expiry, in RocksDB: the row that
stays, where its content is, and how many there are. The finished state is read back with the state
reader. The contents of an entry and of the rows that hit it are then fetched by their locators, and
each hit's whole normalised text is compared with the entry's; should a digest ever cover different
texts, its rows are grouped again by the text. Every text is normalised and hashed once, and only the
texts of groups are read and normalised a second time.

Everything is DataFrame or SQL functions; the stream aggregates map-side before it shuffles, so a hot
digest reaches its state as one row per task, and the byte check salts hot digests. Rows that do not
come straight from Parquet files are written first, so that each has a locator.

Equal means: identical after deleting every space and control from tab to carriage return. The row
with the most code points stays, then the one with the smallest id (a null id counts as the largest).
Defined results: null text counts as empty; empty texts form one group; repeated rows (same id and
text) are members of their group, and all of them carry its id, so all are marked kept if that id
stays; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, discard, only_keys, with_locator, without_keys, work_dir

#: Fixed set of characters that do not count.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows that one copy of a hot digest's text is compared with.
SALT_ROWS = 5_000
_NULL_ID = 2**63 - 1
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _state(rows: DataFrame, home: str, files_per_batch: int) -> DataFrame:
    """One row per digest, (digest, keep, n), kept as state by a streaming aggregation."""
    spark = rows.sparkSession
    before = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{home}/rows")
        best = F.max(F.struct("n_points", F.negative("key_id").alias("neg_id"), "locator")).alias("best")
        query = (
            stream.groupBy("digest").agg(best, F.count("*").alias("n"))
            .writeStream.format("noop").outputMode("update")
            .option("checkpointLocation", f"{home}/stream").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        if query.exception():
            raise query.exception()
        held = spark.read.format("statestore").load(f"{home}/stream")
        names = [f.name for f in held.schema["value"].dataType.fields]
        held = held.select("key.digest", F.col(f"value.`{names[0]}`").alias("best"), F.col(f"value.`{names[1]}`").alias("n"))
        return cut(held.select("digest", F.negative("best.neg_id").alias("keep_id"), F.col("best.locator").alias("keep_locator"), "n"), f"{home}/state")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_AT = "__docloom_at"


def _digest(bare: Column) -> Column:
    return F.sha2(bare.cast("binary"), 256)


def _grouped(docs: DataFrame, id_col: str, text_col: str, files_per_batch: int) -> tuple[DataFrame, DataFrame, str]:
    """``docs`` with locators; per row (doc_id, key_id, digest, locator, keep_id, keep_locator, group_size); the work folder."""
    home = work_dir(docs.sparkSession, "exact")
    located = with_locator(docs, f"{home}/docs", _AT)
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, BLANKS, "")
    key_id = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID))
    rows = located.select(F.col(id_col).alias("doc_id"), key_id.alias("key_id"), F.length(text).cast("long").alias("n_points"), _digest(bare).alias("digest"), F.col(_AT).alias("locator"))
    rows = cut(rows, f"{home}/rows")
    if rows.isEmpty():
        return located, rows.select("doc_id", "key_id", "digest", "locator", F.col("key_id").alias("keep_id"), F.col("locator").alias("keep_locator"), F.lit(0).cast("long").alias("group_size")), home
    state = _state(rows, home, files_per_batch)
    names = ["doc_id", "key_id", "digest", "locator", "keep_id", "keep_locator", "group_size"]
    found = cut(rows.join(state.withColumnRenamed("n", "group_size"), "digest").select("n_points", *names), f"{home}/found")

    # whole-text check of every hit: a copy of the entry's text per SALT_ROWS rows that it is held against
    members = found.filter("group_size > 1").select("locator", "digest", (F.col("locator") == F.col("keep_locator")).alias("is_entry"), F.expr(f"group_size div {SALT_ROWS} + 1").alias("salts"))
    texts = only_keys(located.select(F.col(_AT).alias("locator"), F.col(text_col).alias("text")), members, ["locator"])
    contents = texts.join(members, "locator").select("locator", "digest", "is_entry", "salts", F.translate(F.coalesce("text", F.lit("")), BLANKS, "").alias("bare"))
    contents = cut(contents, f"{home}/contents")
    entry = contents.filter("is_entry").select("digest", F.col("bare").alias("entry"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    hits = contents.filter("NOT is_entry").select("digest", "bare", F.pmod(F.xxhash64("locator"), F.col("salts")).alias("salt"))
    differ = hits.join(entry, ["digest", "salt"]).filter(F.col("bare") != F.col("entry")).select("digest").distinct()
    differ = cut(differ, f"{home}/differ")
    if not differ.isEmpty():  # a digest of several texts: its rows are grouped by the text
        again = contents.join(differ, "digest", "left_semi").select("locator", "bare").join(found.select("doc_id", "key_id", "n_points", "digest", "locator"), "locator")
        best = again.groupBy("digest", "bare").agg(F.max(F.struct("n_points", F.negative("key_id").alias("neg_id"), "locator")).alias("best"), F.count("*").alias("group_size"))
        best = best.select("digest", "bare", F.negative("best.neg_id").alias("keep_id"), F.col("best.locator").alias("keep_locator"), "group_size")
        again = again.join(best, ["digest", "bare"]).select(*names)
        found = cut(found.select(*names).join(differ, "digest", "left_anti").unionByName(again), f"{home}/regrouped")
    discard(docs.sparkSession, f"{home}/contents", f"{home}/state")
    return located, found.select(*names), home


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 1000) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one per document."""
    _, found, _ = _grouped(docs, id_col, text_col, files_per_batch)
    keep = F.when(F.col("keep_id") != _NULL_ID, F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("key_id") == F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 1000) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; its columns and rows are otherwise as they were.

    Of repeated rows (same id and text) the one stays whose locator the state holds.
    """
    located, found, _ = _grouped(docs, id_col, text_col, files_per_batch)
    gone = found.filter("locator <> keep_locator").select(F.col("locator").alias(_AT))
    return without_keys(located, gone, [_AT]).drop(_AT)
