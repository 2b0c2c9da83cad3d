"""Suffix-array deduplication: every byte covered by a repeated string of ``width`` bytes is removed.

1. Each string of ``width`` bytes has an anchor: the least hash among its 32-byte windows. Equal strings
   have the same anchor at the same place. A text's strings with one anchor are a run of starts; the
   bytes that they span are a context. Only contexts whose anchor occurs again go on.
2. Equal contexts count once: where two are equal, all their strings repeat. Different contexts of one
   anchor go, one of each kind, to a shard: a group of whole anchors of about ``SHARD_BYTES``.
3. A shard's suffix array is made by induced sorting: suffixes are classified, the leftmost-smaller
   substrings sorted by inducing, named and, where names repeat, sorted recursively, and the array is
   induced from them in linear time (array operations per first byte on the lowest level). The
   permuted common prefixes follow: a reducible one is its predecessor less one, the others are
   measured. A start whose string is shared with a neighbour in the array repeats.
4. Repeated starts go back to all documents with that context; the union of the strings is removed.

An anchor with contexts beyond ``HOT_CONTEXTS`` (a passage that very many documents hold, each with
text of its own around it) never reaches a shard. Its contexts are cut into blocks of ``BLOCK_STARTS``
starts at fixed offsets to the anchor; all strings of a block hold its core, the bytes that they have
in common, so blocks of different cores hold no equal strings. Blocks of one core that are equal in
full repeat in full; where they differ, each start goes by offset and string hash. Both steps are
counts of narrow rows, aggregated before they are shuffled, so no task gathers an anchor's contexts.

Defined results: null text counts as empty; texts shorter than ``width`` are never touched; repeated
rows are copies, so all of their strings repeat; a null id is allowed; an empty table gives no rows;
other columns are not read. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, discard, never_keys, only_keys, trimmed, work_dir
from ._sais import permuted_common_prefixes, suffix_array
from ._text import mix, prefix_hash, span_hash

WIDTH = 400
#: Bytes of an anchor's window.
ANCHOR = 32
#: Bytes that one suffix array covers; a single anchor's contexts may be more.
SHARD_BYTES = 1 << 20
#: Different contexts of an anchor beyond which they are not sorted but split into blocks and starts.
HOT_CONTEXTS = 1_000
#: Starts of a block of a hot context.
BLOCK_STARTS = 32
#: Starts of a text handled at a time.
STRETCH = 1 << 20


def anchors(data: np.ndarray, width: int = WIDTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of starts with one anchor: (anchor hash, context hash, first start, starts, anchor's place)."""
    for at in range(0, max(0, len(data) - width + 1), STRETCH):
        part = data[at : at + STRETCH + width - 1]
        prefix = prefix_hash(part)
        n = len(part) - ANCHOR + 1
        window = width - ANCHOR + 1
        begin = np.arange(n)
        h = span_hash(prefix, begin, begin + ANCHOR)
        key = (h & ~np.uint64((1 << 24) - 1)) | begin.astype(np.uint64)
        least = _sliding_min(key, window)
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        edges = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]])
        first, end = edges[:-1], edges[1:]
        where = place[first]
        context = span_hash(prefix, first, end + width - 1) ^ mix(((where - first) * 4096 + (end - first)).astype(np.uint64))
        yield h[where], context, first + at, end - first, where - first


def _sliding_min(x: np.ndarray, window: int) -> np.ndarray:
    """Minima of all windows, from the running minima of blocks of the window's size, both ways."""
    n = len(x) - window + 1
    rows = -(-len(x) // window)
    padded = np.full(rows * window, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks_ = padded.reshape(rows, window)
    ahead = np.minimum.accumulate(blocks_, axis=1).ravel()
    back = np.minimum.accumulate(blocks_[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[window - 1 : window - 1 + n])


_OCCURS = "doc_id {kind}, digest long, anchor long, context long, first long, starts int, place int"


def _occurrences(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found = [], []
        for i, text in enumerate(batch.column("text")):
            data = np.frombuffer(text.as_buffer() or b"", np.uint8)
            if len(data) >= width:
                for part in anchors(data, width):
                    rows.append(np.full(len(part[0]), i))
                    found.append(part)
        if rows:
            a, c, first, starts, place = (np.concatenate(x) for x in zip(*found, strict=True))
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("digest").take(take), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(first), pa.array(starts.astype(np.int32)), pa.array(place.astype(np.int32))],
                names=["doc_id", "digest", "anchor", "context", "first", "starts", "place"],
            )


_CUT = "anchor long, context long, place int, n int, hot boolean, bytes binary"
_CUT_ARROW = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("place", pa.int32()), ("n", pa.int32()), ("hot", pa.bool_()), ("bytes", pa.binary())])


def _contexts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted context."""
    for batch in batches:
        rows, size = [], 0
        for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
            data = text.as_buffer()
            data = memoryview(data) if data is not None else memoryview(b"")
            for w in wanted.as_py():
                a, n = w["first"], w["starts"]
                rows.append({"anchor": w["anchor"], "context": w["context"], "place": w["place"], "n": n, "hot": w["hot"], "bytes": bytes(data[a : a + n + width - 1])})
                size += n + width - 1
                if size > SHARD_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _CUT_ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _CUT_ARROW)


def _hot_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Blocks of hot contexts: starts from lo to hi, a hash of the block's place and core, one of all its bytes."""
    for batch in batches:
        out = []
        for k, (place, n, data) in enumerate(zip(batch.column("place").to_pylist(), batch.column("n").to_pylist(), batch.column("bytes"), strict=True)):
            prefix = prefix_hash(np.frombuffer(data.as_buffer(), np.uint8))
            number = np.arange((place - n + 1) // BLOCK_STARTS, place // BLOCK_STARTS + 1)  # by offset to the anchor
            first, last = place - (number + 1) * BLOCK_STARTS + 1, place - number * BLOCK_STARTS
            lo, hi = np.maximum(first, 0), np.minimum(last, n - 1)
            salt = mix((number + (1 << 20)).astype(np.uint64))
            core = span_hash(prefix, last, first + width) ^ salt
            whole = span_hash(prefix, lo, hi + width) ^ mix(((lo - first) * 4096 + hi - lo).astype(np.uint64)) ^ salt
            out.append((np.full(len(number), k), lo, hi + 1, core, whole))
        if out:
            row, lo, hi, core, whole = (np.concatenate(x) for x in zip(*out, strict=True))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("anchor").take(take), batch.column("context").take(take), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64))],
                names=["anchor", "context", "lo", "hi", "core", "whole"],
            )


def _hot_starts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The starts of blocks of hot contexts: a hash of the string and its offset to the anchor."""
    for batch in batches:
        out = []
        for k, (place, data, ranges) in enumerate(zip(batch.column("place").to_pylist(), batch.column("bytes"), batch.column("ranges").to_pylist(), strict=True)):
            prefix = prefix_hash(np.frombuffer(data.as_buffer(), np.uint8))
            lo = np.concatenate([np.arange(r["lo"], r["hi"]) for r in ranges])
            out.append((np.full(len(lo), k), lo, span_hash(prefix, lo, lo + width) ^ mix((place - lo + (1 << 20)).astype(np.uint64))))
        if out:
            row, lo, string = (np.concatenate(x) for x in zip(*out, strict=True))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("anchor").take(take), batch.column("context").take(take), pa.array(lo.astype(np.int32)), pa.array(string.view(np.int64))], names=["anchor", "context", "lo", "string"])


def _hot_found(hot: DataFrame, width: int, home: str) -> DataFrame:
    """Repeated starts of hot contexts, as ranges (anchor, context, lo, hi)."""
    blocks = cut(hot.mapInArrow(lambda it: _hot_blocks(it, width), "anchor long, context long, lo int, hi int, core long, whole long"), f"{home}/blocks")
    cores = blocks.groupBy("anchor", "core").agg(F.count("*").alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most")).filter("n > 1")
    again = cut(blocks.join(cores.drop("n"), ["anchor", "core"]).select("anchor", "context", "lo", "hi", (F.col("least") == F.col("most")).alias("equal")), f"{home}/again")
    mixed = again.filter("NOT equal").groupBy("anchor", "context").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    each = hot.join(mixed, ["anchor", "context"]).select("anchor", "context", "place", "bytes", "ranges")
    each = cut(each.mapInArrow(lambda it: _hot_starts(it, width), "anchor long, context long, lo int, string long"), f"{home}/starts")
    strings = each.groupBy("anchor", "string").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    single = each.join(strings, ["anchor", "string"]).select("anchor", "context", "lo", (F.col("lo") + 1).alias("hi"))
    return again.filter("equal").select("anchor", "context", "lo", "hi").unionByName(single)


def repeated_starts(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Per text, whether the string of ``width`` bytes at each start occurs at another start of any text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    # 0xF8 ends a text: no UTF-8 text holds it
    joined = np.frombuffer(b"\xf8".join([*texts, b""]), np.uint8).astype(np.int32)
    order = suffix_array(joined)
    common = permuted_common_prefixes(joined, order, width)  # with the suffix before, by place
    shared = common >= width
    again = np.zeros(len(joined), bool)
    again[shared] = True
    before = np.empty(len(joined), np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = order[0]
    again[before[shared]] = True
    return [again[end - n : end - width + 1] for end, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


_FOUND = "anchor long, context long, lo int, hi int"
_FOUND_ARROW = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _shards(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: whole groups are gathered to a shard, and shards are searched."""
    held: list[dict] = []
    group: list[dict] = []
    size = own = 0

    def search():
        out = []
        for r, again in zip(held, repeated_starts([r["bytes"] for r in held], width), strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], again.view(np.int8), [0]])))
            out += [{"anchor": r["anchor"], "context": r["context"], "lo": a, "hi": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
        held.clear()
        return pa.RecordBatch.from_pylist(out, _FOUND_ARROW)

    for batch in batches:
        for r in batch.to_pylist():
            if group and group[0]["anchor"] != r["anchor"]:
                if len(group) > 1:
                    if held and size + own > SHARD_BYTES:
                        yield search()
                        size = 0
                    held += group
                    size += own
                group, own = [], 0
            group.append(r)
            own += len(r["bytes"])
    if len(group) > 1:
        held += group
    if held:
        yield search()


def repeated_ranges(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, digest, ranges): the byte ranges to remove of documents that have any, merged and sorted.

    ``digest`` is the text's, so that rows of one id are told apart.
    """
    spark = docs.sparkSession
    home = work_dir(spark, "suffix")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("digest"), text.cast("binary").alias("text"))
    keys = ["anchor", "context"]
    occurs = cut(texts.mapInArrow(lambda it: trimmed(_occurrences(it, width)), _OCCURS.format(kind=kind)), f"{home}/occurs")
    again = occurs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    hits = cut(occurs.join(again, "anchor", "left_semi"), f"{home}/hits")
    discard(spark, f"{home}/occurs")
    each = hits.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "digest", "first", "starts", "place")).alias("rep"))
    each = cut(each, f"{home}/each")
    groups = each.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor", (F.col("kinds") > HOT_CONTEXTS).alias("hot"))
    wanted = each.join(groups, "anchor").select("rep.doc_id", "rep.digest", F.struct("anchor", "context", "rep.first", "rep.starts", "rep.place", "hot").alias("w"))
    wanted = cut(wanted.groupBy("doc_id", "digest").agg(F.collect_list("w").alias("wanted")), f"{home}/wanted")
    same = [F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")), F.col("t.digest") == F.col("w.digest")]
    there = only_keys(texts, wanted, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]) if _repeats(docs, id_col) else only_keys(texts, wanted, ["doc_id", "digest"])
    parts = cut(there.alias("t").join(wanted.alias("w"), same).select("t.text", "w.wanted").mapInArrow(lambda it: trimmed(_contexts(it, width)), _CUT), f"{home}/parts")
    sorted_ = parts.filter("NOT hot").select("anchor", "context", "bytes").repartition("anchor").sortWithinPartitions("anchor", "context")
    found = sorted_.mapInArrow(lambda it: trimmed(_shards(it, width)), _FOUND)
    hot = parts.filter("hot")
    if not hot.isEmpty():
        found = found.unionByName(_hot_found(hot, width, home))
    whole = each.filter("n > 1").select("anchor", "context", F.lit(0).alias("lo"), F.col("rep.starts").alias("hi"))
    found = cut(found.unionByName(whole), f"{home}/found")
    ranges = hits.join(found, keys).select("doc_id", "digest", F.struct((F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") + width - 1).alias("hi")).alias("r"))
    return cut(ranges.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("r")).alias("ranges")), f"{home}/ranges")


def _repeats(docs: DataFrame, id_col: str) -> bool:
    return not docs.groupBy(id_col).count().filter("count > 1").isEmpty()


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, spans, digests = [], [], [], []
        for text, ranges in zip(batch.column("text"), batch.column("ranges").to_pylist(), strict=True):
            data = text.as_py()
            cuts = merged([(r["lo"], r["hi"]) for r in ranges])
            h, at = hashlib.sha256(), 0
            for a, b in [*cuts, (len(data), len(data))]:
                h.update(data[at:a])
                at = b
            sizes.append(len(data))
            removed.append(sum(b - a for a, b in cuts))
            spans.append(len(cuts))
            digests.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (sizes, removed, spans)], pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, has_repeats), one per document."""
    ranges = repeated_ranges(docs, id_col=id_col, text_col=text_col, width=width)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("digest"), text.cast("binary").alias("text"))
    untouched, touched = split_by(texts, ranges)
    touched = touched.mapInArrow(_remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    untouched = untouched.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return untouched.unionByName(touched).withColumns({"n_kept": F.col("n_bytes") - F.col("n_removed"), "has_repeats": F.col("n_removed") > 0})


def split_by(texts: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without ranges, and rows with them; texts whose hashed bucket has no range are not shuffled."""
    on = ["doc_id", "digest"]
    clear = never_keys(texts, ranges, on)
    maybe = only_keys(texts, ranges, on).alias("t").join(ranges.alias("r"), [F.col("t.doc_id").eqNullSafe(F.col("r.doc_id")), F.col("t.digest") == F.col("r.digest")], "left").select("t.*", "r.ranges")
    return clear.unionByName(maybe.filter("ranges IS NULL").drop("ranges")), maybe.filter("ranges IS NOT NULL")


def snapped(data: bytes, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``cuts`` narrowed to whole characters, so that what stays is valid UTF-8."""
    out = []
    for a, b in cuts:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def strip_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated strings taken out of the texts, as whole characters; no row goes.

    ``chars_col``, where there is one, is set to the new length.
    """
    ranges = repeated_ranges(docs, id_col=id_col, text_col=text_col, width=width)
    rows = docs.withColumn("__docloom_digest", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    texts = rows.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.col("__docloom_digest").alias("digest"), F.col(text_col).cast("binary").alias("text"))
    untouched, touched = split_by(texts, ranges)

    def strip(batches):
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column("text"), batch.column("ranges").to_pylist(), strict=True):
                data, kept, at = text.as_py(), [], 0
                for a, b in [*snapped(data, merged([(r["lo"], r["hi"]) for r in cuts])), (len(data), len(data))]:
                    kept.append(data[at:a])
                    at = b
                out.append(b"".join(kept).decode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "kept"])

    kind = docs.schema.simpleString()
    new = touched.select("row", "text", "ranges").mapInArrow(strip, f"row {kind}, kept string")
    fields = [F.col("kept").alias(c) if c == text_col else F.length("kept").cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return untouched.select("row.*").unionByName(new.select(*fields))
