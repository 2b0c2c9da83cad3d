"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens (tokenised in blocks, a zero id after each
document; only longer documents are cut, and their first piece is the shorter one). Each piece
draws a block of about ``BLOCK_PIECES`` (written with it), so no key decides a block's size. Inside a block, pieces
of one length are interchangeable, so a solution is a list of bins of lengths.

Per block, ``ISLANDS`` islands each breed a population: a child takes the fullest bins of one parent
whole, keeps those bins of the other parent that do not use up more pieces of a length than there
are (bins with duplicates are taken apart), and best-fits the displaced pieces, longest first. After
each epoch an island's elite migrates to the next island on a ring through a written table. The block's best
solution is dealt out by rank: the k-th piece of a length takes the k-th place of that length. The
search ends early in a block whose elite uses no more bins than its tokens need at least.

Defined results: null text counts as empty (the one zero id); pieces of ties are ordered by id, start
and checksum, so repeated rows get places of their own; a null id is allowed; an empty table packs to
no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bpe import BlockEncoder
from ._common import blocks, bounded_batches, cut, trimmed, work_dir

CAPACITY = 2048
BLOCK_PIECES = 16_384
#: Characters encoded at a time (a longer text is a block of its own); an encoding's arrays take about a hundred bytes a character.
BLOCK_CHARS = 1 << 19
#: Set where best-fit decreasing is not best (lengths that fill bins by threes): it is 6 % above the least there, the search 4 %.
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 2, 10, 6
#: Share of a parent's fullest bins that a child takes whole.
INJECTED = 0.5

#: Tasks of an epoch; beyond, a task breeds several islands one after the other.
MOST_TASKS = 20_000

#: The encoders of the tasks that run in this worker.
_encoders: dict[str, BlockEncoder] = {}


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    if path not in _encoders:
        _encoders[path] = BlockEncoder(path)
    encoder = _encoders[path]
    for batch in batches:
        docs, texts = batch.column("doc_id"), batch.column("text")
        lengths = [len(t) for t in texts.to_pylist()]
        for a, b in blocks(lengths, BLOCK_CHARS):
            rows, piece, start, length, crc, ids_out = [], [], [], [], [], []
            for i, ids in enumerate(encoder.encode(texts.slice(a, b - a).to_pylist()), a):
                ids = np.append(ids, np.uint32(0))
                first = (len(ids) - 1) % capacity + 1
                at = 0
                for k, to in enumerate(range(first, len(ids) + 1, capacity)):
                    raw = ids[at:to].astype("<u4").tobytes()
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(raw))
                    if with_ids:
                        ids_out.append(ids[at:to])
                    at = to
            columns = [docs.take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids_out, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    _encoders.pop(path, None)  # a worker lives on: later stages need the memory more than the next task needs the table


def tokenise(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda it: trimmed(_pieces(it, tokenizer_path, capacity, with_ids)), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


class _Room:
    """Bins by room left, with the least sufficient room found in a bit set."""

    def __init__(self, capacity: int):
        self.bins: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, bin_: list[int], room: int) -> None:
        self.bins[room].append(bin_)
        self.mask |= 1 << room

    def take(self, length: int) -> tuple[list[int], int] | None:
        fit = self.mask >> length
        if not fit:
            return None
        room = length + (fit & -fit).bit_length() - 1
        bin_ = self.bins[room].pop()
        if not self.bins[room]:
            self.mask &= ~(1 << room)
        return bin_, room


def best_fit(bins: list[list[int]], loose: list[int], capacity: int) -> list[list[int]]:
    """``bins`` with the ``loose`` lengths put in, in the order given, each where least room stays."""
    room, out = _Room(capacity), [list(b) for b in bins]
    for b in out:
        if left := capacity - sum(b):
            room.add(b, left)
    for length in loose:
        found = room.take(length)
        if found is None:
            bin_, left = [], capacity
            out.append(bin_)
        else:
            bin_, left = found
        bin_.append(length)
        if left - length:
            room.add(bin_, left - length)
    return out


def fitness(bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins, then fuller ones: the sum of squared fillings."""
    return -len(bins), sum((sum(b) / capacity) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], counts: np.ndarray, capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """A child of two parents: whole well-filled bins of ``a`` are injected into ``b``."""
    keyed = sorted(a, key=lambda x: (capacity - sum(x), rng.random()))
    injected = keyed[: max(1, int(len(keyed) * INJECTED))]
    left = counts.copy()
    for x in injected:
        for n in x:
            left[n] -= 1
    left = left.tolist()
    kept = []
    for x in sorted(b, key=lambda x: (capacity - sum(x), rng.random())):
        for k, n in enumerate(x):
            if not left[n]:  # the bin holds a duplicate: it is taken apart
                for m in x[:k]:
                    left[m] += 1
                break
            left[n] -= 1
        else:
            kept.append(x)
    # the least filled of the kept bins are opened too, so that their pieces can find better company
    spare = [n for x in kept if capacity - sum(x) > capacity // 8 for n in x]
    kept = [x for x in kept if capacity - sum(x) <= capacity // 8]
    loose = spare + [n for n, k in enumerate(left) for _ in range(k)]
    return best_fit(injected + kept, sorted(loose, reverse=True), capacity)


def _start(counts: np.ndarray, capacity: int, rng: np.random.Generator, k: int) -> list[list[int]]:
    lengths = np.repeat(np.arange(len(counts)), counts)[::-1]
    if k:  # others than the first member: the descending order disturbed
        lengths = lengths[np.argsort(-lengths * rng.uniform(0.8, 1.0, len(lengths)), kind="stable")]
    return best_fit([], lengths.tolist(), capacity)


def evolve(counts: np.ndarray, elites: list[list[list[int]]], capacity: int, seed: list[int], generations: int, population: int) -> list[list[int]]:
    """An island's best solution after one epoch, from the elites it was sent."""
    rng = np.random.default_rng(seed)
    least = -(-int((counts * np.arange(len(counts))).sum()) // capacity)
    members = list(elites)
    while len(members) < population and not any(len(m) <= least for m in members):
        members.append(_start(counts, capacity, rng, len(members)))
    members.sort(key=lambda m: fitness(m, capacity), reverse=True)
    for _ in range(generations):
        if len(members[0]) <= least:
            break
        children = []
        for _ in range(population // 2):
            i, j = rng.choice(len(members), 2, replace=False) if len(members) > 1 else (0, 0)
            children.append(crossover(members[i], members[j], counts, capacity, rng))
        members = sorted(members + children, key=lambda m: fitness(m, capacity), reverse=True)[:population]
    return members[0]


def _pack_bins(bins: list[list[int]]) -> bytes:
    return np.array([v for b in bins for v in (len(b), *b)], "<u2").tobytes()


def _unpack_bins(data: bytes) -> list[list[int]]:
    flat, out, at = np.frombuffer(data, "<u2").tolist(), [], 0
    while at < len(flat):
        out.append(flat[at + 1 : at + 1 + flat[at]])
        at += 1 + flat[at]
    return out


def _epoch(capacity: int, epoch: int, generations: int, population: int):
    """The function of one island's epoch: its histogram and the elites sent to it give its best solution."""

    def island(key: tuple[pa.Scalar, ...], hist: pa.Table, sent: pa.Table) -> pa.Table:
        block, number = (x.as_py() for x in key)
        counts = np.zeros(capacity, np.int64)
        counts[hist.column("length").to_numpy()] = hist.column("n").to_numpy()
        seed = [block, number, epoch]
        best = evolve(counts, [_unpack_bins(x) for x in sent.column("bins").to_pylist()], capacity, seed, generations, population)
        return pa.table({"block": [block], "island": [number], "n_bins": [len(best)], "bins": [_pack_bins(best)]})

    return island


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, bins in zip(batch.column("block").to_pylist(), batch.column("bins").to_pylist(), strict=True):
            seen: dict[int, int] = {}
            length, rank, number, offset = [], [], [], []
            for k, b in enumerate(_unpack_bins(bins)):
                at = 0
                for n in b:
                    seen[n] = seen.get(n, 0) + 1
                    length.append(n)
                    rank.append(seen[n])
                    number.append(k)
                    offset.append(at)
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rank), pa.int64()), pa.array(length, pa.int64()), pa.array(rank, pa.int32()), pa.array(number, pa.int64()), pa.array(offset, pa.int64())], names=["block", "length", "rank", "bin", "offset"])


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, migrate: bool = True) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Without ``migrate`` each island only goes on with its own elite.
    """
    spark = pieces.sparkSession
    home = work_dir(spark, "packing")
    pieces = cut(pieces.withColumn("draw", F.rand(0)), f"{home}/pieces")
    n = pieces.count()
    n_blocks = max(1, -(-n // BLOCK_PIECES))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    pieces = pieces.withColumn("block", F.floor(F.col("draw") * n_blocks).cast("long"))
    small = pieces.filter(F.col("length") < capacity)
    hist = cut(small.groupBy("block", "length").agg(F.count("*").alias("n")), f"{home}/hist")
    each = hist.withColumn("island", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(islands - 1).cast("long"))))
    kind = "block long, island long, n_bins long, bins binary"
    elites = spark.createDataFrame([], kind)
    for epoch in range(epochs):
        # as many tasks as islands, however few bytes they read: an island's work is not in its input's size
        spread = [x.repartition(min(n_blocks * islands, MOST_TASKS), "block", "island").groupBy("block", "island") for x in (each, elites)]
        grouped = spread[0].cogroup(spread[1])
        bred = cut(grouped.applyInArrow(_epoch(capacity, epoch, generations, population), kind), f"{home}/epoch{epoch}")
        away = bred.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)))
        elites = bred.unionByName(away).dropDuplicates(["block", "island", "bins"]) if migrate else bred
    best = bred.groupBy("block").agg(F.min_by("bins", F.struct("n_bins", "island")).alias("bins"))
    places = best.mapInArrow(_places, "block long, length long, rank int, bin long, offset long")
    rank = F.row_number().over(Window.partitionBy("block", "length").orderBy(*order))
    placed = small.withColumn("rank", rank).join(places, ["block", "length", "rank"])
    # a full piece is a sequence of its own; these are numbered per block and bucket after the packed ones
    full = pieces.filter(F.col("length") == capacity)
    whole = full.withColumn("bin", F.row_number().over(Window.partitionBy("block").orderBy(*order)) + (1 << 31)).withColumn("offset", F.lit(0).cast("long"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", (F.col("block") * (1 << 32) + F.col("bin")).alias("sequence_id"), "offset"]
    return placed.select(*names).unionByName(whole.select(*names))
