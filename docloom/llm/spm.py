"""Encoding and decoding with a SentencePiece merge model, with seeded merge-dropout.

A text's blanks become the word mark and a mark is put in front. No piece has a mark after another
character, so a segment (marks and what follows up to the next mark) is encoded by itself. The agenda
holds the possible merges of neighbouring symbols; the best scored, leftmost one is done first. A
candidate is skipped for good if the keyed hash of (seed, document, the segment's number, places of
both symbols, merged piece) falls below the dropout rate, so every occurrence of a word draws its own
merges, and any run with the same seed gives the same ids. Segments are encoded many at a time by array
operations, a step doing the next merge of each of them; long ones go one by one through a heap.
Without dropout a segment's ids depend on its content only and are remembered.

Characters without a piece become byte pieces. A word mark that stands in the text itself is written
in bytes too, so decoding gives back every text exactly.

Defined results: null text counts as empty; an empty text has no ids; the document key of a null id
is 0; repeated rows are encoded alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, bounded_batches, trimmed
from ._table import IdTable
from ._text import mix, powers

MARK = "▁"
#: Rate at which merges are skipped.
DROPOUT = 0.1
#: Encodings without dropout that a worker keeps.
REMEMBERED = 1_000_000
#: Segments of more characters go through the heap.
LONG = 48
#: Segments that are merged at a time.
TOGETHER = 16_384
#: Stands for a word mark of the text itself.
_OWN_MARK = 0x110000
_NONE = np.int32((1 << 31) - 1)


class PairTable:
    """Merged pieces by pair of symbols: an open hash table that is searched for many pairs at once."""

    def __init__(self, lefts: np.ndarray, rights: np.ndarray, merged: np.ndarray):
        bits = max(10, int(len(lefts) * 8).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        key = lefts << 32 | rights
        at, rest = self._place(key), np.arange(len(key))
        while len(rest):
            free = rest[self.keys[at[rest]] == -1]
            _, first = np.unique(at[free], return_index=True)
            now = free[first]
            self.keys[at[now]], self.values[at[now]] = key[now], merged[now]
            rest = rest[self.keys[at[rest]] != key[rest]]
            at[rest] = at[rest] + 1 & self.mask

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged pieces, -1 where there is none; a negative symbol is in no pair."""
        key = left << 32 | right
        at = self._place(key)
        held = self.keys[at]
        found = np.where(held == key, self.values[at], np.int32(-1))
        rest = np.flatnonzero((held != key) & (held != -1) & (key >= 0))
        while len(rest):
            at[rest] = at[rest] + 1 & self.mask
            held = self.keys[at[rest]]
            found[rest] = np.where(held == key[rest], self.values[at[rest]], np.int32(-1))
            rest = rest[(held != key[rest]) & (held != -1)]
        return found


class Model:
    """Pieces of a model file: characters, mergeable pairs, bytes of every piece."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.id_of = {pieces[i]: i for i in plain}
        #: Order of merging: 0 is done first. Equal scores share a rank.
        scores = np.array([sp.get_score(i) for i in plain])
        self.rank = np.full(self.size + 1, _NONE, np.int32)  # the last stands for no piece
        self.rank[plain] = np.unique(-scores, return_inverse=True)[1]
        self.byte_ids = np.array([self.id_of_byte(sp, b) for b in range(256)], np.uint32)
        lefts, rights, merged = [], [], []
        symbol = dict(self.id_of)
        for p in self.id_of:
            for c in p:
                symbol.setdefault(c, len(symbol) + self.size)
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                if p[:k] in symbol and p[k:] in symbol:
                    lefts.append(symbol[p[:k]])
                    rights.append(symbol[p[k:]])
                    merged.append(i)
        self.symbol_of_char = {ord(c): i for c, i in symbol.items() if len(c) == 1}
        self.look = PairTable(np.array(lefts, np.int64), np.array(rights, np.int64), np.array(merged, np.int32)).look
        spelled = [pieces[i].replace(MARK, " ").encode() for i in range(self.size)]
        for b, i in enumerate(self.byte_ids.tolist()):
            spelled[i] = bytes([b])
        for i in range(self.size):
            if sp.is_control(i):
                spelled[i] = b""
        self.spell_count = np.array([len(x) for x in spelled], np.int64)
        self.spell_begin = np.cumsum(self.spell_count) - self.spell_count
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    @staticmethod
    def id_of_byte(sp, b: int) -> int:
        return sp.piece_to_id(f"<0x{b:02X}>")

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Symbol per code point; characters of no piece are negative."""
        wide, which = np.unique(points, return_inverse=True)
        return np.array([self.symbol_of_char.get(p, -1 - p) for p in wide.tolist()], np.int64)[which]


def _candidate(left, right, merged):
    """What stands for a candidate in its keyed hash: places of its symbols, its piece."""
    return np.uint64(0x9E3779B97F4A7C15) * (left.astype(np.uint64) * np.uint64(1 << 42) + right.astype(np.uint64) * np.uint64(1 << 20) + merged.astype(np.uint64))


def _skip(key, candidate, rate: float):
    """Whether the keyed hash drops a candidate of the segment that has ``key``."""
    return mix(key + candidate) < np.uint64(int(rate * (2**64 - 1)))


def merge_many(model: Model, table: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Segments after merging. ``table``: symbols by segment, padded with -1; returns it and which places are left.

    Symbols stay where they are; links lead from each to its neighbours. Each step does the best candidate
    of every segment that has one, which makes at most two new candidates. A border that nothing merges
    with stands before and after each segment.
    """
    n, wide = table.shape[0], table.shape[1] + 2
    symbols = np.full((n, wide), -1, np.int64)
    symbols[:, 1:-1] = table
    merged, rank = np.full((n, wide), -1, np.int32), np.full((n, wide), _NONE, np.int32)
    ahead = np.tile(np.arange(1, wide + 1, dtype=np.int32), (n, 1)).ravel()
    back = np.tile(np.arange(-1, wide - 1, dtype=np.int32), (n, 1)).ravel()
    left_there = np.ones(n * wide, bool)
    flat, merged_flat, rank_flat = symbols.ravel(), merged.ravel(), rank.ravel()

    def candidates(row, at, to):
        """Enter the merge of the symbols at places ``at`` and ``to`` of the rows, unless it is skipped."""
        base = row * wide
        found = model.look(flat[base + at], flat[base + to])
        if rate:
            some = np.flatnonzero(found >= 0)
            skipped = _skip(keys[row[some]], _candidate(at[some] - 1, to[some] - 1, found[some]), rate)
            found[some[skipped]] = -1
        merged_flat[base + at] = found
        rank_flat[base + at] = model.rank[found]

    row, at = (x.ravel() for x in np.broadcast_arrays(np.arange(n)[:, None], np.arange(1, wide - 2)[None, :]))
    candidates(row, at, at + 1)
    live = np.arange(n)
    while len(live):
        now = rank[live]
        at = now.argmin(1)
        some = now[np.arange(len(live)), at] != _NONE
        live, at = live[some], at[some]
        base = live * wide
        gone = ahead[base + at]
        after = ahead[base + gone]
        flat[base + at] = merged_flat[base + at]
        left_there[base + gone] = False
        rank_flat[base + gone] = _NONE
        ahead[base + at], back[base + after] = after, at
        before = back[base + at]
        candidates(np.concatenate([live, live]), np.concatenate([before, at]), np.concatenate([at, after]))
    return symbols[:, 1:-1], left_there.reshape(n, wide)[:, 1:-1]


def merge_long(model: Model, symbols: np.ndarray, key: np.uint64, rate: float) -> list[int]:
    """The same for one segment, with a heap and links."""
    sym = symbols.tolist()
    n = len(sym)
    ahead, back, agenda = [*range(1, n), -1], [-1, *range(n - 1)], []

    def push(lefts, rights):
        lefts, rights = np.array(lefts, np.int64), np.array(rights, np.int64)
        merged = model.look(np.array([sym[i] for i in lefts], np.int64), np.array([sym[i] for i in rights], np.int64))
        ok = merged >= 0
        if rate:
            ok &= ~_skip(np.full(len(lefts), key, np.uint64), _candidate(lefts, rights, np.maximum(merged, 0)), rate)
        for i, j, m in zip(lefts[ok].tolist(), rights[ok].tolist(), merged[ok].tolist(), strict=True):
            heapq.heappush(agenda, (int(model.rank[m]), i, j, m, sym[i], sym[j]))

    if n > 1:
        push(range(n - 1), range(1, n))
    while agenda:
        _, i, j, m, a, b = heapq.heappop(agenda)
        if sym[i] != a or sym[j] != b or ahead[i] != j:
            continue
        sym[i], sym[j] = m, None
        ahead[i] = ahead[j]
        if ahead[i] >= 0:
            back[ahead[i]] = i
        near = [(x, y) for x, y in ((back[i], i), (i, ahead[i])) if x >= 0 and y >= 0]
        if near:
            push([x for x, _ in near], [y for _, y in near])
    return [x for x in sym if x is not None]


class Encoder:
    def __init__(self, path: str, seed: int = 0, rate: float = DROPOUT):
        self.model, self.seed, self.rate = Model(path), seed, rate
        self.table = IdTable(REMEMBERED)

    def encode(self, texts: list[str], docs: list[int]) -> list[np.ndarray]:
        """Ids of each text; ``docs``: the documents' keys."""
        lengths = [len(t) + 1 if t else 0 for t in texts]
        edges = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(lengths, out=edges[1:])
        if not edges[-1]:
            return [np.zeros(0, np.uint32) for _ in texts]
        points = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le"), np.uint32).copy()
        points[points == ord(MARK)] = _OWN_MARK
        points[points == 0x20] = ord(MARK)
        mark = points == ord(MARK)
        new = mark.copy()
        new[1:] &= ~mark[:-1]
        first = edges[:-1][np.array(lengths) > 0]
        new[first] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(points))
        owner = np.searchsorted(edges, starts, "right") - 1
        number = np.arange(len(starts)) - np.searchsorted(starts, edges[owner])
        salt = np.array([int.from_bytes(hashlib.blake2b(b"%d/%d" % (self.seed, d or 0), digest_size=8).digest(), "big") for d in docs], np.uint64)
        own = mix(salt[owner] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if self.rate:
            ids, counts = self._merged(own, points, starts, ends)
            to = np.concatenate([[0], np.cumsum(counts)])
        else:
            ids, to = self._known(own, points, starts, ends)
        cut = to[np.searchsorted(starts, edges)]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def _known(self, own: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, and where each begins, by content."""
        up, down = powers(len(points))
        prefix = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=prefix[1:])
        content = mix((prefix[ends] - prefix[starts]) * down[starts])
        unique, at, which = np.unique(content, return_index=True, return_inverse=True)
        fresh = self.table.missing(unique)
        if len(fresh):
            at = at[fresh]
            self.table.learn(unique[fresh], *self._merged(own[at], points, starts[at], ends[at]))
        return self.table.spell(unique, which)

    def _merged(self, own: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments one after the other, and how many each has."""
        symbols, sizes = self.model.symbols(points), ends - starts
        rows_, flats, counts_ = [], [], []
        low = 0
        for width in (*range(2, 17), 20, 24, 32, LONG):
            some = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for k in range(0, len(some), TOGETHER):
                rows = some[k : k + TOGETHER]
                at = starts[rows][:, None] + np.arange(width)
                inside = np.arange(width) < sizes[rows][:, None]
                table = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], -1)
                done, left = merge_many(self.model, table, own[rows], self.rate)
                left &= inside
                rows_.append(rows)
                flats.append(done[left])
                counts_.append(left.sum(1))
        for i in np.flatnonzero(sizes > LONG).tolist():
            one = merge_long(self.model, symbols[starts[i] : ends[i]], own[i], self.rate)
            rows_.append([i])
            flats.append(np.array(one, np.int64))
            counts_.append([len(one)])
        rows, flat, counts = np.concatenate(rows_), np.concatenate(flats), np.concatenate(counts_).astype(np.int64)
        ids, spans = self._spell(flat)  # a symbol without a piece is some bytes
        upto = np.concatenate([[0], np.cumsum(spans)])
        to = np.cumsum(counts)
        begin, counts = upto[to - counts], upto[to] - upto[to - counts]
        order = np.argsort(rows)
        begin, counts = begin[order], counts[order]
        shift = begin - (np.cumsum(counts) - counts)
        return ids[np.repeat(shift, counts) + np.arange(len(ids))], counts

    def _spell(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, and how many each has."""
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.model.size))
        spans = np.ones(len(symbols), np.int64)
        kinds, which = np.unique(symbols[odd], return_inverse=True)
        lists = [self._bytes(int(k)) for k in kinds]
        sizes = np.array([len(x) for x in lists], np.int64)
        spans[odd] = sizes[which]
        out = np.repeat(symbols, spans)
        if len(odd):
            pool = np.array([i for x in lists for i in x], np.int64)
            at = (np.cumsum(spans) - spans)[odd]
            n = sizes[which]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(at, n) + inner] = pool[np.repeat((np.cumsum(sizes) - sizes)[which], n) + inner]
        return out.astype(np.uint32), spans

    def _bytes(self, symbol: int) -> list[int]:
        if symbol >= self.model.size:  # a character that only occurs inside pieces
            point = next(p for p, s in self.model.symbol_of_char.items() if s == symbol)
        else:
            point = -1 - symbol
        char = MARK if point == _OWN_MARK else chr(point)
        return self.model.byte_ids[list(char.encode())].tolist()

    def decode(self, ids: np.ndarray) -> str:
        """The text of which ``ids`` are an encoding."""
        if not len(ids):
            return ""
        counts = self.model.spell_count[ids]
        to = np.cumsum(counts)
        data = self.model.spelled[np.repeat(self.model.spell_begin[ids] - (to - counts), counts) + np.arange(to[-1])]
        return data[1:].tobytes().decode()


_encoders: dict[tuple, Encoder] = {}


def _encode(batches: Iterator[pa.RecordBatch], settings: tuple, with_ids: bool) -> Iterator[pa.RecordBatch]:
    if settings not in _encoders:
        _encoders[settings] = Encoder(*settings)
    encoder = _encoders[settings]
    for batch in batches:
        texts, docs = batch.column("text"), batch.column("doc_id")
        for a, b in blocks([len(t) for t in texts.to_pylist()]):
            mine = texts.slice(a, b - a).to_pylist()
            ids = encoder.encode(mine, batch.column("key").slice(a, b - a).to_pylist())
            decoded = [encoder.decode(x) for x in ids]
            columns = [
                docs.slice(a, b - a), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()), pa.array([x == y for x, y in zip(decoded, mine, strict=True)], pa.bool_()),
            ]
            names = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"]
            if with_ids:
                columns, names = [*columns, pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def encode(docs: DataFrame, model_path: str, *, seed: int = 0, rate: float = DROPOUT, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_crc32, decoded_sha256, lossless[, ids]), one per document."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.xxhash64(id_col), F.lit(0)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    settings = (model_path, seed, rate)
    return rows.mapInArrow(lambda it: trimmed(_encode(it, settings, with_ids)), f"doc_id {kind}, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean" + ", ids array<long>" * with_ids)
