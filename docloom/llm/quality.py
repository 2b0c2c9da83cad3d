"""Quality rules: base rules and bands of n-gram perplexity.

Spark counts the character trigrams of all documents, per language. A character is its code point (blanks
are one symbol, digits are one), so texts of every script are told apart, and how many trigrams there are
is up to the corpus: nothing bounds them. The modified Kneser-Ney probabilities (three discounts an order,
continuation counts below the highest, interpolation) are joins and sums over the tables of the orders.
Each occurrence is scored under
the model without it, as a text would else vouch for itself: its count, and where that was the only one
the n-gram and its place in the counts below, are taken off. As every n-gram of a document was counted,
the highest order's probabilities are all that scoring looks up.

The model is scored in slices: sorted arrays of n-gram hashes with their log probabilities, of at most
about ``SLICE`` entries whatever the corpus holds. Each slice is sent to all tasks and gives every document's sum
over the n-grams that it holds; these sums are added up. A corpus whose model fits in a slice is read once.

Each language's band lies ``SPREADS`` interquartile distances of log perplexity around the quartiles;
documents outside are rejected, as are those that fail a base rule.

Defined results: null text has no words and fails the base rules; a null language is a language of
its own; a document without a character has no perplexity and is left to the base rules; the
quartiles are Spark's approximate percentiles over all documents; a language with no spread rejects
none of the documents at its quartile; very long texts are taken in stretches; repeated rows count each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, trimmed, with_locator, work_dir
from ._text import mix, prefix_hash, span_hash, window_hashes, word_spans

#: Symbols of an n-gram, and bits of a symbol.
ORDER, BITS = 3, 21
#: Interquartile distances beyond the quartiles at which the band of log perplexity ends: below, above.
#: Set on labelled documents (README): junk lies above; what lies below is mostly repetition, a matter of the base rules.
SPREADS = (3.0, 2.5)
#: Fixed values of the base rules: least words, greatest percentage of repeated words.
LEAST_WORDS, MOST_REPEATED = 20, 30
SYMBOLS = "#*$%&|<>"
#: Entries of a slice of the model (12 bytes each), about.
SLICE = 1 << 21
#: Characters that are worked on at a time, and n-grams that a task holds before it hands them on.
STRETCH, HELD = 1 << 19, 1 << 21
#: Languages up to which the table of bands is broadcast.
MOST_LANGUAGES = 1 << 16

_KNOWN = 1 << 12


def _symbol(point: int) -> int:
    c = chr(point)
    return 0 if c.isspace() or unicodedata.category(c) == "Cc" else 1 if c.isdigit() else point


_SYMBOLS = np.array([_symbol(p) for p in range(_KNOWN)], np.uint64)


def symbols(text: str) -> np.ndarray:
    """Code points, 0 for blanks and 1 for digits."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points) or points.max() < _KNOWN:
        return _SYMBOLS[points]
    out = _SYMBOLS[np.minimum(points, _KNOWN - 1)]
    far = np.flatnonzero(points >= _KNOWN)
    wide, which = np.unique(points[far], return_inverse=True)
    out[far] = np.array([_symbol(p) for p in wide.tolist()], np.uint64)[which]
    return out


def stretches(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All n-grams of the texts, one a character (a text is preceded by blanks): their codes, the texts' indices."""
    held: list[tuple[int, str, int]] = []
    size = 0

    def codes():
        found = symbols("".join(s for _, s, _ in held))
        code = np.zeros(len(found) - ORDER + 1, np.uint64)
        for k in range(ORDER):
            code = code << np.uint64(BITS) | found[k : k + len(code)]
        counts = np.array([n for _, _, n in held])
        begin = np.cumsum(counts + ORDER - 1) - counts - ORDER + 1  # where a piece's first n-gram begins
        place = np.arange(int(counts.sum())) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
        return code[place].view(np.int64), np.repeat([i for i, _, _ in held], counts)

    for i, text in enumerate(texts):
        for at in range(0, len(text), STRETCH):
            body = text[at : at + STRETCH]
            held.append((i, (text[at - ORDER + 1 : at] if at else " " * (ORDER - 1)) + body, len(body)))
            size += len(body)
            if size >= STRETCH:
                yield codes()
                held, size = [], 0
    if held:
        yield codes()


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """(language key, row numbers, texts) of a batch."""
    langs = batch.column("lang_key").to_numpy()
    texts = batch.column("text")
    for lang in np.unique(langs).tolist():
        rows = np.flatnonzero(langs == lang)
        yield lang, rows, [x or "" for x in texts.take(pa.array(rows)).to_pylist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts):
        if len(parts) == 1:
            return parts[0]
        codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[first], np.add.reduceat(counts, first)

    def hand_on():
        for lang, parts in held.items():
            codes, counts = merged(parts)
            for k in range(0, len(codes), 200_000):
                some = codes[k : k + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), lang, np.int64)), pa.array(some), pa.array(counts[k : k + 200_000])], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, _, texts in _by_language(batch):
            for codes, _ in stretches(texts):
                part = np.unique(codes, return_counts=True)
                held.setdefault(lang, []).append(part)
                size += len(part[0])
            if size > HELD:
                for k, parts in held.items():
                    held[k] = [merged(parts)]
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD // 2:
                    yield from hand_on()
                    size = 0
    yield from hand_on()


def _discounts() -> list[Column]:
    """D1, D2, D3+ from the counts of counts n1 to n4; a plain 0.5, 1, 1.5 where one of these is missing."""
    n1, n2, n3, n4 = (F.col(f"n{k}") for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    whole = (n1 > 0) & (n2 > 0) & (n3 > 0) & (n4 > 0)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [F.when(whole, F.greatest(F.lit(0.05 * k), F.least(F.lit(0.95 * k), d))).otherwise(F.lit(0.5 * k)).alias(f"d{k}") for k, d in enumerate(found, 1)]


def kneser_ney(counts: DataFrame, home: str) -> DataFrame:
    """(lang, gram, log_p) of the n-grams counted, (lang, gram, n): the probability of an occurrence under all others."""
    below, by_order = None, {ORDER: cut(counts, f"{home}/order{ORDER}")}
    suffix = lambda order: F.col("gram").bitwiseAND(F.lit((1 << BITS * order) - 1))
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before the n-gram
        above = by_order[order + 1].select("lang", suffix(order).alias("gram"))
        by_order[order] = cut(above.groupBy("lang", "gram").agg(F.count("*").alias("n")), f"{home}/order{order}")
    for order in range(1, ORDER + 1):
        rows = by_order[order]
        each = rows.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)], F.count("*").alias("kinds"))
        rows = rows.join(each.select("lang", "kinds", *_discounts()), "lang")
        rows = rows.withColumn("off", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))).withColumn("context", F.shiftright("gram", BITS))
        context = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("off").alias("left"))
        rows = rows.join(context, ["lang", "context"])
        if below is None:
            rows = rows.withColumns({"lower_p": 1 / F.col("kinds"), "lower_q": 1 / F.col("kinds")})
        else:
            rows = rows.withColumn("suffix", suffix(order - 1)).join(below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower_p"), F.col("q").alias("lower_q")), ["lang", "suffix"])
        # p: as counted; q: with one occurrence less, which may take the n-gram itself, and so on below
        n, off, total, left = (F.col(c) for c in ("n", "off", "total", "left"))
        less = F.when(n == 2, F.col("d1")).when(n == 3, F.col("d2")).otherwise(F.col("d3"))
        gone = F.when(total > 1, (left - off) * F.col("lower_q") / F.greatest(total - 1, F.lit(1))).otherwise(F.col("lower_q"))
        p = (n - off + left * F.col("lower_p")) / total
        q = F.when(n > 1, (n - 1 - less + (left - off + less) * F.col("lower_p")) / (total - 1)).otherwise(gone)
        below = cut(rows.select("lang", "gram", p.alias("p"), q.alias("q")), f"{home}/p{order}")
    return below.select("lang", "gram", F.log("q").alias("log_p"))


def _key(lang, grams: np.ndarray) -> np.ndarray:
    return mix(grams.view(np.uint64) + np.atleast_1d(np.asarray(lang, np.int64)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Slice:
    """Sorted hashes of n-grams with their log probabilities, and where each beginning of a hash starts."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.append(keys[order], np.uint64(2**64 - 1)), np.append(values[order], np.float32(0))
        self.first = np.searchsorted(self.keys[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def look(self, keys: np.ndarray) -> np.ndarray:
        """Log probabilities; 0 where the slice does not hold the n-gram."""
        at = self.first[(keys >> self.shift).astype(np.int64)]
        rest = np.flatnonzero(self.keys[at] < keys)
        while len(rest):
            at[rest] += 1
            rest = rest[self.keys[at[rest]] < keys[rest]]
        return np.where(self.keys[at] == keys, self.values[at], np.float32(0))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = _key(batch.column("lang").to_numpy(), batch.column("gram").to_numpy())
        values = batch.column("log_p").to_numpy().astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["keys", "values"])


def model_slices(model: DataFrame) -> Iterator[Slice]:
    """The model in slices of about ``SLICE`` entries, by hash."""
    n = max(1, -(-model.count() // SLICE))
    for k in range(n):
        rows = model.filter(F.pmod(F.xxhash64("lang", "gram"), F.lit(n)) == k).mapInArrow(_packed, "keys binary, values binary").collect()
        parts = [np.concatenate([np.frombuffer(r[c], kind) for r in rows] or [np.zeros(0, kind)]) for c, kind in (("keys", np.uint64), ("values", np.float32))]
        yield Slice(*parts)


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The model of all languages, (lang, gram, log_p), from all documents; ``lang`` is the language's key."""
    home = work_dir(docs.sparkSession, "ngrams")
    rows = docs.select(F.col(text_col).alias("text"), _lang_key(lang_col).alias("lang_key")).filter("text IS NOT NULL")
    counts = rows.mapInArrow(lambda it: trimmed(_count(it)), "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return kneser_ney(counts, home)


def _lang_key(lang_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(lang_col).cast("string"), F.lit("")))


def repeated_words(words: np.ndarray, width: int = 8) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    windows = window_hashes(words, width)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + width, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


_SOLID = np.ones(256, bool)
_SOLID[[0x20, 9, 10, 11, 12, 13]] = False
_SOLID[0x80:0xC0] = False  # later bytes of a character
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_STRIP = " \t\n\x0b\x0c\r"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = word_spans(data)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(_STRIP):
            if line in seen:
                dup += 1
            seen.add(line)
    words = span_hash(prefix_hash(data), starts, ends)
    return len(starts), int(np.count_nonzero(_SOLID[data])), int(np.count_nonzero(_SYMBOL[data])), dup, repeated_words(words)


def _sums(batch: pa.RecordBatch, slice_: Slice) -> np.ndarray:
    """Per row, the sum of the log probabilities of its n-grams that the slice holds."""
    out = np.zeros(batch.num_rows)
    for lang, rows, texts in _by_language(batch):
        for codes, owner in stretches(texts):
            found = slice_.look(_key(np.int64(lang), codes))
            out[rows] += np.bincount(owner, found, minlength=len(rows))
    return out


def _score(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or "" for x in batch.column("text").to_pylist()]
        counts = zip(*[base_counts(t) for t in texts], strict=True) if texts else [()] * 5
        columns = [batch.column("at"), batch.column("doc_id"), batch.column("lang"), *(pa.array(c, pa.int64()) for c in counts), pa.array([len(t) for t in texts], pa.int64()), pa.array(_sums(batch, sent.value))]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "doc_id", "lang", *COUNTS, "n_chars", "sum"])


def _add(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(_sums(batch, sent.value))], names=["at", "sum"])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts, perplexity and verdict, one row per document."""
    spark = docs.sparkSession
    home = work_dir(spark, "quality")
    model = train(docs, text_col=text_col, lang_col=lang_col)
    kind = docs.schema[id_col].dataType.simpleString()
    columns = [F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), _lang_key(lang_col).alias("lang_key"), F.col(text_col).alias("text")]
    rows, scored = docs.select(F.lit("").alias("at"), *columns), None
    slices = model_slices(model)
    if model.count() > SLICE:  # sums of several passes meet by the rows' places
        rows = with_locator(docs, f"{home}/docs", "__docloom_at").select(F.col("__docloom_at").alias("at"), *columns)
    more = []
    for k, part in enumerate(slices):
        sent = spark.sparkContext.broadcast(part)
        if scored is None:
            made = rows.mapInArrow(lambda it, sent=sent: trimmed(_score(it, sent)), f"at string, doc_id {kind}, lang string, {', '.join(f'{c} long' for c in COUNTS)}, n_chars long, sum double")
            scored = cut(made, f"{home}/scored")
        else:
            more.append(cut(rows.select("at", "lang_key", "text").mapInArrow(lambda it, sent=sent: trimmed(_add(it, sent)), "at string, sum double"), f"{home}/sums{k}"))
        sent.destroy()
    if more:
        for other in more[1:]:
            more[0] = more[0].unionByName(other)
        scored = scored.join(more[0].groupBy("at").agg(F.sum("sum").alias("others")), "at").withColumn("sum", F.col("sum") + F.col("others"))
    scored = scored.withColumn("log_perplexity", F.when(F.col("n_chars") > 0, -F.col("sum") / F.col("n_chars")))
    quartile = scored.groupBy("lang").agg(F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000).alias("q"))
    wide = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(0.01))
    bands = quartile.select("lang", (F.col("q")[0] - SPREADS[0] * wide).alias("lower"), (F.col("q")[1] + SPREADS[1] * wide).alias("upper"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(True))
    bands = cut(bands, f"{home}/bands")
    if bands.count() <= MOST_LANGUAGES:
        bands = F.broadcast(bands)
    return scored.join(bands, "lang", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & inside).alias("kept"), F.exp("log_perplexity").alias("perplexity"), F.exp("lower").alias("least_perplexity"), F.exp("upper").alias("most_perplexity"),
    )
