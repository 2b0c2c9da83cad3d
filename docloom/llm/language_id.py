"""Language identification as a multilingual mixture.

Training counts character trigrams per language over all training documents. Letters and marks of
every script are told apart by code point, in lower case; blanks, digits, sentence marks and symbols
are a class each. Trigrams are hashed into ``SIZE`` buckets, so a model has that many figures a
language, whatever the scripts; trigrams that share a bucket share its figure. A document is a sequence of words; each
word's trigrams give it a likelihood under every language. Expectation-maximisation estimates the
proportions in which the languages generate the words; languages whose removal raises the likelihood
less a penalty per language are taken out, smallest share first, and the proportions re-estimated.

Defined results: null text, or text without a letter, is ``und`` with score 0; documents with null
language are not learned from; a null id counts as the empty id; a tie between languages goes to the
first in sorted order; repeated rows count each; an empty table, or one without a language, learns
nothing and predicts ``und``; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, trimmed
from ._grams import classes
from ._text import mix

ORDER = 3
#: Buckets of hashed trigrams.
SIZE = 1 << 17
SMOOTHING = 0.5
#: EM rounds and the change of a share at which it ends.
ROUNDS, SETTLED = 30, 1e-3
#: Words that a language's share must explain, per logarithm of the text's words, to be in the set.
PENALTY = 2.0
UND = "und"
#: Characters whose figures under all languages are held at a time.
BLOCK_CHARS = 1 << 16
#: Counters that a task holds at once; beyond, they are handed on and begun anew.
HELD_LANGUAGES = 64


_MARKS: dict[int, bool] = {}


def _is_mark(point: int) -> bool:
    if point not in _MARKS:
        _MARKS[point] = unicodedata.category(chr(point))[0] == "M"
    return _MARKS[point]


def symbols(text: str) -> np.ndarray:
    """Per character of the text in lower case: the class of ``_grams`` up to 3, or the code point of a letter or mark."""
    text = text.lower()
    kinds = classes(text, fold=True)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(kinds >= 4, points, kinds)
    far = np.flatnonzero((points >= 0x300) & (kinds == 3))
    if len(far):
        wide, which = np.unique(points[far], return_inverse=True)
        out[far] = np.where(np.array([_is_mark(p) for p in wide.tolist()])[which], points[far], 3)
    return out


def trigrams(symbols: np.ndarray) -> np.ndarray:
    """Buckets of all runs of three symbols, the text being preceded by blanks; one per character."""
    padded = np.concatenate([np.zeros(ORDER - 1, np.uint64), symbols.astype(np.uint64)])
    n = len(symbols)
    code = padded[:n] << np.uint64(42) | padded[1 : n + 1] << np.uint64(21) | padded[2:]
    return (mix(code) & np.uint64(SIZE - 1)).astype(np.int32)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def hand_on():
        for lang, counts in held.items():
            codes = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int32)), pa.array(counts[codes])], names=["lang", "code", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            lang, codes = lang.as_py(), trigrams(symbols(text.as_py()))
            if lang not in held:
                if len(held) >= HELD_LANGUAGES:
                    yield from hand_on()
                held[lang] = np.zeros(SIZE, np.int64)
            if len(codes) > SIZE // 8:
                held[lang] += np.bincount(codes, minlength=SIZE)
            else:
                np.add.at(held[lang], codes, 1)
    yield from hand_on()


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log probabilities of trigrams (a row each), from all rows with text and language."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    counts = rows.mapInArrow(lambda it: trimmed(_count(it)), "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((SIZE, len(langs)), SMOOTHING)
    table[counts["code"].to_numpy(), np.searchsorted(langs, counts["lang"].to_numpy())] += counts["n"].to_numpy()
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def _shares(like: np.ndarray) -> np.ndarray:
    share = np.full(like.shape[1], 1 / like.shape[1])
    for _ in range(ROUNDS):
        part = like * share
        part /= part.sum(1, keepdims=True)
        new = part.mean(0)
        if np.abs(new - share).max() < SETTLED:
            return new
        share = new
    return share


def mixture(words: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """All languages' shares, and the indices of the chosen ones by falling share.

    ``words``: log likelihood of each word (row) under each language (column).
    """
    top = words.max(1, keepdims=True)
    like = np.exp(np.maximum(words - top, -60.0))
    share = _shares(like)
    chosen = [int(k) for k in np.argsort(-share, kind="stable") if share[k] > SETTLED]
    cost = PENALTY * np.log(len(words) + 1)
    own, gain = share[chosen], lambda ks, s: np.log(np.maximum(like[:, ks] @ s, 1e-300)).sum()
    best = gain(chosen, own / own.sum()) - cost * len(chosen)
    while len(chosen) > 1:
        fewer = chosen[:-1]
        own = _shares(like[:, fewer])
        if (now := gain(fewer, own) - cost * len(fewer)) < best:
            break
        chosen, best = [fewer[k] for k in np.argsort(-own, kind="stable")], now
    return share, chosen


def word_likelihoods(text: str, table: np.ndarray) -> np.ndarray:
    """Log likelihoods of the words that have a letter; no row if there is none."""
    kinds = symbols(text)
    solid = kinds > 0
    starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]])) if len(kinds) else np.zeros(0, int)
    if not len(starts):
        return np.zeros((0, table.shape[1]))
    lettered = np.add.reduceat((kinds >= 4).astype(np.int32), starts) > 0
    codes = trigrams(kinds)
    sums, at = np.empty((len(starts), table.shape[1]), np.float32), 0
    while at < len(starts):  # whole words of about BLOCK_CHARS characters at a time
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK_CHARS)))
        end = starts[to] if to < len(starts) else len(codes)
        sums[at:to] = np.add.reduceat(table[codes[starts[at] : end]], starts[at:to] - starts[at], axis=0, dtype=np.float32)
        at = to
    return sums[lettered].astype(np.float64)


def _predict(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    langs, table = model.value
    for batch in batches:
        preds, scores, sets = [], [], []
        for text in batch.column("text"):
            words = word_likelihoods(text.as_py() or "", table) if langs else ()
            if not len(words):
                preds.append(UND)
                scores.append(0.0)
                sets.append([])
                continue
            share, chosen = mixture(words)
            preds.append(langs[chosen[0]])
            scores.append(min(1.0, max(0.0, float(share[chosen[0]]))))
            sets.append([langs[k] for k in chosen])
        keep = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string()))], names=[*names, "lang_pred", "score", "lang_set"])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, lang_set), one per document; only the text decides."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: trimmed(_predict(it, sent)), f"doc_id {kind}, held_out boolean, lang_pred string, score double, lang_set array<string>")


#: A document whose first language has a smaller share than this is rejected by ``keep_identified``.
LEAST_SHARE = 0.4


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or whose first language has too small a share."""
    langs, table = train(docs.filter(~held_out(id_col)), text_col=text_col, lang_col=lang_col)
    sent = docs.sparkSession.sparkContext.broadcast((langs, table))

    def keep(batches):
        for batch in batches:
            stays = []
            for text in batch.column(text_col):
                words = word_likelihoods(text.as_py() or "", sent.value[1]) if sent.value[0] else ()
                stays.append(False)
                if len(words):
                    share, chosen = mixture(words)
                    stays[-1] = bool(share[chosen[0]] >= LEAST_SHARE)
            yield batch.filter(pa.array(stays, pa.bool_()))
            del batch

    return docs.mapInArrow(lambda it: trimmed(keep(it)), docs.schema)
