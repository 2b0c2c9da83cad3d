"""Byte-level BPE ids of whole blocks of texts, equal to those of the tokenizer file.

Texts are cut into the vocabulary's pre-tokens with array operations on code points; a pre-token's
ids come from a table of those seen before (sorted hashes), and each new pre-token is encoded once by
the tokenizer itself. Texts that the array rules do not cover (a special token's string, an
apostrophe before one of its contraction letters) go to the tokenizer whole.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from ._table import IdTable
from ._text import mix, powers

#: Pre-tokens a worker remembers; beyond, it forgets all and starts anew.
REMEMBERED = 1_500_000
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
#: Fixed set: white space of the pre-token pattern.
_SPACES = (9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _kind(point: int) -> int:
    if point in _SPACES:
        return _SPACE
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(point))[0], _OTHER)


#: Code points of the table; a text with others goes to the tokenizer, whose Unicode version may differ.
_TABLE = np.array([_kind(p) for p in range(0x3000)], np.uint8)
_CONTRACTION = re.compile("'(?=[strvmld])")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else 256 and on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class BlockEncoder:
    """Encodes blocks of texts; one per worker process."""

    def __init__(self, path: str):
        from tiktoken._tiktoken import CoreBPE
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # merges by rank of a single pre-token: the file's ids are its ranks
        byte = {c: b for b, c in _byte_letters().items()}
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        ranks = {bytes(byte[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in special}
        self.merger = CoreBPE(ranks, {}, r"\S+|\s+")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = IdTable(REMEMBERED)

    def _plain(self, text: str) -> bool:
        if "'" in text and _CONTRACTION.search(text) or any(s in text for s in self.specials):
            return False
        return text.isascii() or int(np.frombuffer(text.encode("utf-32-le"), np.uint32).max()) < len(_TABLE)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        fast = [i for i, t in enumerate(texts) if t and self._plain(t)]
        plain = set(fast)
        slow = [i for i, t in enumerate(texts) if i not in plain]
        for i, e in zip(slow, self.tokenizer.encode_batch([texts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        if fast:
            for i, ids in zip(fast, self._fast([texts[i] for i in fast]), strict=True):
                out[i] = ids
        return out

    def _fast(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        edges = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=edges[1:])
        kind = _TABLE[points]
        first = np.zeros(len(points) + 1, bool)  # where a text begins
        first[edges] = True
        new = first[:-1].copy()
        new[1:] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        # of a run of white space before something else, the last begins a pre-token: with what follows
        # it if it is a blank, alone otherwise
        last = space.copy()
        last[:-1] &= ~space[1:] & ~first[1:-1]
        last[-1] = False
        new |= last
        joins = np.flatnonzero(last & (points == 0x20)) + 1
        new[joins] = False
        starts = np.flatnonzero(new)
        prefix = np.zeros(len(points) + 1, np.uint64)
        up, down = powers(len(points))
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=prefix[1:])
        ends = np.append(starts[1:], len(points))
        keys = mix((prefix[ends] - prefix[starts]) * down[starts])
        unique, at, which = np.unique(keys, return_index=True, return_inverse=True)
        fresh = self.table.missing(unique)
        if len(fresh):
            one = self.merger.encode_single_piece
            lists = [one(joined[a:b].encode()) for a, b in zip(starts[at[fresh]].tolist(), ends[at[fresh]].tolist(), strict=True)]
            self.table.learn(unique[fresh], np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64))
        ids, to = self.table.spell(unique, which)
        cut = to[np.searchsorted(starts, edges)]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
