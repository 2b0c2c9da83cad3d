"""Character classes: what language ID makes of blanks, digits, sentence marks and symbols."""

from __future__ import annotations

import unicodedata

import numpy as np

#: Classes: 0 space, 1 digit, 2 sentence mark, 3 symbol, 4 other letter, 5 capital, 6-31 a-z, 32-41 accented.
_GROUPS = ("é", "è", "êë", "àâäáãåæ", "çñ", "öôóòõøœ", "üûúù", "íîïìÿý", "ß", "ðþ")
_TABLE = np.full(0x250, 3, np.uint8)


def _fill() -> None:
    for point in range(0x250):
        c = chr(point)
        if c.isspace() or unicodedata.category(c) == "Cc":
            _TABLE[point] = 0
        elif c.isalpha():
            _TABLE[point] = 4
        elif c.isnumeric():
            _TABLE[point] = 1
        elif c in ".,;:!?'\"-()":
            _TABLE[point] = 2
    for k, group in enumerate(_GROUPS):
        for c in group:
            _TABLE[[ord(c), *([ord(c.upper())] if len(c.upper()) == 1 and ord(c.upper()) < 0x250 else [])]] = 32 + k
    for k in range(26):
        _TABLE[97 + k] = 6 + k


_fill()
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_TABLE[65:91] = 5


def classes(text: str, fold: bool) -> np.ndarray:
    """Class per character; capitals as their letter if ``fold``, else as one class."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _FOLDED if fold else _TABLE
    if len(points) == 0 or points.max() < 0x250:
        return table[points]
    out = table[np.minimum(points, 0x24F)]
    far = np.flatnonzero(points >= 0x250)
    wide, which = np.unique(points[far], return_inverse=True)
    kinds = np.array([0 if chr(p).isspace() else 4 if chr(p).isalpha() else 1 if chr(p).isnumeric() else 3 for p in wide.tolist()], np.uint8)
    out[far] = kinds[which]
    return out
