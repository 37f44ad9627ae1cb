"""Code-point arrays of whole Arrow batches: the vectorised base of the text operators."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: White_Space of the Unicode character database (fixed values).
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

OTHER, LETTER, NUMBER, SPACE, EDGE = 0, 1, 2, 3, 4


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """uint8 class of every code point: letter, number, white space or other; EDGE one past the last."""
    top = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((top.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE)] = SPACE
    return np.append(out, np.uint8(EDGE))


def join_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, each text followed by one edge mark; and where texts begin."""
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    codes[starts[1:] - 1] = 0x110000
    return codes, starts
