"""Character classes by code point, for statistics over whole texts with numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

LETTER, UPPER, DIGIT, SPACE, SYMBOL, BANG, PIPE, STOP = (1 << i for i in range(8))
SYMBOLS = "#*$%&|<>"


def codes(text: str) -> np.ndarray:
    """The text's code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@cache
def class_table() -> np.ndarray:
    """Bits of the classes of each code point."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = LETTER | UPPER * c.isupper()
        elif c.isdecimal():
            table[cp] = DIGIT
        elif c.isspace():
            table[cp] = SPACE
    for mask, chars in ((SYMBOL, SYMBOLS), (BANG, "!"), (PIPE, "|"), (STOP, ".?:;")):
        for c in chars:
            table[ord(c)] |= mask
    return table
