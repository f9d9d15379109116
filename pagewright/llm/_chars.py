"""Code point tables and vectorised views of texts as code points."""

from __future__ import annotations

import sys
from functools import cache

import numpy as np

_BMP = 0x10000

#: Unicode blocks of the scripts that language identification tells apart.
SCRIPT_RANGES = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul_jamo", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
SCRIPTS = ["other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES)]


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the code points below 0x10000: is it a letter, its lower case, the number of its script."""
    letter = np.zeros(_BMP, bool)
    lower = np.arange(_BMP, dtype=np.uint32)
    script = np.zeros(_BMP, np.uint8)
    for c in range(_BMP):
        ch = chr(c)
        if ch.isalpha():
            letter[c] = True
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    for name, a, b in SCRIPT_RANGES:
        script[a : b + 1] = SCRIPTS.index(name)
    return letter, lower, script


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a 0, and where each begins (one more than texts)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    coding = "utf-32-le" if sys.byteorder == "little" else "utf-32-be"
    flat = np.frombuffer(("\0".join(texts) + "\0").encode(coding, "surrogatepass"), np.uint32)
    return flat, at


def looked_up(table: np.ndarray, cps: np.ndarray, other) -> np.ndarray:
    """table[cps] with other for the code points beyond the table."""
    far = cps >= _BMP
    if far.any():
        return np.where(far, other, table[np.where(far, 0, cps)])
    return table[cps]
