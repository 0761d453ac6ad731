"""Pre-tokens of byte-level BPE: text cut into letters, numbers, other signs and white space, many documents at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE, SPECIAL = range(5)
_ENDINGS = {ord(c): 1 for c in "stmd"}


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of each code point."""
    table = np.zeros(0x110000, np.uint8)
    text = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "\0" for i in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            table[m.start() : m.end()] = kind
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the byte at which each starts, with the length as the last."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.append(first, len(data))


def special_starts(data: np.ndarray, at: np.ndarray, special: bytes) -> np.ndarray:
    """Bytes at which the special string starts inside one document."""
    raw, found, i = data.tobytes(), [], 0
    while special and (i := raw.find(special, i)) >= 0:
        document = int(np.searchsorted(at, i, side="right")) - 1
        inside = i + len(special) <= at[document + 1]
        if inside:
            found.append(i)
        i += len(special) if inside else 1
    return np.array(found, np.int64)


def split(data: np.ndarray, at: np.ndarray, special: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the pre-tokens of all documents (the last offset is the end) and a flag for each that is the special string."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(0, bool)
    points, first = code_points(data)
    n = len(points)
    kind = char_classes()[points]
    cut = np.zeros(n + 1, bool)  # where a document or a special string starts or ends
    char_of = np.searchsorted(first, at)
    cut[char_of] = True
    found = special_starts(data, at, special)
    if len(found):
        a, b = np.searchsorted(first, found), np.searchsorted(first, found + len(special))
        for i, j in zip(a, b, strict=True):
            kind[i:j] = SPECIAL
        cut[a] = cut[b] = True
    cut = cut[:n]
    new = cut.copy()
    new[0] = True
    new[1:] |= kind[1:] != kind[:-1]
    runs = new.copy()
    # The last of several white-space characters stands apart; a plain space joins what follows.
    i = np.flatnonzero(new[1:] & ~cut[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    new[i - 1] = True
    new[i[points[i - 1] == 0x20]] = False
    # Endings such as 's after one apostrophe that joins no space.
    p = np.flatnonzero((points[:-1] == 0x27) & runs[:-1] & (kind[1:] == LETTER) & ~cut[1:])
    p = p[(p == 0) | cut[p] | (points[p - 1] != 0x20)]
    if len(p):
        letter = np.append(kind == LETTER, [False, False, False]) & ~np.append(cut, [True, True, True])
        wide = np.append(points, [0, 0, 0])
        one, two = wide[p + 1], np.where(letter[p + 2], wide[p + 2], 0)
        size = np.where(np.isin(one, list(_ENDINGS)), 1, 0)
        for pair in ("re", "ve", "ll"):
            size[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
        p, size = p[size > 0], size[size > 0]
        new[p + 1] = False
        rest = p + 1 + size
        new[rest[letter[rest]]] = True
    starts = np.flatnonzero(new)
    return np.append(first[starts], len(data)), kind[starts] == SPECIAL
