"""Edit distance in Python, for rows that are walked one after another.  Lengths are code points."""

from __future__ import annotations

import numpy as np


def levenshtein(a: str, b: str) -> int:
    """Bit-parallel over a: a column of the table is two numbers of len(a) bits."""
    if not a or not b:
        return len(a) or len(b)
    where: dict[str, int] = {}
    for k, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << k
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, score = full, 0, len(a)
    for ch in b:
        same = where.get(ch, 0)
        across = (((same & more) + more) ^ more) | same | less
        up = less | ~(across | more) & full
        down = more & across
        score += bool(up & last) - bool(down & last)
        up = (up << 1 | 1) & full
        more = (down << 1 | ~(same | less | up)) & full
        less = up & (same | less)
    return score


def ratio(a: str, b: str) -> float:
    """Distance over the longer length; 0 if equal, 1 if either is empty."""
    if a == b:
        return 0.0
    return levenshtein(a, b) / max(len(a), len(b)) if a and b else 1.0


def similar(a: str, b: str, below: float) -> bool:
    """Whether ratio(a, b), as a 32-bit float, is below a bound; lengths far apart settle it without the distance."""
    if a == b:
        return 0 < below
    longer = max(len(a), len(b))
    if not a or not b or np.float32(abs(len(a) - len(b)) / longer) >= np.float32(below):
        return False
    return bool(np.float32(levenshtein(a, b) / longer) < np.float32(below))
