"""German Snowball stemmer, from the published algorithm, as a Python function of a word."""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS = "aeiouyäöü"
# Letters that may stand before a valid s ending and a valid st ending.
S_ENDING, ST_ENDING = "bdfghklmnrt", "bdfghklmnt"


def _regions(word: str) -> tuple[int, int]:
    """Starts of R1 (at least three letters in) and R2."""

    def after(start: int) -> int:
        m = re.search(f"[{VOWELS}][^{VOWELS}]", word[start:])
        return start + m.end() if m else len(word)

    r1 = after(0)
    r2 = after(r1)
    return max(r1, 3), r2


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    w = word.lower().replace("ß", "ss")
    # u and y between vowels are consonants: kept in upper case until the end
    w = re.sub(f"(?<=[{VOWELS}])([uy])(?=[{VOWELS}])", lambda m: m[1].upper(), w)
    r1, r2 = _regions(w)
    ending = re.search("(ern|em|er|en|es|e|s)$", w)
    if ending and ending.start() >= r1:
        e = ending[1]
        if e in ("em", "ern", "er"):
            w = w[: ending.start()]
        elif e in ("en", "es", "e"):
            w = w[: ending.start()]
            if w.endswith("niss"):
                w = w[:-1]
        elif ending.start() and w[ending.start() - 1] in S_ENDING:
            w = w[:-1]
    ending = re.search("(est|en|er|st)$", w)
    if ending and ending.start() >= r1:
        if ending[1] != "st":
            w = w[: ending.start()]
        elif ending.start() >= 4 and w[ending.start() - 1] in ST_ENDING:
            w = w[:-2]
    ending = re.search("(isch|lich|heit|keit|end|ung|ig|ik)$", w)
    if ending and ending.start() >= r2:
        e, at = ending[1], ending.start()
        if e in ("end", "ung"):
            w = w[:at]
            if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
                w = w[:-2]
        elif e in ("ig", "ik", "isch"):
            if not w[:at].endswith("e"):
                w = w[:at]
        elif e in ("lich", "heit"):
            w = w[:at]
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = w[:at]
            for tail in ("lich", "ig"):
                if w.endswith(tail) and len(w) - len(tail) >= r2:
                    w = w[: -len(tail)]
                    break
    return w.lower().translate(str.maketrans("äöü", "aou"))
