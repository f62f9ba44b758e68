"""Porter stemming.

The algorithm is M. F. Porter, "An algorithm for suffix stripping" (1980),
with the common extensions of the widely used English stemmer: words of one
or two letters are kept, a few irregular forms are fixed, ``-ies``/``-ied``
on four-letter words keep ``ie``, ``y -> i`` only after a non-initial
consonant, and the extra step-2 rules ``fulli``, ``lessli`` and ``logi``.

Spark side: ``stem_tokens`` is an Arrow-batched pandas UDF over token
arrays. Per batch it stems each *distinct* token once and maps the rest, so
the Python work grows with the vocabulary of the batch, not with its length.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Irregular forms returned as they are listed.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
VOWELS = "aeiou"


def _cons(w: str, i: int) -> bool:
    ch = w[i]
    if ch in VOWELS:
        return False
    if ch == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    """m in [C](VC)^m[V]."""
    m, prev_vowel = 0, False
    for i in range(len(stem)):
        c = _cons(stem, i)
        if c and prev_vowel:
            m += 1
        prev_vowel = not c
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) >= 3:
        return (_cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1)
                and w[-1] not in "wxy")
    return len(w) == 2 and not _cons(w, 0) and _cons(w, 1)


def _rules(word: str, rules) -> str:
    """Longest listed suffix decides; when its condition fails the word is kept."""
    for suffix, repl, cond in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + repl if cond is None or cond(stem) else word
    return word


def _m_gt(n):
    return lambda stem: _measure(stem) > n


def _step1a(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-3] + "ie"
    return _rules(w, [("sses", "ss", None), ("ies", "i", None), ("ss", "ss", None), ("s", "", None)])


def _step1b(w: str) -> str:
    if w.endswith("ied"):
        return w[:-3] + ("ie" if len(w) == 4 else "i")
    if w.endswith("eed"):
        stem = w[:-3]
        return stem + "ee" if _measure(stem) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
            stem = w[: -len(suffix)]
            break
    else:
        return w
    for suffix, repl in (("at", "ate"), ("bl", "ble"), ("iz", "ize")):
        if stem.endswith(suffix):
            return stem[: -len(suffix)] + repl
    if _double_cons(stem):
        return stem[:-1] if stem[-1] not in "lsz" else stem
    if _measure(stem) == 1 and _cvc(stem):
        return stem + "e"
    return stem


def _step1c(w: str) -> str:
    if w.endswith("y") and len(w) > 2 and _cons(w, len(w) - 2):
        return w[:-1] + "i"
    return w


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
          ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
          ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
          ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
          ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful")]


def _step2(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _step2(w[:-4] + "al")
    if w.endswith("logi") and _measure(w[:-3]) > 0:
        return w[:-1]
    return _rules(w, [(s, r, _m_gt(0)) for s, r in _STEP2])


_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
          ("ful", ""), ("ness", "")]

_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
          "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _step4(w: str) -> str:
    rules = []
    for s in _STEP4:
        if s == "ion":
            rules.append((s, "", lambda stem: _measure(stem) > 1 and stem[-1:] in ("s", "t")))
        else:
            rules.append((s, "", _m_gt(1)))
    return _rules(w, rules)


def _step5(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem)):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    w = _step1a(w)
    w = _step1b(w)
    w = _step1c(w)
    w = _step2(w)
    w = _rules(w, [(s, r, _m_gt(0)) for s, r in _STEP3])
    w = _step4(w)
    return _step5(w)


#: Stems that a Python worker remembers before it begins anew.
REMEMBERED = 1_000_000


class _Stems(dict):
    def __missing__(self, word: str) -> str:
        s = self[word] = stem(word)
        return s


_STEMS = _Stems()


def stems(words: list[str]) -> list[str]:
    """The stem of each word; a worker stems a word once as long as it remembers it."""
    if len(_STEMS) > REMEMBERED:
        _STEMS.clear()
    return list(map(_STEMS.__getitem__, words))


def stem_batch(arrays: pd.Series) -> pd.Series:
    """Stem every token of a batch of token arrays."""
    return pd.Series([None if a is None else stems(list(a)) for a in arrays], index=arrays.index, dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_tokens(arrays: pd.Series) -> pd.Series:
    """X3 on token arrays, Arrow-batched."""
    return stem_batch(arrays)


@F.pandas_udf(T.StringType())
def stem_text(texts: pd.Series) -> pd.Series:
    """X3 + X4 on tokens joined by single blanks: one string a row goes through Arrow instead of a list."""
    return pd.Series([t if not t else " ".join(stems(t.split(" "))) for t in texts], index=texts.index, dtype=object)
