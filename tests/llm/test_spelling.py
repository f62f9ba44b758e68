import random
import re
import zlib
from collections import Counter

import pytest
from llm_helpers import awkward_texts, frame, same

from shelfwise.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(S.UPPER, S.LOWER)


def near(a, b):
    """One inserted, deleted or replaced code point, by trying all of them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def variants(rows, chars=6, least=5, ratio=5, every=199):
    """Operator 12 by comparing all words with all."""
    n = Counter()
    for d, t in rows:
        for w in RUN.findall(t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if every and h % every == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= chars and c >= least}
    near_to = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, found in near_to.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return [(w, form.get(w), root(w), c, len(near_to[w]), n[form[w]] if w in form else None) for w, c in n.items()]


def misspelt(seed=3, size=160, words=40):
    """Documents of a few words in many spellings, some of them frequent."""
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(words)] + ["zzzzzz", "zzzzzzz", "aaaaaaaaaaaaaa"]

    def spelt(w):
        at, kind = rng.randrange(len(w)), rng.random()
        if kind < 0.7:
            return w.upper() if kind < 0.1 and w.isascii() else w
        if kind < 0.8:
            return w[:at] + w[at + 1:]
        return w[:at] + rng.choice("abx") + w[at + (kind < 0.9):]

    return [(k if k % 9 else None, " ".join(spelt(rng.choice(stock)) for _ in range(rng.randint(0, 60)))) for k in range(size)]


@pytest.mark.parametrize("tile,least,ratio,every", [(1024, 2, 5, 7), (8, 1, 2, 3), (1, 3, 2, 0)])
def test_groups_match_brute_force(spark, tile, least, ratio, every):
    rows = misspelt(size=160 if tile > 1 else 40) + [(5, t) for t in awkward_texts()]
    rows += rows[:3]
    got = S.variant_groups(frame(spark, [t for _, t in rows], [d for d, _ in rows]), least_count=least, ratio=ratio, drop_every=every, tile=tile)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    same(got.collect(), variants(rows, least=least, ratio=ratio, every=every))


def test_roots_many_steps_away(spark):
    chain = ["bcdefghij"[:k] + "aaaaaaaaa"[k:] for k in range(10)]           # each one code point from the next
    rows = [(k, " ".join(w for j, w in enumerate(chain) for _ in range(2 ** (9 - j)))) for k in range(3)]
    got = S.variant_groups(frame(spark, [t for _, t in rows], [d for d, _ in rows]), least_count=1, ratio=2, drop_every=0).collect()
    same(got, variants(rows, least=1, ratio=2, every=0))
    assert {r.root for r in got} == {chain[0]} and {r.word: r.form for r in got}[chain[9]] == chain[8]


def test_contract_parameters(spark):
    rows = misspelt(seed=8, size=300, words=15)
    same(S.variant_groups(frame(spark, [t for _, t in rows], [d for d, _ in rows])).collect(), variants(rows))


def test_near_pairs_of_all_short_words():
    words = ["".join(x) for k in (2, 3, 4) for x in __import__("itertools").product("ab", repeat=k)]
    for longer in (3, 4, 5):
        found = Counter()
        for side in ("prefix", "suffix"):
            for i, j in S.near_pairs(words, words, longer, side) if max(map(len, words)) <= longer else ():
                found.update(zip(i.tolist(), j.tolist()))
        if found:
            want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b) and max(len(a), len(b)) == longer}
            assert set(found) == want and set(found.values()) == {1}


def test_very_long_words_and_ties(spark):
    long = "b" * 5000
    text = " ".join([long, long[1:], "colour", "colours", "colonr", "colourx"])
    rows = [(k, text + " colour" * 30 + " colours" * 30) for k in range(6)]
    got = S.variant_groups(frame(spark, [t for _, t in rows], [d for d, _ in rows]), drop_every=0).collect()
    same(got, variants(rows, every=0))
    assert {r.word: r.form for r in got}["colourx"] == "colour"           # as frequent as colours, and before it


def test_empty_and_blank_tables(spark):
    assert S.variant_groups(frame(spark, [])).collect() == []
    assert S.variant_groups(frame(spark, [None, "", "short words only"] * 9)).collect() == []
