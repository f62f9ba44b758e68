"""Small tables with every awkward case, and brute force for the operators."""

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Columns that operators use inside; a table may have them as well.
CLASHING = ("key", "bucket", "shard", "blob", "fp", "node", "n", "gram", "kept", "spans", "doc", "tag", "part", "value", "__key", "rule")


def syllables(rng, n, alphabet=("ka", "to", "mi", "re", "su", "no", "ha", "li", "the", "of", "é", "ß")):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward_texts(seed=1):
    """Null, empty, blank, one word, repeats, passages shared by many, copies, a long one."""
    rng = random.Random(seed)
    passage = syllables(rng, 60)
    line = syllables(rng, 12)
    long = syllables(rng, 4000) + " " + passage + " " + syllables(rng, 50)
    base = syllables(rng, 120)
    near = base.split()
    near[50] = "changed"
    out = [None, "", " \n\t ", "word", "a" * 400, "For " * 300, long, base, base, " ".join(near), base + " tail",
           passage, line, "🙂 emoji\n\nand\x00control\x1f\x85marks\u00a0here", "x", "x"]
    out += [syllables(rng, rng.randint(5, 90)) + "\n" + (passage if k % 3 == 0 else line) + "\n" + syllables(rng, rng.randint(0, 60)) for k in range(12)]
    out += [syllables(rng, rng.randint(1, 200)) for _ in range(12)]
    return out


def frame(spark, texts, ids=None, clashing=True, **more):
    ids = list(range(len(texts))) if ids is None else ids
    extra = CLASHING if clashing else ()
    names = ["doc_id", "text", *more, *extra]
    rows = [(i, t, *(m[k] for m in more.values()), *("clash" for _ in extra)) for k, (i, t) in enumerate(zip(ids, texts))]
    kinds = ["doc_id long", "text string", *(f"{m} {'string' if m == 'lang' else 'long'}" for m in more), *(f"`{c}` string" for c in extra)]
    return spark.createDataFrame(rows, ", ".join(kinds)).select(*names)


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def suffix_dedup(rows, window=50):
    """Operator 5 by a table of all windows."""
    no_id = float("inf")
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        d = no_id if d is None else d
        for p in range(len(b) - window + 1):
            w = b[p:p + window]
            first[w] = min(d, first.get(w, no_id))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        own = no_id if d is None else d
        gone = [False] * len(b)
        for p in range(len(b) - window + 1):
            if first[b[p:p + window]] < own:
                gone[p:p + window] = [True] * window
        runs = sum(g and not before for g, before in zip(gone, [False, *gone]))
        out.append((d, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def phrase_dedup(rows, window=35):
    """Operator 10 by a count of all windows."""
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[p:p + window]) for w in words for p in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if count[tuple(w[p:p + window])] > 1:
                gone[p:p + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def same(got, want):
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))
