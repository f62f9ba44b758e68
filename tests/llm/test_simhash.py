import itertools
import random

import numpy as np
import xxhash
from llm_helpers import WORD, awkward_texts, frame, same

from shelfwise.llm import components, simhash_dedup as S
from pyspark.sql import functions as F


def plainly(text, words=4):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reached(nodes, most):
    """Least node reachable from each of {node: fingerprint}."""
    own = {n: n for n in nodes}
    def root(n):
        while own[n] != n:
            n = own[n]
        return n
    for a, b in itertools.combinations(sorted(nodes), 2):
        if (nodes[a] ^ nodes[b]).bit_count() <= most:
            x, y = sorted((root(a), root(b)))
            own[y] = x
    return {n: root(n) for n in nodes}


def test_rows_match_brute_force(spark):
    texts = [*awkward_texts(), "Ka TO mi RE", "ka to MI re", "ÄB ab"]
    texts += [" ".join(w for w in awkward_texts()[7].split() if w != x) for x in awkward_texts()[7].split()[:20]]
    ids = [3 * k + 1 for k in range(len(texts))]
    ids[2], ids[8], ids[10] = None, None, 1
    got = S.near_duplicates(frame(spark, texts, ids)).drop("key").collect()
    prints = [plainly(t) for t in texts]
    least = {}
    for d, f in zip(ids, prints):
        if d is not None:
            least[f] = min(d, least.get(f, d))
    root = reached({d: f for f, d in least.items()}, 4)
    same(got, [(d, f"{f:016x}", root[least[f]] if f in least else None) for d, f in zip(ids, prints)])


def clustered(rng, n):
    """Fingerprints with tight groups, chains and strangers."""
    out = {rng.getrandbits(64) for _ in range(n)}
    for center in list(out)[:5]:
        for _ in range(n // 5):
            x = center
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            out.add(x)
    chain = rng.getrandbits(64)
    for k in range(0, 60, 4):
        chain ^= 15 << k
        out.add(chain)
    return sorted(out)


def nodes_of(spark, prints):
    rows = [(k, int(np.uint64(f).view(np.int64))) for k, f in enumerate(prints)]
    return spark.createDataFrame(rows, "node long, fp long")


def test_no_link_is_lost_whatever_the_plan(spark, monkeypatch):
    prints = clustered(random.Random(8), 80)
    nodes = nodes_of(spark, prints).cache()
    for most in (0, 1, 3, 4):
        want = reached(dict(enumerate(prints)), most)
        want = {k: v for k, v in want.items() if k != v or k in [x for y, x in want.items() if y != x]}
        for group in (16384, 3):  # with 3, nearly all keys are crowded
            e = S.edges(nodes, most, group)
            assert {r.node: r.component for r in components.components(e).collect()} == want, (most, group)
    rng = np.random.default_rng(1)
    want = {k: v for k, v in reached(dict(enumerate(prints)), 4).items()}
    for thresholds in ([2, 1], [1, 2], [1, 1, 0], [1, 0, 1], [0, 0, 0, 1], [-1, 2, 1], [0] * 5):
        bits = [sorted(x.tolist()) for x in np.array_split(rng.permutation(64), len(thresholds))]
        parts = [(b, t) for b, t in zip(bits, thresholds) if t >= 0]
        monkeypatch.setattr(S, "planned", lambda *_: parts)
        if sum(t + 1 for _, t in parts) < 5:
            continue
        got = {r.node: r.component for r in components.components(S.edges(nodes, 4)).collect()}
        assert {k: got.get(k, k) for k in want} == want, thresholds


def test_allocation_shares_out_all():
    for most in range(5):
        cost, chosen = S.allocation([10.0, 0.1, 5.0], [22, 21, 21], most)
        assert sum(t + 1 for t in chosen) == most + 1
        plain = min((sum(0 if t < 0 else S.ROW * S.ball(w, (t + 1) // 2) + S.CANDIDATE * e * S.ball(w, t) for e, w, t in zip([10.0, 0.1, 5.0], [22, 21, 21], ts)), ts)
                    for ts in itertools.product(range(-1, 3), repeat=3) if sum(t + 1 for t in ts) == most + 1)
        assert abs(cost - plain[0]) < 1e-9


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (4000, 64)).astype(float)
    for a, b in ((0, 40), (1, 50), (2, 60)):
        x[:, b] = x[:, a]
    parts = S.grouped_bits(len(x), x.T @ x, 4)
    assert sorted(b for p in parts for b in p) == list(range(64)) and all(len(p) == 16 for p in parts)
    assert all(any({a, b} <= set(p) for p in parts) for a, b in ((0, 40), (1, 50), (2, 60)))


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_representatives_are_one_of_each(spark):
    found = S.near_duplicates(frame(spark, ["a b c d e", "A b c d e", "zz yy", "a b c d e", None, ""], [5, 3, 9, 5, None, None]))
    got = S.representatives(found).collect()
    assert sorted(((r.doc_id is None), r.doc_id) for r in got if r.doc_id is not None) == [(False, 3), (False, 9)] and len(got) == 3
    assert S.near_duplicates(frame(spark, [])).count() == 0
