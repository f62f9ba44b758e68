"""Operator 3: SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints link at ``most`` or fewer differing bits. Equal fingerprints become one node first. Then

* bits that vary together are grouped into the same part (their correlations are sums over all
  fingerprints), since a part of independent groups splits the fingerprints best;
* the principle in its general form: if the parts' thresholds plus one add up to ``most`` plus one,
  every linking pair is within its threshold in at least one part. The number of parts and their
  thresholds come from dynamic programming over estimated costs: rows to send, and candidates to
  verify, counted from the parts' values. A part may also get no share at all;
* each node sends, for each part, its value or all values near it (``probes``), so that every pair
  within the threshold meets under a key, and is verified there on all 64 bits.

Under one key only the edges of a spanning forest are returned, never all pairs. Keys that may hold
more than ``GROUP`` nodes are not gathered at all: their nodes are joined on the full fingerprints,
where each node sends the values within half of ``most`` bits of its own. Two nodes link exactly if
such balls share a value, and a star around each value's least node connects all that share it, so
the work there is linear in the nodes, however dense the group. Components come from the edges by
alternating stars.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import shuffle_parts, stored, texts
from .components import components

BITS = 64
GROUP = 16384
#: Costs of sending a row and of verifying a candidate, in the same unit.
ROW, CANDIDATE = 1.0, 0.006
#: For the estimate a part's values are counted by this many of its bits.
ESTIMATE_BITS = 12


def fingerprint(text: bytes, words: int, seed: int = 42) -> int:
    """SimHash of the lower-cased words' shingles; zero without words."""
    from xxhash import xxh64_digest

    w = text.translate(LOWER).split()
    if not w:
        return 0
    if len(w) <= words:
        digests = xxh64_digest(b" ".join(w), seed)
        n = 1
    else:
        joined = b" ".join(w)
        ends = list(itertools.accumulate(len(x) + 1 for x in w))
        n = len(w) - words + 1
        digests = b"".join([xxh64_digest(joined[a:b - 1], seed) for a, b in zip([0, *ends], ends[words - 1:])])
    ones = np.zeros(BITS, np.int64)
    step = 1 << 16
    for at in range(0, n, step):  # a long text's bits are added up in pieces
        bits = np.unpackbits(np.frombuffer(digests, np.uint8)[8 * at:8 * (at + step)].reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


LOWER = bytes(range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


def fingerprints(df: DataFrame, words: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, fp`` of every whole text: its MD5, and the 64 bits as a long."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.encode(), words) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(fp.view(np.int64))], ["doc_id", "key", "fp"])

    docs = texts(df, doc_id, text).select("doc_id", F.unhex(F.md5("text")).alias("key"), "text")
    return docs.mapInArrow(run, "doc_id long, key binary, fp long")


# ---- the plan: parts of correlated bits, and their thresholds


def bit_moments(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each two bits are both set; 4,096 sums whatever the input."""
    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = bits_of(b.column("fp").to_numpy())
            n += len(x)
            both += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([float(n), *both.ravel()]), pa.array(range(BITS * BITS + 1))], ["v", "i"])

    got = nodes.select("fp").mapInArrow(run, "v double, i long").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in got:
        flat[r.i] = r.v
    return int(flat[0]), flat[1:].reshape(BITS, BITS)


def bits_of(fp: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones, the lowest bit first."""
    return np.unpackbits(np.ascontiguousarray(fp).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` groups of about equal size: each begins with the least used bit and takes what goes with it."""
    p = np.diag(both) / max(n, 1)
    deviation = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(deviation, deviation))
    np.fill_diagonal(related, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = math.ceil(len(left) / (parts - k))
        group = [max(left, key=lambda i: (related[i, sorted(left)].sum(), -i))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda i: (related[i, group].sum(), -i))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def part_values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The part's bits of each fingerprint, put together as a number."""
    out = np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.int64(b)) & 1) << np.int64(k)
    return out


def estimated(nodes: DataFrame, n: int, plans: dict[int, list[list[int]]]) -> dict[tuple[int, int], float]:
    """For each number of parts and part: estimated equal pairs a node, from counts of (folded) values.

    All nodes are counted; a value is folded to ``ESTIMATE_BITS``, and the pairs that folding adds
    are taken off as for independent bits. What comes back is one number a part.
    """
    flat = [(m, i, bits) for m, parts in plans.items() for i, bits in enumerate(parts)]

    def run(batches):
        counts = [np.zeros(1 << min(len(bits), ESTIMATE_BITS), np.int64) for _, _, bits in flat]
        for b in batches:
            fp = b.column("fp").to_numpy()
            for c, (_, _, bits) in zip(counts, flat):
                c += np.bincount(part_values(fp, bits[:ESTIMATE_BITS]), minlength=len(c))
        for k, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(c[at])], ["k", "v", "n"])

    got = (nodes.select("fp").mapInArrow(run, "k int, v long, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
           .groupBy("k").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs")).collect())
    out = {}
    for r in got:
        m, i, bits = flat[r.k]
        out[m, i] = max(r.pairs / max(n, 1) - 1, 0) / 2 ** (len(bits) - min(len(bits), ESTIMATE_BITS))
    return out


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1))


def allocation(equal: list[float], widths: list[int], most: int) -> tuple[float, list[int]]:
    """Cost a node and thresholds (-1: none) of the parts, by dynamic programming over the shares.

    A threshold t takes t + 1 of the ``most`` + 1 shares, costs the rows of its probes, and candidates:
    the part's equal pairs times the values within t, as many as differ in t bits or fewer.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for e, w in zip(equal, widths):
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, most - used + 1):
                if t > 2:
                    break
                own = 0.0 if t < 0 else ROW * ball(w, (t + 1) // 2) + CANDIDATE * e * ball(w, t)
                key = used + t + 1
                if key not in after or cost + own < after[key][0]:
                    after[key] = (cost + own, [*chosen, t])
        best = after
    return best.get(most + 1, (math.inf, []))


def planned(nodes: DataFrame, most: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts that probe."""
    n, both = bit_moments(nodes)
    plans = {m: grouped_bits(n, both, m) for m in range(2, most + 2)} if most else {1: [list(range(BITS))]}
    equal = estimated(nodes, n, plans)
    found = {m: allocation([equal.get((m, i), 0.0) for i in range(m)], [len(b) for b in parts], most) for m, parts in plans.items()}
    m = min(found, key=lambda k: found[k][0])
    return [(bits, t) for bits, t in zip(plans[m], found[m][1]) if t >= 0]


# ---- probing and verifying


def near(values: np.ndarray, width: int) -> np.ndarray:
    """A row for each value: itself and all that differ in one bit."""
    flips = np.concatenate([[0], np.int64(1) << np.arange(width, dtype=np.int64)])
    return values[:, None] ^ flips[None, :]


def probes(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """``part, value, own, node, fp``: a row for each key a node is to meet others under.

    Threshold 0 sends the value, others also all values one bit away: pairs two bits apart meet
    between. ``own`` marks the value itself.
    """
    def run(batches):
        for b in batches:
            fp, node = b.column("fp").to_numpy(), b.column("node").to_numpy()
            for k, (bits, t) in enumerate(parts):
                v = part_values(fp, bits)
                v = near(v, len(bits)) if t else v[:, None]
                own = np.zeros(v.shape, bool)
                own[:, 0] = True
                each = v.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(v.size, k, np.int32)), pa.array(v.ravel()), pa.array(own.ravel()),
                                                  pa.array(np.repeat(node, each)), pa.array(np.repeat(fp, each))], ["part", "value", "own", "node", "fp"])

    return nodes.select("node", "fp").mapInArrow(run, "part int, value long, own boolean, node long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def forest_edges(fp: np.ndarray, own: np.ndarray | None, most: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among ``fp``; with ``own``, only pairs with one such."""
    n = len(fp)
    label = np.arange(n)
    edges = []
    for i in range(n - 1):
        hit = popcount(fp[i + 1:] ^ fp[i]) <= most
        if own is not None and not own[i]:
            hit &= own[i + 1:]
        hit &= label[i + 1:] != label[i]
        for j in i + 1 + np.flatnonzero(hit):
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                edges.append((i, int(j)))
    return edges


def verified(keyed: DataFrame, parts: list[tuple[list[int], int]], most: int) -> DataFrame:
    """Edges ``a, b`` among the nodes of each key; keys come sorted, one after another."""
    both_sides = {k for k, (_, t) in enumerate(parts) if t > 1}

    def run(batches):
        held: list = []

        def edges(part: int, own, node, fp):
            if len(fp) == 2:  # most keys with company have just two
                if (part in both_sides or own.any()) and int(fp[0] ^ fp[1]).bit_count() <= most:
                    return [(node[0], node[1])]
                return []
            return [(node[i], node[j]) for i, j in forest_edges(fp, None if part in both_sides or own.all() else own, most)]

        for b in itertools.chain(batches, [None]):
            if b is not None:
                held = [np.concatenate([x, b.column(c).to_numpy(zero_copy_only=False)]) for c, x in zip(COLUMNS, held)] if held else [
                    b.column(c).to_numpy(zero_copy_only=False) for c in COLUMNS]
            if not held or not len(held[0]):
                continue
            part, value, own, node, fp = held
            starts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (value[1:] != value[:-1])]))
            ends = np.append(starts[1:], len(part))
            if b is not None:  # the last key may go on in the next batch
                held = [x[starts[-1]:] for x in held]
                starts, ends = starts[:-1], ends[:-1]
            out = []
            for s, e in zip(starts, ends):
                if e - s > 1:
                    out += edges(int(part[s]), own[s:e], node[s:e], fp[s:e])
            a = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    return keyed.mapInArrow(run, "a long, b long")


COLUMNS = ("part", "value", "own", "node", "fp")


def crowded_keys(nodes: DataFrame, parts: list[tuple[list[int], int]], group: int) -> DataFrame:
    """``part, value`` of all keys that may hold more than ``group`` nodes.

    Such a key has a value near it that many nodes share, so values are counted, not keys.
    """
    alone = [(bits, 0) for bits, _ in parts]
    limits = [group // ball(len(bits), 1 if t else 0) for bits, t in parts]
    widths = [len(bits) if t else 0 for bits, t in parts]
    heavy = (probes(nodes, alone).groupBy("part", "value").agg(F.count("*").alias("n"))
             .where(F.col("n") > F.element_at(F.array(*[F.lit(x) for x in limits]), F.col("part") + 1)).select("part", "value"))

    def run(batches):
        for b in batches:
            for k, v in zip(b.column("part").to_pylist(), b.column("value").to_pylist()):
                keys = near(np.array([v], np.int64), widths[k]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys)], ["part", "value"])

    return heavy.mapInArrow(run, "part int, value long").distinct()


def crowded_edges(nodes: DataFrame, most: int) -> DataFrame:
    """Stars around the values within half of ``most`` bits of the nodes: all links, in linear work.

    For an odd distance a node also reaches out one bit further, but no star is centred there.
    """
    inner, outer = most // 2, most - most // 2
    masks = np.array([sum(1 << b for b in c) for r in range(outer + 1) for c in itertools.combinations(range(BITS), r)], np.uint64).view(np.int64)
    close = np.bitwise_count(masks.view(np.uint64)) <= inner

    def run(batches):
        for b in batches:
            fp, node = b.column("fp").to_numpy(), b.column("node").to_numpy()
            for at in range(0, len(fp), 64):
                around = fp[at:at + 64, None] ^ masks[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(around.ravel()), pa.array(np.repeat(node[at:at + 64], len(masks))),
                                                  pa.array(np.tile(close, len(around)))], ["center", "node", "close"])

    around = nodes.select("node", "fp").mapInArrow(run, "center long, node long, close boolean")
    least = (around.groupBy("center").agg(F.min(F.when(F.col("close"), F.col("node"))).alias("a"), F.min("node").alias("y"), F.max("node").alias("z"))
             .where("a is not null and y < z").select("center", "a"))
    return around.join(least, "center").where("a <> node").select("a", F.col("node").alias("b"))


def edges(nodes: DataFrame, most: int, group: int = GROUP) -> DataFrame:
    """``a, b``: edges that connect exactly what links of ``node, fp`` connect; fingerprints are distinct."""
    parts = planned(nodes, most)
    keyed = probes(nodes, parts)
    crowded = stored(crowded_keys(nodes, parts, group), "crowded-keys")
    found = None
    if not crowded.isEmpty():
        found = crowded_edges(keyed.join(crowded, ["part", "value"], "left_semi").select("node", "fp").distinct(), most)
        keyed = keyed.join(crowded, ["part", "value"], "left_anti")
    dealt = keyed.repartition(shuffle_parts(nodes.sparkSession), "part", "value").sortWithinPartitions("part", "value", "node")
    own = verified(dealt.select(*COLUMNS), parts, most)
    return own if found is None else own.union(found)


def near_duplicates(df: DataFrame, words: int = 4, most: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, fingerprint, component_id`` for each input row; ``key`` is the MD5 of its text.

    ``component_id`` is the least id that links reach. A null or empty text has the fingerprint zero
    and links like any other. A row without an id keeps its fingerprint and gets the component of
    the other rows with it, null if there are none: it is no node itself. Repeated rows come back as
    they are; other columns are not read; an empty table gives an empty one.
    """
    docs = stored(fingerprints(df, words, doc_id, text), "fingerprints")
    nodes = stored(docs.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    pairs = stored(edges(nodes, most).distinct(), "links")
    moved = components(pairs)
    labels = nodes.join(moved, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return docs.join(labels, "fp", "left").select(
        "doc_id", "key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(found: DataFrame) -> DataFrame:
    """``doc_id, key`` of one row of each component of ``near_duplicates``: the least id.

    Rows without an id stay only if no row with an id has their fingerprint, one for each fingerprint.
    """
    least = F.min(F.struct("doc_id", "key")).alias("least")
    with_id = found.where("doc_id is not null").groupBy("component_id").agg(least)
    without = found.where("component_id is null").groupBy("fingerprint").agg(least)
    return with_id.select("least.*").union(without.select("least.*"))
