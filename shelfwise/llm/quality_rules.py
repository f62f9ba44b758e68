"""Operator 7: quality rules, and an isolation forest on the rules' statistics.

Three steps, of which only the first reads texts:

1. Statistics of every whole text in one scan, written to the shared folder (a few numbers a row).
2. A forest of random trees. Each tree is grown by its own group from about ``tree_rows`` labelled
   rows; random splits isolate unusual rows early, so a short path means an anomaly. The sample of
   labelled rows is bounded by ``trees * tree_rows`` and drawn by a hash of the id; with fewer rows
   each goes to several trees. A share of ``bad_share`` of it are bad rows, however many there are: as
   common as they are in the corpus they would hide one another, and without any no split would lie
   between them and the good ones. Splits choose a feature by how far apart the good and bad rows of
   the tree lie along it, so that a row that is odd in one feature gets a short path.
3. Scores of every row, and a threshold from all labelled rows: counts of good and bad rows by score
   go to the driver (``BINS`` of them), and the threshold is the one that rejects most bad rows while
   it rejects at most ``good_loss`` of the good ones.

Rows that fail the base rules are rejected by these; the forest and its threshold are for the others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored, texts

# --- fixed values: the rules
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # of 100 words
# --- end of fixed values

UPPER = bytes(range(ord("A"), ord("Z") + 1))
BINS = 2000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
MARKS = b"!?"


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of ``width`` words that the text has twice or more; exact at any length.

    Words become numbers and numbers of windows are joined two by two, so memory is a few numbers a word.
    """
    n = len(words)
    if n <= width:
        return 0
    known: dict[bytes, int] = {}
    codes = {1: np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)}
    if len(known) == n:
        return 0
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = codes[have][: n - have - step + 1], codes[step][have:][: n - have - step + 1]
        _, code = np.unique(left * (int(codes[step].max()) + 1) + right, return_inverse=True)
        have += step
        codes[have] = code
    code = codes[width]
    hit = np.bincount(code)[code] > 1
    edges = np.zeros(n + 1, np.int64)
    edges[:len(hit)] += hit
    edges[width:width + len(hit)] -= hit
    return int((np.cumsum(edges)[:n] > 0).sum())


def statistics(text: str) -> tuple[int, ...]:
    """The numbers named in ``STATS``."""
    raw = text.encode()
    words = raw.split()  # of bytes: at space and U+0009 to U+000D only
    joined = b"".join(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (len(words), len(text) - (len(raw) - len(joined)), len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines),
            len(raw) - len(raw.translate(None, UPPER)), len(raw) - len(raw.translate(None, MARKS)))


def rule_statistics(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``STATS`` of every whole text; a null or empty text has zeros."""
    names = ["doc_id", *STATS]

    def run(batches):
        for b in batches:
            rows = np.array([statistics(t) for t in b.column("text").to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(rows[:, i]) for i in range(len(STATS)))], names)

    return texts(df, doc_id, text).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def features(stats: np.ndarray) -> np.ndarray:
    """Rates, so that length alone is no anomaly; columns in the order of ``STATS``."""
    n, chars, symbols, dup, repeat, lines, upper, marks = stats.T.astype(float)
    n, chars, lines = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.column_stack([chars / n, symbols / n, dup / lines, repeat / n, upper / chars, marks / n])


def distances(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The largest distance between the distributions of good and of bad rows along each feature; zeros without both."""
    out = np.zeros(x.shape[1])
    if good.all() or not good.any():
        return out
    for f in range(x.shape[1]):
        at = np.unique(x[:, f])
        share = [np.searchsorted(np.sort(x[rows, f]), at, "right") / rows.sum() for rows in (good, ~good)]
        out[f] = np.abs(share[0] - share[1]).max()
    return out


def grow(x: np.ndarray, rng: np.random.Generator, depth: int, weight: np.ndarray | None = None) -> list[tuple[int, float, int, float]]:
    """A random tree: (feature or -1, split, right child, path length to add at a leaf); the left child follows.

    Features are drawn by their weights, those without a weight never; all alike if there are none.
    """
    nodes: list = []
    weight = weight if weight is not None and weight.any() else np.ones(x.shape[1])

    def node(rows: np.ndarray, left: int) -> None:
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero((high > low) & (weight > 0)) if len(rows) else ()
        at = len(nodes)
        if not left or len(rows) <= 1 or not len(open_):
            nodes.append((-1, 0.0, -1, mean_path(len(rows))))
            return
        f = int(rng.choice(open_, p=weight[open_] / weight[open_].sum()))
        split = float(rng.uniform(low[f], high[f]))
        nodes.append(None)
        go = rows[:, f] < split
        node(rows[go], left - 1)
        nodes[at] = (f, split, len(nodes), 0.0)
        node(rows[~go], left - 1)

    node(x, depth)
    return nodes


def mean_path(n: int) -> float:
    """The mean path of an unsuccessful search among n rows."""
    if n < 2:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def path_scores(trees: list, x: np.ndarray, tree_rows: int) -> np.ndarray:
    """Anomaly scores in (0, 1): 2 to the minus mean path length over its usual length."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, split, right, extra in trees:
        at, depth = np.zeros(len(x), np.int64), np.zeros(len(x))
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            go_left = x[rows, np.maximum(f, 0)] < split[at]
            at = np.where(inner, np.where(go_left, at + 1, right[at]), at)
            depth += inner
        total += depth + extra[at]
    return 2.0 ** (-total / max(len(trees), 1) / max(mean_path(tree_rows), 1e-9))


def drawn(n: dict[bool, int], trees: int, tree_rows: int, bad_share: float) -> dict[bool, tuple[int, float]]:
    """Of ``n`` good and bad rows: the trees that each may go to, and the share drawn for each of these.

    Bad rows are ``bad_share`` of all that are drawn, whether or not there are enough good ones to fill the trees.
    """
    good = min(trees * tree_rows * (1 - bad_share), trees * n.get(True, 0))
    want = {True: good, False: good * bad_share / (1 - bad_share)}
    out = {}
    for k, w in want.items():
        copies = max(1, min(trees, math.ceil(w / n[k]))) if n.get(k) else 1
        out[k] = copies, min(1.0, w / (n[k] * copies)) if n.get(k) else 0.0
    return out


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


class Forest:
    """The fitted forest and its threshold; plain arrays of a bounded size, sent along with the tasks."""

    def __init__(self, trees: list, tree_rows: int, threshold: float):
        self.trees, self.tree_rows, self.threshold = trees, tree_rows, threshold

    def score(self, stats: DataFrame) -> DataFrame:
        """``stats`` with a column ``anomaly``."""
        trees, tree_rows = self.trees, self.tree_rows

        def run(batches):
            for b in batches:
                x = np.column_stack([b.column(n).to_numpy() for n in STATS]) if b.num_rows else np.zeros((0, len(STATS)))
                score = path_scores(trees, features(x), tree_rows) if trees else np.zeros(b.num_rows)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, "anomaly"])

        return stats.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stats.schema)}, anomaly double")


def fit(stats: DataFrame, labels: DataFrame, trees: int = 100, tree_rows: int = 256, good_loss: float = 0.002,
        bad_share: float = 1 / 32, seed: int = 7, doc_id: str = "doc_id", quality: str = "quality") -> Forest:
    """Forest and threshold from the statistics of labelled rows (quality 1 or 0).

    Labels without an id or a quality are left out; several for one id count as its worst. Without
    labelled rows of both kinds that pass the base rules there is no threshold and nothing is an anomaly.
    """
    known = (labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(quality).cast("int").alias("quality"))
             .where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")))
    labelled = stored(stats.where("doc_id is not null").where(~base_failed()).join(known, "doc_id"), "labelled-statistics")
    n = {r.good: r.n for r in labelled.groupBy((F.col("quality") > 0).alias("good")).agg(F.count("*").alias("n")).collect()}
    if not n:
        return Forest([], tree_rows, math.inf)
    copies, share = ({k: x[i] for k, x in drawn(n, trees, tree_rows, bad_share).items()} for i in (0, 1))
    is_good = F.col("quality") > 0
    of_class = lambda x: F.when(is_good, F.lit(x[True])).otherwise(F.lit(x[False]))
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed), F.col("copy")), F.lit(1 << 30))
    # copies of a row go to different trees
    sample = (labelled.select("*", F.explode(F.sequence(F.lit(0), of_class(copies) - 1)).alias("copy"))
              .where(place < of_class({k: int(x * (1 << 30)) for k, x in share.items()}))
              .select(F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)) + F.col("copy") * of_class({k: trees // x for k, x in copies.items()}), F.lit(trees)).alias("tree"),
                      "doc_id", "quality", *STATS))
    depth = math.ceil(math.log2(max(tree_rows, 2)))

    def one(rows):
        rows = rows.sort_values("doc_id")
        tree = int(rows["tree"].iloc[0])
        x = features(rows[list(STATS)].to_numpy())
        nodes = grow(x, np.random.default_rng([seed, tree]), depth, distances(x, rows["quality"].to_numpy() > 0) ** 2)
        out = np.array(nodes, float).reshape(-1, 4)
        import pandas as pd
        return pd.DataFrame({"tree": tree, "feature": [out[:, 0].astype(int).tolist()], "split": [out[:, 1].tolist()],
                             "right": [out[:, 2].astype(int).tolist()], "extra": [out[:, 3].tolist()]})

    grown = sample.groupBy("tree").applyInPandas(
        one, "tree long, feature array<int>, split array<double>, right array<int>, extra array<double>").collect()
    forest = Forest([(np.array(r.feature), np.array(r.split), np.array(r.right), np.array(r.extra))
                     for r in sorted(grown, key=lambda r: r.tree)], max(2, min(tree_rows, round(sum(n[k] * copies[k] * share[k] for k in n) / trees))), math.inf)
    counts = (forest.score(labelled).groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"))
              .agg(F.sum((F.col("quality") > 0).cast("long")).alias("good"), F.sum((F.col("quality") <= 0).cast("long")).alias("bad")).collect())
    forest.threshold = threshold({r.bin: (r.good, r.bad) for r in counts}, good_loss)
    return forest


def threshold(counts: dict[int, tuple[int, int]], good_loss: float) -> float:
    """The lowest score bound at or above which at most ``good_loss`` of the good rows lie; none without both kinds."""
    good, bad = (sum(x[i] for x in counts.values()) for i in (0, 1))
    if not good or not bad:
        return math.inf
    lost, bound = 0, math.inf
    for b in sorted(counts, reverse=True):
        lost += counts[b][0]
        if lost > good_loss * good:
            break
        bound = b / BINS
    return bound


def judge(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly`` for each input row.

    A null or empty text has no words and fails the base rules; null ids and repeated rows come back
    as they are; other columns are not read; an empty table gives an empty one. Ties at the threshold
    are rejected. Texts of any length are read whole; one text bounds a task's memory.
    """
    stats = stored(rule_statistics(df, doc_id, text), "rule-statistics")
    forest = fit(stats, labels, **parameters)
    return (forest.score(stats).withColumn("base_failed", base_failed())
            .select("doc_id", *STATS[:5], "base_failed",
                    (~F.col("base_failed") & (F.col("anomaly") < F.lit(forest.threshold))).alias("kept"), "anomaly"))
