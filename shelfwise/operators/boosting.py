"""Boosted regression trees whose fit stops by itself (G3, G11), and what their splits gained.

MLlib's boosting computes every round it is allowed and can't wait for a better
one, and one MLlib tree a round costs about ten jobs over all rows. Here the
features are binned once (MLlib's rule, over the counts of all values), rows of
the same bins become one cell with their number, mean and squares, and the rounds
run on the cells: exact for squared error, and bounded by the product of the bins
whatever the number of rows. A round is one job for each level of its tree; tasks
send sums by node, feature and bin, and the split is chosen from these
(``trees``). Rounds come in blocks: after one, the cells' running prediction is
computed again and checkpointed with the block's trees in it, and one job gives
the validation error of each round of the block. The fit ends in the block in which
``patience`` rounds in a row were no better than the best one; the model keeps
the trees up to that. A lost executor costs its tasks of the current level, not
the rounds before, and no plan grows with the number of rounds.

The first tree is a single leaf, the mean of the labels; its weight is 1, that
of the others ``step``. The result is a plain MLlib ensemble: it is saved, loaded
and applied like any other.

``fit_sampled`` is the fit without an end by itself, of trees that draw their rows
and each node's features: MLlib's ``GBTRegressor`` with its own draws, on binned
rows instead of cells, as a row that a tree leaves out can't share its cell.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.ml.wrapper import JavaModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, forget, scratch_path, ship_package, stored
from . import trees as T
from .indexing import running_sums

_X, _JUDGED = "__x", "__judged"
#: Values of a feature up to which its bins' bounds come from the single values, beyond from this many runs of neighbours.
PIECES = 10_000
#: Cells of a task, about; more cells are more tasks.
CELLS = 16_384


@dataclass(frozen=True)
class BoostConfig:
    rounds: int = 500
    depth: int = 6
    step: float = 0.1
    patience: int = 50      # rounds without a better validation error
    block: int = 10         # rounds between two writes of the margin
    max_bins: int = 64
    seed: int = 42


@dataclass(frozen=True)
class SampledConfig:
    trees: int
    depth: int
    step: float = 0.03
    rows: float = 0.8       # share of the rows that a tree draws
    columns: float = 1.0    # share of the features that a node draws
    max_bins: int = 64
    seed: int = 42
    block: int = 5          # trees between two writes of the margin


@dataclass
class Boosted:
    model: GBTRegressionModel
    best_round: int                     # trees kept, without the first leaf
    rounds_fitted: int
    rounds_allowed: int
    # (round, validation RMSE) from round 0, the mean alone; empty without validation rows
    history: list[tuple[int, float]] = field(default_factory=list)

    @property
    def best_error(self) -> float | None:
        return self.history[self.best_round][1] if self.history else None

    @property
    def stopped_early(self) -> bool:
        return self.rounds_fitted < self.rounds_allowed

    def history_frame(self, spark) -> DataFrame:
        """round, validation_rmse, best, kept: a row for each round that was judged (at most the rounds allowed)."""
        rows = [(r, float(e), r == self.best_round, r <= self.best_round) for r, e in self.history]
        return spark.createDataFrame(rows, "round int, validation_rmse double, best boolean, kept boolean")


def ensemble(trees: list, weights: list[float], n_features: int, features: str, prediction: str = "prediction") -> GBTRegressionModel:
    """MLlib's boosted model of fitted MLlib trees and their weights."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    ml = sc._jvm.org.apache.spark.ml.regression
    java_trees, java_weights = sc._gateway.new_array(ml.DecisionTreeRegressionModel, len(trees)), sc._gateway.new_array(sc._jvm.double, len(trees))
    for i, (t, w) in enumerate(zip(trees, weights)):
        java_trees[i], java_weights[i] = t._java_obj if isinstance(t, JavaModel) else t, float(w)
    model = GBTRegressionModel(ml.GBTRegressionModel(f"gbtr_{uuid.uuid4().hex[:12]}", java_trees, java_weights, n_features))
    return model.setFeaturesCol(features).setPredictionCol(prediction)


class Stopping:
    """The round with the least error so far, and whether ``patience`` rounds in a row were no better."""

    def __init__(self, patience: int):
        self.patience, self.best, self.errors, self.done = patience, 0, [], False

    def see(self, error: float) -> None:
        """Take the next round's error; after the end further ones are ignored."""
        if self.done:
            return
        self.errors.append(error)
        at = len(self.errors) - 1
        if at == 0 or error < self.errors[self.best]:
            self.best = at
        elif at - self.best >= self.patience:
            self.done = True


def best_round(errors: list[float], patience: int) -> int:
    """The round with the least error before ``patience`` rounds in a row are no better."""
    stopping = Stopping(patience)
    for e in errors:
        stopping.see(e)
    return stopping.best


def fit_boosted(train: DataFrame, validation: DataFrame | None, features: str, label: str, cfg: BoostConfig = BoostConfig()) -> Boosted:
    """Boost trees on ``train``; both tables have a vector column ``features`` of numbers and a label that is never null.

    Without validation rows all rounds are fitted and kept.
    """
    def table(df: DataFrame) -> DataFrame:
        return stored(df.select(features, F.col(label).cast("double").alias(label)), "margins")

    if cfg.rounds < 0 or cfg.block < 1 or cfg.patience < 1:
        raise ValueError("rounds must be 0 or more, block and patience 1 or more")
    spark = train.sparkSession
    ship_package(spark)
    rows = table(train)
    mean = DecisionTreeRegressor(featuresCol=features, labelCol=label, maxDepth=0, seed=cfg.seed).fit(rows)
    n_features = mean.numFeatures
    base = float(mean._java_obj.rootNode().prediction())
    first = ensemble([mean], [1.0], n_features, features)
    judged = None if validation is None or validation.isEmpty() else table(validation)
    stopping = Stopping(cfg.patience)
    if judged is not None:
        stopping.see(judged.agg(F.sqrt(F.avg(F.pow(F.col(label) - F.lit(base), 2)))).first()[0])
    if cfg.rounds == 0:
        fitted: list[T.Tree] = []
        cuts: list[list[float]] = []
    else:
        cuts = cut_points(rows, features, n_features, cfg.max_bins)
        cells = stored(cells_of(rows, judged, features, label, cuts), "margins")
        fitted = _rounds(cells, cuts, base, cfg, stopping if judged is not None else None)
        forget(cells)
    forget(rows)
    if judged is not None:
        forget(judged)
    best = stopping.best if judged is not None else len(fitted)
    model = with_trees(spark, first, fitted[:best], cfg.step, cuts)
    return Boosted(model, best, len(fitted), cfg.rounds, list(enumerate(stopping.errors)))


def cut_points(rows: DataFrame, features: str, n_features: int, max_bins: int) -> list[list[float]]:
    """Each feature's bounds between bins, from how often each of its values occurs.

    A feature of more than ``PIECES`` values is first summed up in runs of neighbouring
    values, so that the driver gets a bounded number of rows.
    """
    n_rows = rows.count()
    values = rows.select(F.posexplode(vector_to_array(features)).alias("feature", "value"))
    counts = stored(values.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), "values")
    many = [r["feature"] for r in counts.groupBy("feature").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > PIECES).collect()]
    pieces = [counts.where(~F.col("feature").isin(many)).select("feature", F.col("value").alias("first"), F.col("value").alias("last"), "n")]
    if many:
        ranked = running_sums(counts.where(F.col("feature").isin(many)), ["feature", "value"], {"upto": F.col("n")})
        run = F.floor((F.col("upto") - 1) / F.lit(max(1.0, 2.0 * n_rows / PIECES)))
        pieces.append(ranked.groupBy("feature", run).agg(F.min("value").alias("first"), F.max("value").alias("last"), F.sum("n").alias("n")).select("feature", "first", "last", "n"))
    by: dict[int, list] = {k: [] for k in range(n_features)}
    for part in pieces:
        for r in part.collect():
            by[r["feature"]].append((r["first"], r["last"], r["n"]))
    forget(counts)
    return [T.cut_points(sorted(by[k]), n_rows, max_bins) for k in range(n_features)]


def cells_of(train: DataFrame, judged: DataFrame | None, features: str, label: str, cuts: list[list[float]]) -> DataFrame:
    """bins, and n, mean, squares (around the mean) of the labels of training and of validation rows with these bins."""
    bounds = [np.array(c, dtype=float) for c in cuts]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(_X).flatten().to_numpy(zero_copy_only=False).reshape(len(b), len(bounds))
            at = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(bounds)], axis=1).astype(np.int32)
            bins = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * len(bounds), pa.int32()), pa.array(at.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([bins, b.column("y"), b.column(_JUDGED)], ["bins", "y", _JUDGED])

    def part(df: DataFrame, is_judged: bool) -> DataFrame:
        return df.select(vector_to_array(features).alias(_X), F.col(label).alias("y"), F.lit(is_judged).alias(_JUDGED))

    rows = part(train, False) if judged is None else part(train, False).unionByName(part(judged, True))
    sums = []
    for which, of in (("", ~F.col(_JUDGED)), ("judged_", F.col(_JUDGED))):
        y = F.when(of, F.col("y"))
        sums += [F.count(y).cast("double").alias(f"{which}n"), F.coalesce(F.avg(y), F.lit(0.0)).alias(f"{which}mean"),
                 F.coalesce(F.var_pop(y) * F.count(y), F.lit(0.0)).alias(f"{which}squares")]
    return rows.mapInArrow(binned, f"bins array<int>, y double, {_JUDGED} boolean").groupBy("bins").agg(*sums)


_SUMS = ["n", "mean", "squares", "judged_n", "judged_mean", "judged_squares"]


def _rounds(table: DataFrame, cuts: list[list[float]], base: float, cfg: BoostConfig, stopping: Stopping | None) -> list[T.Tree]:
    """The trees of all rounds until the fit ends."""
    sc = table.sparkSession.sparkContext
    checkpoint_dir(table.sparkSession)
    width, most = len(cuts), max(len(c) for c in cuts) + 1
    n_splits = np.array([len(c) for c in cuts])

    def arrays(found) -> Iterator[T.Cells]:
        rows = list(found)
        if rows:
            bins = np.array([r["bins"] for r in rows], dtype=np.int32).reshape(len(rows), width)
            yield T.Cells(bins, *[np.array([r[c] for r in rows], dtype=float) for c in _SUMS], np.full(len(rows), base))

    tasks = -(-table.count() // CELLS)
    current = table.repartition(tasks).rdd.mapPartitions(arrays).persist(StorageLevel.MEMORY_AND_DISK)

    fitted: list[T.Tree] = []
    step = cfg.step
    while len(fitted) < cfg.rounds and not (stopping and stopping.done):
        block: list[T.Tree] = []
        for _ in range(min(cfg.block, cfg.rounds - len(fitted))):
            before, now = [t.routes() for t in block], current
            block.append(T.grow(lambda routes, nodes: _added(now.map(lambda c: T.sums(c, before, step, routes, nodes, most))), n_splits, cfg.depth))
        fitted += block
        routes = [t.routes() for t in block]
        if stopping:
            n, *errors = _added(current.map(lambda c: T.judged(c, routes, step)))
            for e in errors:
                stopping.see(math.sqrt(e / n))
        if len(fitted) < cfg.rounds and not (stopping and stopping.done):
            current = _with_margins(sc, current, routes, step)
    _drop(sc, current)
    return fitted


def _added(rdd) -> np.ndarray:
    """The sum of the tasks' arrays."""
    return rdd.reduce(lambda a, b: a + b) if rdd.getNumPartitions() <= 32 else rdd.treeReduce(lambda a, b: a + b)


def _with_margins(sc, old, routes: list[tuple], step: float):
    """The cells or rows with a block's trees in their running prediction, written down; the former ones are dropped."""
    new = old.map(lambda c: replace(c, margin=T.margins(c, routes, step))).persist(StorageLevel.MEMORY_AND_DISK)
    new.checkpoint()
    new.count()
    _drop(sc, old)
    return new


def _drop(sc, rdd) -> None:
    """Free the cells of an earlier block, in memory and in the checkpoint folder."""
    rdd.unpersist()
    at = rdd.getCheckpointFile()
    if at:
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def fit_sampled(train: DataFrame, features: str, label: str, cfg: SampledConfig) -> GBTRegressionModel:
    """``cfg.trees`` boosted trees on all of ``train``, as MLlib's ``GBTRegressor`` fits them, with its draws of rows and features.

    Rows are binned once, with the trees that draw them; a tree costs one job for
    each level, whose tasks add up their rows in arrays. ``train`` is read three times.
    """
    if cfg.trees < 1 or cfg.block < 1:
        raise ValueError("trees and block must be 1 or more")
    spark = train.sparkSession
    ship_package(spark)
    one = train.select(features).first()
    if one is None:
        raise ValueError("no row to fit")
    n_features = one[features].size
    cuts = cut_points(train, features, n_features, cfg.max_bins)
    table = stored(binned_rows(train, features, label, cuts, cfg), "margins")
    fitted = _sampled_trees(table, cuts, cfg)
    forget(table)
    # a leaf on one row: the model that the trees are put into
    leaf = DecisionTreeRegressor(featuresCol=features, labelCol=label, maxDepth=0).fit(spark.createDataFrame([(Vectors.dense([0.0] * n_features), 0.0)], [features, label]))
    return with_trees(spark, ensemble([leaf], [1.0], n_features, features), fitted, cfg.step, cuts, first_is_mean=False)


def binned_rows(train: DataFrame, features: str, label: str, cuts: list[list[float]], cfg: SampledConfig) -> DataFrame:
    """Blocks of training rows: how many, and their bins, labels and draws as the bytes of arrays.

    Tree ``k`` draws a row if ``rand(seed + k + 1)`` is below the share: the generator
    and the seed of MLlib's draw. The draws are written, so that no task makes others.
    """
    bounds = [np.array(c, dtype=float) for c in cuts]
    kind = np.uint8 if max(len(c) for c in cuts) < 256 else np.uint16
    words = -(-cfg.trees // T.WORD)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = b.column(_X).flatten().to_numpy(zero_copy_only=False).reshape(len(b), len(bounds))
            at = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(bounds)], axis=1).astype(kind)
            drawn = b.column("drawn").flatten().to_numpy(zero_copy_only=False).reshape(len(b), words)
            y = b.column("y").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int32())] + [pa.array([a.tobytes()], pa.binary()) for a in (at, y, drawn)], ["n", "bins", "y", "drawn"])

    def word(first: int):
        trees = range(first, min(first + T.WORD, cfg.trees))
        if cfg.rows >= 1:
            return F.lit(sum(1 << (k - first) for k in trees)).cast("long")
        return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.rand(cfg.seed + k + 1) < cfg.rows, F.lit(1 << (k - first)).cast("long")).otherwise(F.lit(0).cast("long")) for k in trees])

    y = F.col(label).cast("double")
    known = F.when(y.isNull() | F.isnan(y) | (F.abs(y) == F.lit(float("inf"))), F.raise_error(F.lit(f"a label in {label} is no number"))).otherwise(y)
    rows = train.select(vector_to_array(features).alias(_X), known.alias("y"), F.array(*[word(w * T.WORD) for w in range(words)]).alias("drawn"))
    return rows.mapInArrow(packed, "n int, bins binary, y binary, drawn binary")


class NodeFeatures:
    """The features that a tree's nodes draw, node after node: MLlib's generators and its reservoir."""

    def __init__(self, spark, n_features: int, share: float, seed: int):
        self.n, self.k = n_features, math.ceil(share * n_features)
        self.generator = spark._jvm.org.apache.spark.util.random.XORShiftRandom
        self.seeds = spark._jvm.java.util.Random(spark._jvm.java.lang.Long.parseLong(str(seed)))

    def __call__(self) -> list[int]:
        found = list(range(self.k))
        if self.k < self.n:
            rand = self.generator(self.seeds.nextLong())
            for f in range(self.k, self.n):
                at = int(rand.nextDouble() * (f + 1))
                if at < self.k:
                    found[at] = f
        return found


def _sampled_trees(table: DataFrame, cuts: list[list[float]], cfg: SampledConfig) -> list[T.Tree]:
    """The trees of all rounds, one job for each level of a tree."""
    spark = table.sparkSession
    sc = spark.sparkContext
    checkpoint_dir(spark)
    width, most = len(cuts), max(len(c) for c in cuts) + 1
    kind = np.uint8 if most <= 256 else np.uint16
    n_splits = np.array([len(c) for c in cuts])
    words, step = -(-cfg.trees // T.WORD), cfg.step

    def arrays(found) -> Iterator[T.Rows]:
        blocks = [(r["n"], np.frombuffer(r["bins"], kind).reshape(r["n"], width), np.frombuffer(r["y"], float),
                   np.frombuffer(r["drawn"], np.int64).reshape(r["n"], words)) for r in found]
        if blocks:
            n, bins, y, drawn = zip(*blocks)
            yield T.Rows(np.concatenate(bins), np.concatenate(y), np.concatenate(drawn), np.zeros(sum(n)))

    current = table.rdd.mapPartitions(arrays).persist(StorageLevel.MEMORY_AND_DISK)
    fitted: list[T.Tree] = []
    while len(fitted) < cfg.trees:
        block: list[T.Tree] = []
        for k in range(len(fitted), min(len(fitted) + (cfg.block if fitted else 1), cfg.trees)):       # the first tree weighs 1, not ``step``
            before, now, at_tree = [t.routes() for t in block], current, k
            pick = NodeFeatures(spark, width, cfg.columns, cfg.seed + k)
            block.append(T.grow(lambda routes, nodes: _added(now.map(lambda c: T.drawn_sums(c, at_tree, before, step, routes, nodes, most))), n_splits, cfg.depth, pick))
        weight = step if fitted else 1.0
        fitted += block
        if len(fitted) < cfg.trees:
            current = _with_margins(sc, current, [t.routes() for t in block], weight)
    _drop(sc, current)
    return fitted


def with_trees(spark, first: GBTRegressionModel, fitted: list[T.Tree], step: float, cuts: list[list[float]], first_is_mean: bool = True) -> GBTRegressionModel:
    """``first`` (one tree, the mean) with the fitted trees after it, or in its place: its saved copy with their nodes, loaded."""
    if not fitted:
        return first
    kept = int(first_is_mean)
    src, path = (scratch_path(spark, f"models/{uuid.uuid4().hex}") for _ in range(2))
    first.write().overwrite().save(src)
    meta = json.loads(spark.read.text(f"{src}/metadata").first()["value"])
    meta["numTrees"] = len(fitted) + kept
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    tree = spark.read.parquet(f"{src}/treesMetadata")
    _, of_tree, weight = tree.first()
    spark.createDataFrame([(0, of_tree, weight)] + [(k, of_tree, step) for k in range(1, len(fitted) + kept)], tree.schema).coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes = spark.read.parquet(f"{src}/data")
    more = spark.createDataFrame([(k, node) for k, t in enumerate(fitted, kept) for node in T.preorder(t, cuts)], nodes.schema)
    (nodes.unionByName(more) if kept else more).write.parquet(f"{path}/data")
    return GBTRegressionModel.load(path)


def split_gains(spark, model: GBTRegressionModel, names: list[str], path: str | None = None) -> DataFrame:
    """Feature, splits, total_gain, average_gain, importance, from the nodes of the saved model.

    A split's gain is what it takes off the squared error of the rows that
    reach it. ``average_gain`` is the mean over a feature's splits; the totals,
    as shares, are ``importance``. A feature without a split has zeros. The
    nodes are read as rows from ``path`` (a saved copy is made if none is given).
    """
    if path is None:
        path = scratch_path(spark, f"models/{uuid.uuid4().hex}")
        model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("nodeData.*")
    inner = nodes.where(F.col("leftChild") >= 0).select(F.col("split.featureIndex").alias("at"), (F.col("gain") * F.col("rawCount")).alias("gain"))
    found = inner.groupBy("at").agg(F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("total_gain"))
    names_frame = spark.createDataFrame(list(enumerate(names)), "at int, feature string")
    every = names_frame.join(found, "at", "left").select("feature", F.coalesce("splits", F.lit(0)).alias("splits"), F.coalesce("total_gain", F.lit(0.0)).alias("total_gain"))
    whole = F.sum("total_gain").over(Window.partitionBy())      # a row for each feature
    return every.select("feature", "splits", "total_gain", F.coalesce(F.try_divide("total_gain", "splits"), F.lit(0.0)).alias("average_gain"),
                        F.coalesce(F.try_divide(F.col("total_gain"), whole), F.lit(0.0)).alias("importance"))
