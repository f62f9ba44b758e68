"""L2 logistic regression on sparse rows, with its whole history.

MLlib divides every column by its deviation before it optimises. For TF-IDF rows,
whose rare terms vary little, that makes a well-conditioned problem an
ill-conditioned one: a thousand of its iterations don't get near the minimum.
Here the columns stay as they are.

Nothing of the model's size reaches the driver. Coordinates (the coefficients,
and the intercept as the last one) are cut into blocks, and a state of the optimiser
is a table with a row for each block: its point and gradient, and how they changed in
the last step. A step writes these four vectors only; the changes of the steps before
stay in their states' tables, held by block, and meet in a union that moves nothing. The rows are dealt
to parts; a part numbers the coordinates that its rows use. An evaluation of loss
and gradient is one Spark job: each block sends each part the coordinates that it
uses, each part sends their sums back, and each block adds them up, so what is sent
is at most an entry of the data, and much less where rows share terms. The driver
gets the dot products of the optimiser's vectors, a few hundred numbers a task, and
makes the next step of limited-memory BFGS with backtracking as weights of these
vectors. After a lost executor its tasks run again; the steps so far are written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import forget, ship_package, stored

#: Coordinates of a block; pairs of steps that the optimiser remembers; halvings of a step.
BLOCK, MEMORY, HALVINGS = 1 << 14, 10, 30
#: Entries of a part, at most and (while there are fewer parts than tasks at once) at least.
PART_MOST, PART_LEAST = 1 << 22, 1 << 16

_STATE = "block int, point binary, gradient binary, s binary, y binary, dots binary, largest double, loss double"


@dataclass
class LogisticFit:
    weights: DataFrame          # (at, coefficient), a written table
    intercept: float
    converged: bool
    # (iteration, objective, largest entry of the gradient, norm of the gradient)
    history: list[tuple[int, float, float, float]] = field(default_factory=list)

    @property
    def coefficients(self) -> np.ndarray:
        """All coefficients in the driver: for small models."""
        return np.array([r["coefficient"] for r in self.weights.orderBy("at").collect()], float)


@dataclass
class Dealt:
    """Rows by part with the coordinates renumbered, and which coordinates of a block each part uses."""

    table: DataFrame
    rows: DataFrame             # part, label, at, x
    wanted: DataFrame           # block, part, at
    parts: int

    def forget(self) -> None:
        self.rows.unpersist()
        self.wanted.unpersist()
        forget(self.table)


def held(df: DataFrame, parts: int, key: str) -> DataFrame:
    """The rows by ``key``, kept by the executors; ``df`` is read again after a loss."""
    return df.repartition(parts, key).sortWithinPartitions(key).persist(StorageLevel.MEMORY_AND_DISK)


def deal(data: DataFrame, size: int) -> Dealt:
    """Deal the rows to parts; every row gets the intercept's coordinate, ``size``, with a 1.

    A recomputed partition of ``data`` must give its rows in the same order, as a written table does.
    """
    width = BLOCK
    entries = data.agg(F.sum(F.size("indices") + 1)).first()[0] or 0
    at_once = data.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-entries // PART_MOST), min(at_once, -(-entries // PART_LEAST)), 1)

    def numbered(group: pa.Table) -> pa.Table:
        g = group.combine_chunks()
        indices, values = (g.column(c).combine_chunks() for c in ("indices", "values"))
        n, ends = len(g), np.append(0, np.cumsum(np.diff(indices.offsets.to_numpy())))
        at = np.insert(indices.flatten().to_numpy(), ends[1:], size)
        x = np.insert(values.flatten().to_numpy(), ends[1:], 1.0)
        ids, local = np.unique(at, return_inverse=True)
        ends = ends + np.arange(n + 1)
        blocks = np.unique(ids // width)
        cuts = np.append(np.searchsorted(ids, blocks * width), len(ids))
        local = local.astype(np.int32)
        wanted = [(ids[a:b] - k * width).astype(np.int32).tobytes() for k, a, b in zip(blocks, cuts, cuts[1:])]
        part = g.column("part")[0].as_py()
        return pa.table({
            "part": pa.array([part] * (n + len(blocks)), pa.int32()),
            "block": pa.array([None] * n + [int(k) for k in blocks], pa.int32()),
            "label": pa.array(g.column("label").to_pylist() + [None] * len(blocks), pa.float64()),
            "at": pa.array([local[a:b].tobytes() for a, b in zip(ends, ends[1:])] + wanted, pa.binary()),
            "x": pa.array([x[a:b].tobytes() for a, b in zip(ends, ends[1:])] + [None] * len(blocks), pa.binary())})

    ship_package(data.sparkSession)
    # by place, not by value: copies of a row go to different parts
    keyed = data.select(F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int").alias("part"), "label", "indices", "values")
    table = stored(keyed.groupBy("part").applyInArrow(numbered, "part int, block int, label double, at binary, x binary"), "dealt")
    return Dealt(table, held(table.where("block is null").select("part", "label", "at", "x"), parts, "part"),
                 held(table.where("block is not null").select("block", "part", "at"), parts, "block"), parts)


def _whole(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers of a binary column's rows, one after the other."""
    found = [np.zeros(0, kind)]
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        if len(chunk) and data is not None:
            ends = np.frombuffer(offsets, np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
            found.append(np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(kind))
    return np.concatenate(found)


def _its_point(block: pa.Table) -> np.ndarray:
    return np.frombuffer(block.column("point")[0].as_buffer())


def sums_by_part(dealt: Dealt, blocks: DataFrame, point: Callable[[pa.Table], np.ndarray] = _its_point) -> DataFrame:
    """(block, part, at, sums): each part's gradient of the summed log loss, by block; block -1: summed loss and rows.

    ``blocks`` has rows for each block, from which ``point`` gets the block's point.
    """
    def send(block: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(block) or not len(wanted):
            return pa.table({"part": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "at": pa.array([], pa.binary()), "point": pa.array([], pa.binary())})
        x, at = point(block), wanted.column("at").to_pylist()
        return pa.table({"part": wanted.column("part"), "block": wanted.column("block"), "at": pa.array(at, pa.binary()),
                         "point": pa.array([x[np.frombuffer(v, np.int32)].tobytes() for v in at], pa.binary())})

    def partial(rows: pa.Table, sent: pa.Table) -> pa.Table:
        sent = sent.sort_by("block")
        beta, y = _whole(sent.column("point"), float), rows.column("label").to_numpy()
        at, x = _whole(rows.column("at"), np.int32), _whole(rows.column("x"), float)
        row = np.repeat(np.arange(len(y)), pc.binary_length(rows.column("at")).to_numpy() // 4)
        z = np.bincount(row, weights=x * beta[at], minlength=len(y))
        with np.errstate(over="ignore"):
            missed = 1.0 / (1.0 + np.exp(-z)) - y
        gradient = np.bincount(at, weights=x * missed[row], minlength=len(beta))
        totals = np.array([np.logaddexp(0.0, z).sum() - (y * z).sum(), len(y)])
        part, wanted = rows.column("part")[0].as_py(), sent.column("at").to_pylist()
        cuts = np.append(0, np.cumsum([len(v) // 4 for v in wanted]))
        return pa.table({"block": pa.array([-1, *sent.column("block").to_pylist()], pa.int32()), "part": pa.array([part] * (len(wanted) + 1), pa.int32()),
                         "at": pa.array([None, *wanted], pa.binary()),
                         "sums": pa.array([totals.tobytes(), *(gradient[a:b].tobytes() for a, b in zip(cuts, cuts[1:]))], pa.binary())})

    sent = blocks.groupBy("block").cogroup(dealt.wanted.groupBy("block")).applyInArrow(send, "part int, block int, at binary, point binary")
    return dealt.rows.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(partial, "block int, part int, at binary, sums binary")


def _added(sums: pa.Table, length: int) -> np.ndarray:
    total, sums = np.zeros(length), sums.sort_by("part")
    for at, v in zip(sums.column("at"), sums.column("sums")):
        total[np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(v.as_buffer())
    return total


def _points(spark: SparkSession, blocks: list[bytes]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(blocks)), "block int, point binary")


def loss_and_gradient(data: DataFrame, size: int, coefficients: np.ndarray, intercept: float) -> tuple[float, np.ndarray, float, int]:
    """Sum of the log losses, their gradient by coefficient and by intercept, and the number of rows; for small models.

    ``data`` has ``label`` (0 or 1) and a row's entries as ``indices`` (below ``size``) and ``values``.
    """
    point, width = np.append(coefficients, intercept), BLOCK
    dealt = deal(data, size)
    found = sums_by_part(dealt, _points(data.sparkSession, [point[k:k + width].tobytes() for k in range(0, size + 1, width)])).toArrow()
    dealt.forget()
    blocks = np.array(found.column("block").to_pylist(), int)
    totals = sum((np.frombuffer(v.as_buffer()) for v in found.filter(pa.array(blocks == -1)).column("sums")), np.zeros(2))
    g = np.concatenate([_added(found.filter(pa.array(blocks == k // width)), min(width, size + 1 - k)) for k in range(0, size + 1, width)])
    return float(totals[0]), g[:-1], float(g[-1]), int(totals[1])


def direction(dots: np.ndarray, pairs: int) -> np.ndarray:
    """The quasi-Newton step as weights of the changes of point, those of the gradient, and the gradient (two-loop recursion).

    ``dots`` are these vectors' dot products.
    """
    q, weights = np.zeros(2 * pairs + 1), []
    q[-1] = 1.0
    for i in reversed(range(pairs)):
        weights.append((dots[i] @ q) / dots[pairs + i, i])
        q[pairs + i] -= weights[-1]
    if pairs:
        q *= dots[pairs - 1, 2 * pairs - 1] / dots[2 * pairs - 1, 2 * pairs - 1]
    for i, w in zip(range(pairs), reversed(weights)):
        q[i] += w - (dots[pairs + i] @ q) / dots[pairs + i, i]
    return -q


@dataclass
class _Step:
    """A written state of the optimiser, and what the driver knows of it."""

    state: DataFrame
    value: float
    largest: float
    dots: np.ndarray        # of the changes of point, of the gradient, and the gradient
    pairs: list[int]        # which pairs are in use

    @property
    def norm(self) -> float:
        return float(np.sqrt(self.dots[-1, -1]))

    def in_use(self) -> np.ndarray:
        """The dot products of the pairs in use and the gradient."""
        n = (len(self.dots) - 1) // 2
        chosen = [*self.pairs, *(n + p for p in self.pairs), 2 * n]
        return self.dots[np.ix_(chosen, chosen)]


def _evaluated(dealt: Dealt, at: DataFrame, changes: list[DataFrame], weights: np.ndarray | None, n: int, size: int, reg: float) -> _Step:
    """The state after a move by ``weights`` of the vectors in use; without weights at the state's own point.

    ``at`` has the point and gradient of each block, ``changes`` those of the pairs in use, all by ``by_block``.
    """
    width = BLOCK
    blocks = reduce(DataFrame.unionAll, [frame.withColumn("nth", F.lit(k)) for k, frame in enumerate([*changes, at])])

    def vectors_of(block: pa.Table) -> tuple[list, list]:
        """The changes of point and the point; the changes of gradient and the gradient (None at first)."""
        block = block.sort_by("nth")
        return tuple([None if v.as_buffer() is None else np.frombuffer(v.as_buffer()) for v in block.column(c)] for c in ("of_point", "of_gradient"))

    def moved(block: pa.Table) -> np.ndarray:
        (*s, x), (*y, g) = vectors_of(block)
        if weights is not None:
            for w, v in zip(weights, [*s, *y, g]):
                x = x + w * v
        return x

    def updated(block: pa.Table, sums: pa.Table) -> pa.Table:
        k = (block if len(block) else sums).column("block")[0].as_py()
        row = dict.fromkeys(["point", "gradient", "s", "y", "dots", "largest", "loss"])
        if k < 0:
            row["loss"] = sum(np.frombuffer(v.as_buffer())[0] for v in sums.sort_by("part").column("sums"))
        else:
            x = moved(block)
            penalty = reg * x
            if k == size // width:
                penalty[-1] = 0.0           # the intercept
            g = _added(sums, len(x)) / n + penalty
            (*s, before), (*y, gradient) = vectors_of(block)
            if weights is not None:
                s, y = [*s, x - before], [*y, g - gradient]
                row |= {"s": s[-1].tobytes(), "y": y[-1].tobytes()}
            vectors = np.stack([*s, *y, g])
            squares = float(x @ x - (x[-1] ** 2 if k == size // width else 0.0))
            row |= {"point": x.tobytes(), "gradient": g.tobytes(), "dots": (vectors @ vectors.T).tobytes(), "largest": float(np.abs(g).max()), "loss": squares}
        kinds = dict.fromkeys(["point", "gradient", "s", "y", "dots"], pa.binary())
        return pa.table({"block": pa.array([k], pa.int32()), **{c: pa.array([v], kinds.get(c, pa.float64())) for c, v in row.items()}})

    sums = sums_by_part(dealt, blocks, moved)
    new = stored(blocks.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(updated, _STATE), "optimiser", "none")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["block"])
        if not rows:
            return
        of_blocks = [r for r in rows if r["block"] >= 0]
        yield pa.RecordBatch.from_pylist([{
            "block": rows[0]["block"], "dots": sum(np.frombuffer(r["dots"]) for r in of_blocks).tobytes() if of_blocks else None,
            "largest": max((r["largest"] for r in of_blocks), default=0.0), "loss": sum(r["loss"] for r in rows if r["block"] < 0),
            "squares": sum(r["loss"] for r in of_blocks)}], pa.schema([("block", pa.int32()), ("dots", pa.binary()), ("largest", pa.float64()), ("loss", pa.float64()), ("squares", pa.float64())]))

    # a row for each task
    figures = sorted(new.select("block", "dots", "largest", "loss").mapInArrow(summed, "block int, dots binary, largest double, loss double, squares double").collect(), key=lambda r: r["block"])
    dots = sum(np.frombuffer(bytes(r["dots"])) for r in figures if r["dots"] is not None)
    side = int(round(np.sqrt(len(dots))))
    value = sum(r["loss"] for r in figures) / n + reg / 2 * sum(r["squares"] for r in figures)
    return _Step(new, float(value), max(r["largest"] for r in figures), dots.reshape(side, side), list(range((side - 1) // 2)))


def fit_logistic(data: DataFrame, size: int, reg: float, tolerance: float, max_iter: int) -> LogisticFit:
    """Minimise mean log loss + ``reg`` / 2 * sum of squared coefficients; the intercept is free.

    Limited-memory BFGS until no entry of the gradient is larger than ``tolerance``, or ``max_iter`` is used up.
    """
    n, spark, width = data.count(), data.sparkSession, BLOCK
    if not n:
        raise ValueError("no rows to fit")
    dealt = deal(data, size)

    def zeros(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "point": pa.array([bytes(8 * min(width, size + 1 - k * width))], pa.binary())})

    def by_block(state: DataFrame, of_point: str, of_gradient: str) -> DataFrame:
        vectors = state.where("block >= 0").select("block", F.col(of_point).alias("of_point"), F.col(of_gradient).alias("of_gradient"))
        return held(vectors, dealt.parts, "block")

    start = spark.range(size // width + 1).mapInArrow(zeros, "block int, point binary").withColumn("gradient", F.lit(None).cast("binary"))
    at, changes, written = by_block(start, "point", "gradient"), [], []
    now = _evaluated(dealt, at, [], None, n, size, reg)
    at.unpersist()
    at = by_block(now.state, "point", "gradient")
    history = [(0, now.value, now.largest, now.norm)]
    for iteration in range(1, max_iter + 1):
        if now.largest <= tolerance:
            break
        dots = now.in_use()
        d = direction(dots, len(now.pairs))
        slope = float(d @ dots[-1])
        if slope >= 0:
            for _, change in changes:
                change.unpersist()
            changes, now.pairs, d = [], [], np.array([-1.0])
            slope = -float(dots[-1, -1])
        step = 1.0 if now.pairs else min(1.0, 1.0 / now.norm) if now.norm > 1 else 1.0
        for _ in range(HALVINGS):
            new = _evaluated(dealt, at, [change for _, change in changes], step * d, n, size, reg)
            if new.value <= now.value + 1e-4 * step * slope:
                break
            forget(new.state)
            step /= 2
        else:
            break                                   # no smaller value in reach of a double
        last, m = len(new.pairs) - 1, len(new.pairs)
        if new.dots[last, m + last] > 1e-12 * new.dots[m + last, m + last]:
            new.pairs = new.pairs[-MEMORY:]
            changes.append((new.state, by_block(new.state, "s", "y")))
        else:
            new.pairs = new.pairs[:-1]
        at.unpersist()
        for _, change in changes[:-MEMORY]:
            change.unpersist()
        changes, written = changes[-MEMORY:], [*written, now.state]
        now, at = new, by_block(new.state, "point", "gradient")
        in_use = [state for state, _ in changes]
        for state in written:
            if not any(state is other for other in in_use):
                forget(state)
        written = [state for state in written if any(state is other for other in in_use)]
        history.append((iteration, now.value, now.largest, now.norm))
    dealt.forget()
    for frame in [at, *(change for _, change in changes)]:
        frame.unpersist()

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, v in zip(b.column("block").to_pylist(), b.column("point")):
                x = np.frombuffer(v.as_buffer())
                yield pa.RecordBatch.from_pydict({"at": np.arange(k * width, k * width + len(x)), "coefficient": x})

    points = now.state.where("block >= 0").select("block", "point").mapInArrow(entries, "at long, coefficient double")
    kept = stored(points, "coefficients")
    for state in [*written, now.state]:
        forget(state)
    intercept = kept.where(F.col("at") == size).first()["coefficient"]
    return LogisticFit(kept.where(F.col("at") < size), float(intercept), history[-1][2] <= tolerance, history)
