"""Operator 12: spelling variants of frequent words, by dense prefix-suffix tiles.

Two words differ by one inserted, deleted or replaced code point exactly if their
common prefix and common suffix together reach the longer length minus one. Then
one of the two reaches half of that. So a word of length l takes part, for
longer length m = l and m = l + 1, under its first and under its last
ceil((m - 1) / 2) code points, and only words under one such key are compared.

Words under a key stand in a matrix of code points, padded to one width, and
blocks of rows are compared with each other: equality by position, forward for
prefixes and, on matrices padded on the left, backward for suffixes. Small keys
share a matrix. A key with more words than ``tile`` is split into blocks by a
hash, and each pair of blocks is a group of its own, so no group holds more than
about two blocks, however many words share a key. Pairs are never rows: a group returns, for each
of its words, how many near words it found and the best of them.

A pair that both halves find is counted under the prefix.

Defined results: a null text is empty; a null id is spelled as nothing (the
digest is taken of ``:word``); rows with equal ids and texts all count; words in
code-point order settle ties; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .base import shuffle_parts, texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word whose digest this divides loses a code point.
DROP_EVERY = 199
#: Rows of a block, distinct words that a task counts before it hands them on, cells compared at once.
TILE, FLUSH, CELLS = 1024, 200_000, 1 << 21
#: A text longer than this is read word by word instead of as one list.
LIST_CHARS = 1 << 20


def word_counts(docs: DataFrame, least_chars: int, drop_every: int = DROP_EVERY) -> DataFrame:
    """word, n of all texts: maximal runs of letters, A-Z in lower case, some with one code point less.

    Runs that are too short can only get shorter, so they are never looked at.
    """
    runs = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % max(1, least_chars))
    lower = str.maketrans(UPPER, LOWER)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py().translate(lower)
                found = Counter(runs.findall(text) if len(text) <= LIST_CHARS else (m.group() for m in runs.finditer(text)))
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in found.items():
                    digest = zlib.crc32(word.encode(), start)
                    if drop_every and digest % drop_every == 0:
                        at = digest % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least_chars:
                            continue
                    total[word] += n
                if len(total) >= FLUSH:
                    yield out()
        yield out()

    each = docs.select("doc_id", "text").mapInArrow(counts, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def keyed(words: DataFrame) -> DataFrame:
    """word, n, longer, side, half: the four keys of each word; halves of less than one code point can't be."""
    length = F.char_length("word")
    kinds = [(longer, side) for longer in (length, length + 1) for side in ("prefix", "suffix")]

    def half(longer: Column, side: str) -> Column:
        n = F.floor(longer / 2).cast("int")                      # ceil((longer - 1) / 2)
        return F.left("word", n) if side == "prefix" else F.right("word", n)

    keys = F.array(*[F.struct(m.alias("longer"), F.lit(s).alias("side"), F.xxhash64(half(m, s)).alias("half")) for m, s in kinds])
    return words.select("word", "n", F.explode(keys).alias("k")).select("word", "n", "k.*")


def tiles(words: DataFrame, tile: int) -> DataFrame:
    """word, n, longer, side, half, a, b, block: each word with its block, once for every pair (a, b) of blocks it is in.

    Keys of up to ``tile`` words share tiles: of every longer length there are as
    many of these as ``tile`` goes into all words, and the comparison itself tells
    their halves apart. A key beyond that has its own, and more blocks the more
    words it has.
    """
    keys = keyed(words)
    shares = max(1, -(-words.count() // tile))
    sizes = keys.groupBy("longer", "side", "half").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > tile)
    dealt = keys.join(sizes, ["longer", "side", "half"], "left")
    crowded = F.col("size").isNotNull()
    blocks = F.when(crowded, F.ceil(F.col("size") / tile).cast("int")).otherwise(1)
    dealt = dealt.select("word", "n", "longer", "side", crowded.alias("crowded"), blocks.alias("blocks"),
                         F.when(crowded, F.col("half")).otherwise(F.pmod(F.col("half"), F.lit(shares))).alias("half"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("word", "n", "longer", "side", "half", "crowded", F.least("block", "other").alias("a"),
                        F.greatest("block", "other").alias("b"), "block")


def code_points(words: list[str], width: int, right: bool) -> np.ndarray:
    """Words as rows of code points, padded with zeros at the right (or the left) to ``width``."""
    pad = (lambda w: w.rjust(width, "\0")) if right else (lambda w: w.ljust(width, "\0"))
    flat = "".join(map(pad, words)).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(flat, dtype=np.uint32).reshape(len(words), width)


def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many leading columns each row of ``x`` has in common with each row of ``y``."""
    return np.logical_and.accumulate(x[:, None, :] == y[None, :, :], axis=2).sum(axis=2, dtype=np.int32)


def near_pairs(left: list[str], right: list[str], longer: int, side: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ``left``, rows of ``right``) of the near pairs whose longer word has ``longer`` code points, tile by tile."""
    half, size = longer // 2, np.array([len(w) for w in right])
    fore, back = code_points(right, longer, False), code_points(right, longer, True)[:, ::-1]
    step = max(1, CELLS // max(1, longer))
    rows = max(1, min(len(left), int(step ** 0.5)))
    cols = max(1, step // rows)
    for i in range(0, len(left), rows):
        part = left[i:i + rows]
        own = np.array([len(w) for w in part])
        f, b = code_points(part, longer, False), code_points(part, longer, True)[:, ::-1]
        for j in range(0, len(right), cols):
            other = size[j:j + cols]
            short = np.minimum(own[:, None], other[None, :])
            # padding equals padding behind two words of one length: no word has more in common than the shorter has
            before = np.minimum(shared(f, fore[j:j + cols]), short)
            after = np.minimum(shared(b, back[j:j + cols]), short)
            near = (before + after >= longer - 1) & (short >= longer - 1) & (np.maximum(own[:, None], other[None, :]) == longer)
            near &= ~((before == longer) & (short == longer))            # the word itself
            near &= (before >= half) if side == "prefix" else (after >= half) & (before < half)
            at = np.nonzero(near)
            if len(at[0]):
                yield at[0] + i, at[1] + j


def tile_results(table: pa.Table) -> pa.Table:
    """word, n_near, form_n, form of one pair of blocks: how many near words, and the best of them."""
    words, ns = table.column("word").to_pylist(), table.column("n").to_pylist()
    block, longer, side = table.column("block").to_pylist(), table.column("longer")[0].as_py(), table.column("side")[0].as_py()
    a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
    first = [k for k, x in enumerate(block) if x == a]
    second = first if a == b else [k for k, x in enumerate(block) if x == b]
    count: Counter = Counter()
    best: dict[int, tuple[int, str]] = {}

    def meet(x: int, y: int) -> None:
        count[x] += 1
        rank = (-ns[y], words[y])
        if x not in best or rank < best[x]:
            best[x] = rank

    for left, right in near_pairs([words[k] for k in first], [words[k] for k in second], longer, side):
        for i, j in zip(left.tolist(), right.tolist()):
            meet(first[i], second[j])
            if a != b:                                                   # within one block each pair comes up both ways
                meet(second[j], first[i])
    found = sorted(count)
    return pa.table({"word": pa.array([words[k] for k in found], pa.string()), "n_near": pa.array([count[k] for k in found], pa.int64()),
                     "form_n": pa.array([-best[k][0] for k in found], pa.int64()), "form": pa.array([best[k][1] for k in found], pa.string())})


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n_near, form, form_n for every row of (word, n) that has a near word."""
    keys = ["longer", "side", "half", "crowded", "a", "b"]
    # few bytes, much work: tasks are not put together by size
    dealt = tiles(words, tile).repartition(shuffle_parts(words.sparkSession), *keys)
    found = (dealt.groupBy(*keys)
             .applyInArrow(tile_results, "word string, n_near long, form_n long, form string"))
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")))


def variant_groups(df: DataFrame, least_chars: int = 6, least_count: int = 5, ratio: int = 5, drop_every: int = DROP_EVERY,
                   tile: int = TILE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word of the texts.

    ``form`` is the near word with the largest count, if that is ``ratio`` times
    the word's own. A step to a form multiplies the count, so the way to the root
    has at most ``log(largest count, ratio)`` steps; doubling the steps finds it
    in the logarithm of that many joins.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2: forms must be more frequent than their variants")
    words = stored(word_counts(texts(df, doc_id, text), least_chars, drop_every).where(F.col("n") >= least_count), "words")
    near = near_words(words, tile)
    whole = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        *[F.when(F.col("form_n") >= ratio * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")])
    whole = stored(whole, "forms")
    roots = whole.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                             F.col("next").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return (whole.join(roots.select("word", "root"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
