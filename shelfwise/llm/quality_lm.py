"""Operator 4: quality classifier by an interpolated modified Kneser-Ney n-gram model.

Characters are the units, three the order. The model is trained on trusted text: all documents whose
labels say good quality and not toxic, but for a fifth of them that is held out. A document's
perplexity is compared with quantiles of the held-out trusted documents of its language.

No count table is sent to all tasks, and no document-gram pairs are shuffled. Texts are dealt to
buckets of a bounded size, and what is joined are a bucket's distinct grams:

1. Each bucket counts its grams, in trusted text and at all: rows (bucket, gram, count).
2. The counts are summed by gram, and the model is computed from them by joins of the gram, context
   and continuation counts, all dealt by hash: one log-probability for each gram that any text has.
3. These are joined to the buckets' rows of 1 and go back to the buckets, where every text is scored.

So what moves is the packed text, twice, and a few rows for each bucket and distinct gram.
"""

from __future__ import annotations

import hashlib
import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import shuffle_parts, stored, sub_batches, texts

#: Marks before the first and after the last character; no text has them.
BEGIN, END = 0x110000, 0x110001
BITS = 21
#: Bytes of text in a bucket. Their number follows the input alone: a bucket's grams are joined once for each bucket.
BUCKET = 8 << 20
SLICE = 1 << 20
#: Most entries of a table that is indexed by three characters' numbers; with more characters grams are sorted.
DENSE = 1 << 23
UNSEEN = 1 << 17  # characters that might be: the order below the first gives each the same share
BINS = 1000  # of the log-perplexity, for one unit
#: Without bad labels, of the distance between the quantiles: added on both sides, and times the root of one over the number of documents.
ALLOWANCE, FEW = 0.1, 4.0
#: Shares of the held-out trusted rows that a bound may cut off; which one, for all languages, the labels say. 0 is no bound.
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1, 0.15, 0.2)
#: A language's quantile is drawn to that of all languages as if by so many more rows.
PRIOR = 20
MOST_BINS = 30 * BINS  # a log-perplexity over 30 is out of any bounds


def place(doc_id: Column, text: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(doc_id, F.xxhash64(text))), F.lit(buckets))


def packed(docs: DataFrame, buckets: int) -> DataFrame:
    """``bucket, blob``: the rows of each bucket, put together and compressed before the shuffle."""
    names = ["doc_id", "lang", "text"]

    def run(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            size = b.column("n").to_numpy()
            for part in sub_batches(size.tolist(), 8 << 20):
                rows = b.slice(part.start, part.stop - part.start)
                to = rows.column("bucket").to_numpy()
                order = np.argsort(to, kind="stable")
                at = np.flatnonzero(np.concatenate([[True], to[order][1:] != to[order][:-1]]))
                ids, blobs = [], []
                for s, e in zip(at, np.append(at[1:], len(order))):
                    own = pa.RecordBatch.from_arrays([rows.column(n) for n in names], names).take(pa.array(order[s:e]))
                    sink = io.BytesIO()
                    with pa.ipc.new_stream(sink, own.schema) as w:
                        w.write_batch(own)
                    ids.append(int(to[order[s]]))
                    blobs.append(squeeze.compress(sink.getvalue()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return (docs.select("doc_id", "lang", "text", F.octet_length("text").cast("long").alias("n"), place(F.col("doc_id"), F.col("text"), buckets).alias("bucket"))
            .mapInArrow(run, "bucket long, blob binary"))


def unpacked(table: pa.Table) -> pa.Table:
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    parts = [pa.ipc.open_stream(open_.decompress(x)).read_all() for x in table.column("blob").to_pylist()]
    return pa.concat_tables(parts) if parts else pa.table({"doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "text": pa.array([], pa.string())})


class Grams:
    """The grams of some texts, or slices of texts; equal grams have equal numbers in ``code``.

    ``heads``: the two characters before each slice (the begin mark before a text); ``ends``: whether
    the text ends with it.
    """

    def __init__(self, values: list[str], heads: list[tuple[int, int]] | None = None, ends: list[bool] | None = None):
        length = np.array([len(t) for t in values], np.int64)
        heads = np.array([(BEGIN, BEGIN)] * len(values) if heads is None else heads, np.uint32).reshape(-1, 2)
        ends = np.ones(len(values), bool) if ends is None else np.array(ends, bool)
        c = np.frombuffer("".join(values).encode("utf-32-le"), "<u4")
        first = np.cumsum(length) - length
        keep = np.column_stack([np.ones((len(values), 2), bool), ends]).ravel()
        spots = np.column_stack([first, first, first + length]).ravel()[keep]
        marks = np.column_stack([heads, np.full(len(values), END, np.uint32)]).ravel()[keep]
        c = np.insert(c, spots, marks) if len(values) else c
        total = length + 2 + ends
        own = np.repeat(np.arange(len(values)), total)
        ok = np.arange(len(c)) - np.repeat(np.cumsum(total) - total, total) >= 2  # all but the two before a slice are predicted
        self.slice = own[ok]
        ok = ok[2:]
        self.alphabet = np.flatnonzero(np.bincount(c, minlength=1)) if len(c) else np.zeros(0, np.int64)
        n = len(self.alphabet)
        if n ** 3 <= DENSE:
            number = np.zeros(END + 1, np.int32)
            number[self.alphabet] = np.arange(n)
            x = number[c]
            self.code = ((x[:-2] * n + x[1:-1]) * n + x[2:])[ok]
            self.dense = True
        else:
            x = c.astype(np.int64)
            self.code = ((x[:-2] << 2 * BITS) | (x[1:-1] << BITS) | x[2:])[ok]
            self.dense = False

    def grams(self, code: np.ndarray) -> np.ndarray:
        """The grams' own keys: three characters of ``BITS`` bits."""
        if not self.dense:
            return code
        n, a = len(self.alphabet), self.alphabet.astype(np.int64)
        return (a[code // (n * n)] << 2 * BITS) | (a[code // n % n] << BITS) | a[code % n]

    def counts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All grams, and how often each is in chosen slices."""
        take = chosen[self.slice]
        if self.dense:
            size = len(self.alphabet) ** 3
            every = np.flatnonzero(np.bincount(self.code, minlength=size))
            return self.grams(every), np.bincount(self.code[take], minlength=size)[every]
        every, at = np.unique(self.code, return_inverse=True)
        return every, np.bincount(at[take], minlength=len(every))

    def sums(self, gram: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Of each of n slices, the sum of its grams' values; ``gram`` is sorted and has them all."""
        if self.dense:
            every = np.flatnonzero(np.bincount(self.code, minlength=1))
            table = np.zeros(int(every[-1]) + 1 if len(every) else 1)
            table[every] = value[np.searchsorted(gram, self.grams(every))]
            return np.bincount(self.slice, table[self.code], n)
        return np.bincount(self.slice, value[np.searchsorted(gram, self.code)], n)


def sliced(values: list[str]):
    """Groups of slices of the texts, with what ``Grams`` wants of them, and each slice's text: a long text is worked on in pieces."""
    slices, heads, ends, of = [], [], [], []
    for k, t in enumerate(values):
        for at in range(0, max(len(t), 1), SLICE):
            slices.append(t[at:at + SLICE])
            heads.append((ord(t[at - 2]) if at > 1 else BEGIN, ord(t[at - 1])) if at else (BEGIN, BEGIN))
            ends.append(at + SLICE >= len(t))
            of.append(k)
    for part in sub_batches([len(t) for t in slices], 2 * SLICE):
        yield Grams(slices[part], heads[part], ends[part]), np.array(of[part])


def bucket_counts(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of a bucket: its grams, and how often each is in its trusted documents."""
    docs = unpacked(left)
    trusted = set(right.column("doc_id").to_pylist())
    ids, values = docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()
    grams, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    chosen = np.array([d in trusted for d in ids], bool)
    for found, of in sliced(values):
        g, n = found.counts(chosen[of])
        grams.append(g)
        counts.append(n)
    every, at = np.unique(np.concatenate(grams), return_inverse=True)
    n = np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)
    bucket = left.column("bucket")[0].as_py() if left.num_rows else 0
    return pa.table({"bucket": pa.array(np.full(len(every), bucket, np.int64)), "gram": pa.array(every.astype(np.int64)), "n": pa.array(n)})


def bucket_scores(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of a bucket: each document's number of predicted characters and negative log-likelihood."""
    docs = unpacked(left)
    gram, value = right.column("gram").to_numpy(), right.column("logp").to_numpy()
    order = np.argsort(gram)
    gram, value = gram[order], value[order]
    values = docs.column("text").to_pylist()
    n, total = np.array([len(t) for t in values], np.int64), np.zeros(len(values))
    for found, of in sliced(values):
        np.add.at(total, of, -found.sums(gram, value, len(of)))
    keys = [hashlib.md5(t.encode()).digest() for t in values]
    return pa.table({"doc_id": docs.column("doc_id").cast(pa.int64()), "key": pa.array(keys, pa.binary()), "lang": docs.column("lang").cast(pa.string()),
                     "n_chars": pa.array(n), "nll": pa.array(total)})


def discounts(counts: DataFrame, n: str) -> list[float]:
    """The three discounts of modified Kneser-Ney from the counts of counts (four numbers)."""
    r = counts.agg(*[F.coalesce(F.sum((F.col(n) == k).cast("long")), F.lit(0)).alias(f"n{k}") for k in range(1, 5)]).first()
    if not r["n1"] or not r["n2"]:
        return [0.5, 0.5, 0.5]
    y = r["n1"] / (r["n1"] + 2 * r["n2"])
    out = []
    for k in (1, 2, 3):
        a, b = r[f"n{k}"], r[f"n{k + 1}"]
        out.append(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) if a else 0.5)
    return out


def level(counts: DataFrame, key: str, context: str, n: str, below: DataFrame, to: str) -> DataFrame:
    """One order of the model.

    ``counts``: all grams of the order as ``key`` with ``context`` (what is before the last
    character), ``to`` (what the order below calls them) and the count ``n``, zero if unseen.
    ``below``: ``to, p`` of the order below. Returns ``key, p``.
    """
    d = discounts(counts, n)
    taken = F.when(F.col(n) == 0, 0.0).when(F.col(n) == 1, d[0]).when(F.col(n) == 2, d[1]).otherwise(d[2])
    contexts = counts.groupBy(context).agg(F.sum(n).alias("total"), F.sum(taken).alias("saved"))
    return (counts.join(contexts, context).join(below, to)
            .select(key, F.when(F.col("total") > 0, (F.col(n) - taken + F.col("saved") * F.col("p")) / F.col("total")).otherwise(F.col("p")).alias("p")))


def log_probabilities(counts: DataFrame) -> DataFrame:
    """``gram, logp`` for all grams of ``gram, n`` by interpolated modified Kneser-Ney smoothing.

    Lower orders count in how many contexts a gram was seen, not how often.
    """
    low = (1 << BITS) - 1
    three = counts.select("gram", "n", F.shiftright("gram", BITS).alias("ab"), F.col("gram").bitwiseAND((1 << 2 * BITS) - 1).alias("bc"))
    two = three.groupBy("bc").agg(F.sum((F.col("n") > 0).cast("long")).alias("n")).select(
        "bc", "n", F.shiftright("bc", BITS).alias("b"), F.col("bc").bitwiseAND(low).alias("c"))
    two = stored(two, "bigrams")
    one = two.groupBy("c").agg(F.sum((F.col("n") > 0).cast("long")).alias("n")).select("c", "n", F.lit(0).alias("none"), F.lit(0).alias("nothing"))
    one = stored(one, "characters")
    base = one.select("nothing").distinct().withColumn("p", F.lit(1.0 / UNSEEN))
    p1 = level(one, "c", "none", "n", base, "nothing")
    p2 = level(two, "bc", "b", "n", p1, "c")
    return level(three, "gram", "ab", "n", p2, "bc").select("gram", F.log("p").alias("logp"))


def perplexities(df: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, key, lang, n_chars, nll`` of every text under the model of the ``trusted`` ids' texts; ``key`` is the text's MD5."""
    docs = texts(df, doc_id, text, lang=F.coalesce(F.col(lang).cast("string"), F.lit("")))
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = total // BUCKET + 1
    ids = trusted.select("doc_id").where("doc_id is not null").distinct()
    ids = ids.select("doc_id", place(F.col("doc_id"), F.lit(""), buckets).alias("bucket"))
    seen = stored(packed(docs, buckets).groupBy("bucket").cogroup(ids.groupBy("bucket"))
                  .applyInArrow(bucket_counts, "bucket long, gram long, n long"), "grams")
    counts = stored(seen.groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts")
    back = seen.select("bucket", "gram").join(log_probabilities(counts), "gram")
    return packed(docs, buckets).groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(
        bucket_scores, "doc_id long, key binary, lang string, n_chars long, nll double")


def classify(df: DataFrame, labels: DataFrame, upper: float = 0.999, lower: float = 0.001, settle: float = 60.0, held_out: int = 5,
             doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """``doc_id, key, lang, n_chars, perplexity, low, high, kept`` for each input row; ``key`` is the MD5 of its text.

    Kept is a document whose perplexity lies within its language's bounds: above is noise, below is
    the same again and again. Bounds are quantiles of the language's held-out trusted documents. Which
    quantiles, the same for all languages, the labels say: those with the least share of held-out
    trusted documents outside and of bad ones inside (``LEVELS``; a side on which no quantile tells
    them apart has no bound). Few documents say little about a quantile, so a language's is drawn to
    that of all languages, as if by ``PRIOR`` more. Without bad labels the quantiles are ``lower`` and
    ``upper``, widened. Each
    log-perplexity is first drawn to the mean of all trusted ones as by ``settle`` characters more,
    so that a few characters say little. Languages without held-out trusted documents take the
    quantiles of all; without any, everything is kept. A null or empty text is scored by its end mark
    alone. Null languages are one language; null ids and repeated rows are scored like others; labels
    without an id are left out, several for one id trust it only if all do. Ties with a bound are
    kept. Other columns are not read; an empty table gives an empty one.
    """
    known = (labels.select(F.col(doc_id).cast("long").alias("doc_id"), ((F.col(quality) >= 1) & (F.coalesce(F.col(toxic), F.lit(0)) < 1)).alias("good"))
             .where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("good", F.lit(False))).alias("good")).where("good").select("doc_id"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(held_out)) == 0
    scores = stored(perplexities(df, known.where(~held), doc_id, text, lang), "perplexities")
    mine = scores.join(known.where(held), "doc_id", "left_semi")
    mean = mine.agg((F.sum("nll") / F.sum(F.col("n_chars") + 1)).alias("m")).first()["m"]
    if mean is None:
        return scores.select("doc_id", "key", "lang", "n_chars", F.exp(F.col("nll") / (F.col("n_chars") + 1)).alias("perplexity"),
                             F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(True).alias("kept"))
    score = (F.col("nll") + settle * mean) / (F.col("n_chars") + 1 + settle)
    bins = mine.select("lang", F.least(F.floor(score * BINS), F.lit(MOST_BINS)).alias("bin"))
    bad = (labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(quality).alias("quality")).where("doc_id is not null")
           .groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality < 1").select("doc_id"))
    bad = scores.join(bad, "doc_id", "left_semi").select("lang", F.least(F.floor(score * BINS), F.lit(MOST_BINS)).alias("bin"))
    counts = stored(counted(bins, bad), "bins")
    if counts.where("bad > 0").isEmpty():
        of_lang, (low, high) = bounds(bins, lower, upper)
    else:
        (highs, high), (lows, low) = calibrated(counts, below=False), calibrated(counts, below=True)
        of_lang = highs.withColumnRenamed("bound", "high").join(lows.withColumnRenamed("bound", "low"), "lang")
    # a language may hold most documents: its rows are dealt over all tasks, and its bounds go with each part
    parts = shuffle_parts(df.sparkSession)
    of_lang = of_lang.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return (scores.withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).cast("int")).join(of_lang, ["lang", "part"], "left")
            .select("doc_id", "key", "lang", "n_chars", F.exp(F.col("nll") / (F.col("n_chars") + 1)).alias("perplexity"),
                    (F.coalesce("low", F.lit(low).cast("double")) / BINS).alias("low"), (F.coalesce("high", F.lit(high).cast("double")) / BINS).alias("high"), score.alias("score"))
            .select("doc_id", "key", "lang", "n_chars", "perplexity", F.exp("low").alias("low"), F.exp("high").alias("high"),
                    F.col("score").between(F.col("low"), F.col("high")).alias("kept")))


def counted(good: DataFrame, bad: DataFrame) -> DataFrame:
    """``lang, bin, good, bad``: how many held-out trusted and bad rows. A language is ``MOST_BINS`` rows at most, whatever it holds."""
    return (good.select("lang", "bin", F.lit(1).alias("good")).union(bad.select("lang", "bin", F.lit(0)))
            .groupBy("lang", "bin").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")))


def quantile(counts: list[tuple[int, int]], share: float) -> int:
    """The first bin up to which at least ``share`` of the rows lie; ``counts`` are bins and rows, in order."""
    total, under = sum(n for _, n in counts), 0
    for bin_, n in counts:
        under += n
        if n and under >= share * total:
            return bin_
    return counts[-1][0]


def calibrated(counts: DataFrame, below: bool) -> tuple[DataFrame, float]:
    """``lang, bound`` in bins, and the bound of all languages: quantiles at the level that tells good rows from bad ones best.

    ``counts`` are those of ``counted``, with good and bad rows. A level is the share of good rows that
    it cuts off below (or above) its bound. What counts is the share of bad rows beyond the bound less
    that of good ones; of equal levels the least cuts.
    """
    whole = sorted((r["bin"], r["good"], r["bad"]) for r in counts.groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect())
    n_good, n_bad = sum(x[1] for x in whole), sum(x[2] for x in whole)
    none = -math.inf if below else math.inf
    # an upper bound is the upper edge of its bin
    edge = 0 if below else 1
    shares = [level if below else 1 - level for level in LEVELS]
    of_all = [float(quantile([(b, g) for b, g, _ in whole], s) + edge) if level else none for level, s in zip(LEVELS, shares)]
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(level > 0).alias("cuts"), F.lit(s).alias("share"), F.lit(q).alias("all"))
                                for k, (level, s, q) in enumerate(zip(LEVELS, shares, of_all))]))
    w = Window.partitionBy("lang")
    under = counts.where("good > 0").select("lang", "bin", F.sum("good").over(w.orderBy("bin")).alias("under"), F.sum("good").over(w).alias("n"))
    own = (under.withColumn("step", steps).select("lang", "bin", "under", "n", "step.*").where(F.col("under") >= F.col("share") * F.col("n"))
           .groupBy("lang", "level", "cuts", "all").agg(F.min("bin").alias("q"), F.first("n").alias("n"))
           .select("lang", "level", F.when(F.col("cuts"), (F.col("n") * (F.col("q") + edge) + PRIOR * F.col("all")) / (F.col("n") + PRIOR)).otherwise(none).alias("bound")))
    own = stored(own, "bounds")
    each = counts.withColumn("step", steps).select("lang", "bin", "good", "bad", "step.level", "step.all").join(own, ["lang", "level"], "left")
    middle, bound = F.col("bin") + 0.5, F.coalesce("bound", "all")
    out = middle < bound if below else middle > bound
    gain = {r["level"]: r["gain"] for r in each.where(out).groupBy("level").agg((F.sum("bad") / n_bad - F.sum("good") / n_good).alias("gain")).collect()}
    best = max(range(len(LEVELS)), key=lambda k: (round(gain.get(k, 0.0), 12), -LEVELS[k]))
    return own.where(F.col("level") == best).select("lang", "bound"), of_all[best]


def bounds(bins: DataFrame, lower: float, upper: float) -> tuple[DataFrame, tuple[float, float]]:
    """``lang, low, high`` in bins: the outer edges of the bins that hold the quantiles, and an allowance; and those of all languages.

    The allowance is a tenth of what lies between, and more for few documents, whose quantiles say
    little about the next one. Counted by language and bin first, so a language with a third of the
    rows is a few thousand counts.
    """
    counts = bins.groupBy("lang", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang")
    edges = (counts.withColumn("below", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("all", F.sum("n").over(w)).groupBy("lang", "all")
             .agg(F.min(F.when(F.col("below") >= lower * F.col("all"), F.col("bin"))).alias("low"),
                  (F.min(F.when(F.col("below") >= upper * F.col("all"), F.col("bin"))) + 1).alias("high")))
    more = (F.col("high") - F.col("low")) * (ALLOWANCE + FEW / F.sqrt("all"))
    table = edges.select("lang", (F.col("low") - more).alias("low"), (F.col("high") + more).alias("high"))
    whole = sorted((r["bin"], r["n"]) for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect())  # MOST_BINS at most
    total, at, low, high = sum(n for _, n in whole), 0, None, None
    for b, n in whole:
        at += n
        low = b if low is None and at >= lower * total else low
        high = b + 1 if high is None and at >= upper * total else high
    more = (high - low) * (ALLOWANCE + FEW / total ** 0.5)
    return table, (low - more, high + more)
