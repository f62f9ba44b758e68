"""Operator 13: lines found in many documents go, by levelled sorted runs of line hashes.

``LineRuns`` is a folder of runs. A run holds (hash of a line's key, number of
documents with it), sorted within hash partitions. ``add`` writes the run of a
new batch; whenever ``fan`` runs of one level stand beside each other, they are
merged into one run of the next level, so n batches leave about ``fan * log(n)``
runs and each hash is rewritten once a level. ``found_in`` merges the runs,
``without_lines`` anti-joins a batch's lines with them by hash. The main path is
DataFrame functions only.

A run is named by the first and last batch that it covers. One that another
complete run covers doesn't count any more, so a merge that is broken off, or a
driver lost between writing and deleting, changes nothing.

Defined results: a null or empty text is one empty line; keys with fewer than
``least_chars`` code points always stay; every row is a document, also one with
the id and text of another; a null id stays null; an empty table gives no rows.
Keys are told apart by 128 bits of hash.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .base import texts

#: Stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many runs of a level are merged into one of the next.
FAN = 4


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case (``lower`` does just that on ASCII)."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def key_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def line_counts(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """h1, h2, n_docs: in how many rows of (doc_id, text) a key stands; partial sums before the shuffle."""
    keys = F.array_distinct(F.transform(F.split("text", "\n"), line_key))
    each = docs.select(F.explode(keys).alias("key")).where(F.char_length("key") >= least_chars)
    return each.select(*key_hashes(F.col("key"))).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))


class LineRuns:
    """Levelled sorted runs of line hashes below ``path``, a folder that all executors reach."""

    SCHEMA = "h1 long, h2 long, n_docs long"

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN, least_chars: int = 1):
        if fan < 2:
            raise ValueError("fan must be at least 2")
        self.spark, self.path, self.fan, self.least_chars = spark, path, fan, least_chars
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> list[tuple[int, int]]:
        """(first, last batch) of the runs that count, in order: complete, and covered by no other."""
        if not self._files.exists(self._folder):
            return []
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        named = [re.fullmatch(r"run-(\d+)-(\d+)", s.getPath().getName()) for s in self._files.listStatus(self._folder)]
        done = [(int(m[1]), int(m[2])) for m in named if m and self._files.exists(Path(f"{self.path}/{m[0]}/_SUCCESS"))]
        return sorted(r for r in done if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in done))

    def _place(self, run: tuple[int, int]) -> str:
        return f"{self.path}/run-{run[0]}-{run[1]}"

    def _write(self, counts: DataFrame, run: tuple[int, int]) -> None:
        # hashes don't compress
        counts.sortWithinPartitions("h1", "h2").write.mode("overwrite").option("compression", "uncompressed").parquet(self._place(run))

    def _merged(self, runs: list[tuple[int, int]]) -> DataFrame:
        out = self.spark.createDataFrame([], self.SCHEMA)
        if runs:
            out = self.spark.read.schema(self.SCHEMA).parquet(*[self._place(r) for r in runs])
        return out.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))

    def add(self, docs: DataFrame) -> None:
        """Write the run of a new batch of documents (doc_id, text), then merge full levels."""
        found = self.runs()
        number = found[-1][1] + 1 if found else 0
        self._write(line_counts(docs, self.least_chars), (number, number))
        self.compact()

    def compact(self) -> None:
        """Merge ``fan`` neighbouring runs of one size until no level is full; what they replace is deleted."""
        while True:
            found = self.runs()
            groups = [found[i:i + self.fan] for i in range(len(found) - self.fan + 1)]
            full = next((g for g in groups if len({b - a for a, b in g}) == 1), None)
            if full is None:
                return
            self._write(self._merged(full), (full[0][0], full[-1][1]))
            for run in full:
                self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._place(run)), True)

    def found_in(self, least_docs: int) -> DataFrame:
        """h1, h2 of the keys that stand in ``least_docs`` documents of all batches."""
        return self._merged(self.runs()).where(F.col("n_docs") >= least_docs).select("h1", "h2")


def without_lines(docs: DataFrame, found: DataFrame, least_chars: int = 1) -> DataFrame:
    """doc_id, text, n_lines, n_dropped: the rows of (doc_id, text) without the lines whose key is in ``found``.

    Only hashes and places of lines go to the join; the places found go back to
    the rows by id and 128 bits of the text (rows equal in both have the same
    lines). There a text is put together from the slices between these places,
    so its work is in proportion to its lines.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2"))
    lines = docs.select("doc_id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least_chars)
    hit = lines.select("doc_id", "t1", "t2", "place", *key_hashes(F.col("key"))).join(found, ["h1", "h2"], "left_semi")
    places = hit.groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("place")).alias("gone"))
    places = places.select(F.col("doc_id").alias("id"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), "gone")
    whole = docs.join(places, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left")
    whole = whole.select("doc_id", "text", "gone", F.size(F.split("text", "\n")).alias("n"))

    def between(x: Column) -> Column:
        """The lines before, between and behind the places that go."""
        part = lambda i: F.slice(x["lines"], F.get(x["ends"], i) + 2, F.get(x["ends"], i + 1) - F.get(x["ends"], i) - 1)
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["ends"]) - 2), part)), "\n")

    ends = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array("n"))
    # as an element of an array the split text is computed once, not again for each slice
    kept = F.get(F.transform(F.array(F.struct(F.split("text", "\n").alias("lines"), ends.alias("ends"))), between), 0)
    return whole.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
                        F.col("n").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def drop_common_lines(df: DataFrame, least_docs: int = 10, least_chars: int = 1, batches: int = 6,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, n_lines, n_dropped: every line whose key stands in ``least_docs`` documents goes from all of them.

    The table comes in ``batches`` parts (by a hash of id and text), as a stream of
    crawls would; each adds its run. Then all lines are anti-joined with the runs.
    """
    spark = df.sparkSession
    docs = texts(df, doc_id, text)
    path = scratch_path(spark, f"line-runs-{uuid.uuid4().hex}")
    runs = LineRuns(spark, path, least_chars=least_chars)
    runs._files.deleteOnExit(runs._folder)
    for k in range(batches):
        runs.add(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)) == k))
    return without_lines(docs, runs.found_in(least_docs), least_chars)
