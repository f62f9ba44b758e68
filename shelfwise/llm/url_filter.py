"""Operator 2: URL filters by rules and a character language-model ratio, in DataFrame functions only.

Rules on host and path come first. What no rule fits is judged by two smoothed Markov models of
variable order, one of accepted and one of rejected URLs (those that the rules allow and block):
a character's probability is interpolated (Witten and Bell) from the longest context seen down to
none. A URL's score is the mean over its characters of the log-likelihood difference; the threshold
is calibrated on a tenth of the ruled URLs that the models do not see.

Everything that shuffles is counted first: URLs are made distinct, each character with its context
(a gram) is counted by map-side sums, and the models are computed for distinct grams only, one order
after the other, so that a context or a shorter gram meets at most an alphabet of rows. Scores are
summed as whole numbers, so they do not depend on the order of rows.

Joins are by sort and merge. Spark would broadcast a written table by the size of its file, and the
compressed file of a million ids and scores is a tenth of what these rows take in the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import shuffle_parts, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CONTEXT = 4
UNIT = 10**9
BIN = UNIT // 50
#: Texts whose MD5 begins with less are held out: 26 of 256.
HELD_OUT = "1a"
#: Of unseen characters; any constant does, it is the same in both models.
ALPHABET = 1024

Rule = tuple[str, str, str]  # host, path, "allow" or "block"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and the text that the models read: all after the first ``://``, or the whole."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__u, instr(__u, '://') + 3)")).otherwise(F.lit(""))
    raw_host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(raw_host, UPPER, LOWER), path, F.translate(F.when(at > 0, rest).otherwise(url), UPPER, LOWER)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; a rule list is bounded by what one writes by hand."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def characters(text: Column) -> Column:
    """The text's characters between a begin and an end mark."""
    return F.split(F.concat(F.lit("\u0002"), text, F.lit("\u0003")), "")


def grams(chars: Column, context: int = CONTEXT) -> Column:
    """Each character but the begin mark, with up to ``context`` characters before it.

    ``chars`` must be a column of its own: an expression would be evaluated for each character again.
    """
    return F.transform(F.sequence(F.lit(2), F.size(chars)),
                       lambda i: F.array_join(F.slice(chars, F.greatest(F.lit(1), i - context), F.least(F.lit(context + 1), i)), ""))


def log_ratios(counts: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``gram, ratio``: of distinct grams with their counts ``good`` and ``bad``, the log-likelihood difference."""
    n = F.length("gram")
    ends = counts.select("good", "bad", n.alias("of"), "gram", F.explode(F.sequence(F.lit(1), n)).alias("order"))
    # all grams and what they end with; ``whole``: it is a gram itself, not only the end of longer ones
    seen = stored(ends.groupBy("order", F.expr("right(gram, `order`)").alias("gram")).agg(
        F.sum("good").alias("g"), F.sum("bad").alias("b"), F.max(F.col("of") == F.col("order")).alias("whole"))
        .withColumn("before", F.expr("left(gram, length(gram) - 1)")), "url-grams")
    contexts = seen.where("g + b > 0").groupBy("before").agg(
        F.sum("g").alias("gn"), F.sum((F.col("g") > 0).cast("long")).alias("gt"),
        F.sum("b").alias("bn"), F.sum((F.col("b") > 0).cast("long")).alias("bt"))

    def finer(p, n, total, kinds):
        return F.when(F.col(total) > 0, (F.col(n) + F.col(kinds) * F.col(p)) / (F.col(total) + F.col(kinds))).otherwise(F.col(p))

    below, out = None, None
    for k in range(1, context + 2):
        level = seen.where(F.col("order") == k).join(contexts.hint("merge"), "before", "left")
        if below is None:
            level = level.withColumns({"pg": F.lit(1.0 / ALPHABET), "pb": F.lit(1.0 / ALPHABET)})
        else:
            level = level.withColumn("shorter", F.expr("right(gram, length(gram) - 1)")).join(below.hint("merge"), "shorter")
        level = level.select("gram", "whole", finer("pg", "g", "gn", "gt").alias("pg"), finer("pb", "b", "bn", "bt").alias("pb"))
        if k % 2 == 0:
            level = stored(level, "url-model")  # else each order would be computed again for all above it
        own = level.where("whole").select("gram", F.round((F.log("pg") - F.log("pb")) * UNIT).cast("long").alias("ratio"))
        out = own if out is None else out.union(own)
        below = level.select(F.col("gram").alias("shorter"), "pg", "pb")
    return out


def scores(urls: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``id, score`` (in units of 1e-9 a character) of distinct ``id, text, good, bad, wanted`` rows.

    ``good`` and ``bad`` say how often a text counts as an example of either kind; ``wanted`` texts are
    scored. Only the id goes along with a text's characters, so a long text costs its length once.
    """
    split = urls.select("id", "good", "bad", "wanted", characters(F.col("text")).alias("chars"))
    each = split.select("id", "good", "bad", "wanted", F.explode(grams(F.col("chars"), context)).alias("gram"))
    counts = each.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    return (each.where("wanted").select("id", "gram").join(log_ratios(counts, context).hint("merge"), "gram")
            .groupBy("id").agg((F.sum("ratio") / F.count("*")).cast("long").alias("score")))


def calibrated(examples: DataFrame) -> int | None:
    """The score bound with the least balanced error on ``score, good, bad`` rows; None without both kinds.

    One row comes to the driver; the running sums run over score bins, of which there are a bounded number.
    """
    b = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("score") / BIN))).cast("int")
    row = (examples.groupBy(b.alias("bin")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
           .agg(F.sort_array(F.collect_list(F.struct("bin", "good", "bad"))).alias("bins")).first())
    bins = row["bins"] if row else []
    good, bad = sum(x["good"] for x in bins), sum(x["bad"] for x in bins)
    if not good or not bad:
        return None
    best, at, lost, caught, before = None, None, 0, 0, None
    for x in bins:  # a bound below this bin, halfway from the one before, rejects the bins before
        value = caught / bad - lost / good
        if best is None or value > best:
            best, at = value, x["bin"] if before is None else (before + 1 + x["bin"]) / 2
        lost, caught, before = lost + x["good"], caught + x["bad"], x["bin"]
    return round(at * BIN)


def filter_urls(df: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", context: int = CONTEXT) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row.

    A null URL, or one without ``://``, has an empty host and path; the models then read all of it
    (of a null one only the end mark). Null ids and repeated rows come back as they are; other columns
    are not read; an empty table gives an empty one. A score at the threshold is allowed. If the rules
    allow nothing or block nothing, the models say nothing and the verdict is allow. ``score`` is null
    where a rule decides.
    """
    pages = df.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("__u"))
    host, path, text = parts(F.col("__u"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"), text.alias("text"))
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    pages = pages.select("page_id", "host", "path", "text", rule.alias("rule"), ruled.alias("ruled"))
    # a text's rows may differ in their rule only by the scheme's place, so its kind is counted, not assumed
    kinds = pages.groupBy("text").agg(
        F.sum((F.col("ruled") == "allow").cast("long")).alias("allow"), F.sum((F.col("ruled") == "block").cast("long")).alias("block"),
        F.max(F.col("ruled").isNull()).alias("open")).na.fill(0)
    held = F.substring(F.md5("text"), 1, 2) < F.lit(HELD_OUT)
    zero = F.lit(0).cast("long")
    kinds = kinds.select("text", "allow", "block", "open", held.alias("held"),
                         F.when(held, zero).otherwise(F.col("allow")).alias("good"), F.when(held, zero).otherwise(F.col("block")).alias("bad"))
    kinds = stored(kinds.withColumn("id", F.monotonically_increasing_id()), "urls")
    # few bytes, but much work for each: dealt to all tasks
    dealt = kinds.repartition(shuffle_parts(df.sparkSession), "id")
    judged = stored(scores(dealt.withColumn("wanted", F.col("held") | F.col("open")), context), "url-scores")
    bound = calibrated(judged.join(kinds.where("held").select("id", F.col("allow").alias("good"), F.col("block").alias("bad")).hint("merge"), "id"))
    by_model = F.when((F.col("score") < F.lit(bound)), "block").otherwise("allow") if bound is not None else F.lit("allow")
    return pages.join(judged.join(kinds.select("id", "text").hint("merge"), "id").hint("merge"), "text", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"),
        F.when(F.col("ruled").isNull(), F.col("score") / UNIT).alias("score"))
