import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import WORD, awkward_texts, frame, same, syllables

from shelfwise.llm import quality_lm as Q, quality_rules as R

# ---- the language model


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney of order three, from plain dictionaries; returns log p(c | ab)."""
    three = Counter()
    for t in texts:
        s = [Q.BEGIN, Q.BEGIN, *map(ord, t), Q.END]
        three.update(zip(s, s[1:], s[2:]))
    two = Counter((b, c) for a, b, c in three)
    one = Counter(c for b, c in two)

    def order(counts, below):
        n = [sum(v == k for v in counts.values()) for k in range(5)]
        if not n[1] or not n[2]:
            d = [0.5] * 3
        else:
            y = n[1] / (n[1] + 2 * n[2])
            d = []
            for k in (1, 2, 3):
                more = n[k + 1] if k < 4 else 0
                d.append(min(max(k - (k + 1) * y * more / n[k], 0.05), k - 0.05) if n[k] else 0.5)
        take = lambda v: 0.0 if not v else d[min(v, 3) - 1]
        total, saved = Counter(), defaultdict(float)
        for g, v in counts.items():
            total[g[:-1]] += v
            saved[g[:-1]] += take(v)
        return lambda g: below(g[1:]) if not total[g[:-1]] else (counts[g] - take(counts[g]) + saved[g[:-1]] * below(g[1:])) / total[g[:-1]]

    p1 = order(Counter({(c,): v for c, v in one.items()}), lambda g: 1 / Q.UNSEEN)
    p3 = order(three, order(two, p1))

    def nll(t):
        s = [Q.BEGIN, Q.BEGIN, *map(ord, t), Q.END]
        return -sum(math.log(p3(g)) for g in zip(s, s[1:], s[2:]))

    return nll


def test_likelihoods_match_plain_counts(spark):
    texts = awkward_texts()
    trusted = [k for k in range(len(texts)) if k % 2]
    docs = frame(spark, texts, lang=["en"] * len(texts))
    got = {r.doc_id: r for r in Q.perplexities(docs, spark.createDataFrame([(k,) for k in trusted], "doc_id long")).collect()}
    nll = kneser_ney([texts[k] or "" for k in trusted])
    for k, t in enumerate(texts):
        assert abs(got[k].nll - nll(t or "")) < 1e-6 * max(1, len(t or "")), k
        assert got[k].n_chars == len(t or "")


def test_wide_alphabets_take_the_sorted_way(monkeypatch):
    texts = [t or "" for t in awkward_texts()] + ["漢字" * 20]
    a = Q.Grams(texts)
    chosen = np.arange(len(texts)) % 2 == 0
    monkeypatch.setattr(Q, "DENSE", 0)
    b = Q.Grams(texts)
    assert a.dense and not b.dense
    x, y = (dict(zip(*(v.tolist() for v in g.counts(chosen)))) for g in (a, b))
    assert x == y
    gram = np.array(sorted(x))
    value = np.random.default_rng(0).random(len(gram))
    assert np.allclose(a.sums(gram, value, len(texts)), b.sums(gram, value, len(texts)))


def test_slices_are_the_whole(monkeypatch):
    texts = [t or "" for t in awkward_texts()]
    g = Q.Grams(texts)
    gram, _ = g.counts(np.ones(len(texts), bool))
    gram = np.sort(gram)
    value = np.random.default_rng(0).random(len(gram))
    want = g.sums(gram, value, len(texts))
    for size in (1, 2, 7, 1000):
        monkeypatch.setattr(Q, "SLICE", size)
        got, some = np.zeros(len(texts)), set()
        for found, of in Q.sliced(texts):
            np.add.at(got, of, found.sums(gram, value, len(of)))
            some |= set(found.counts(np.ones(len(of), bool))[0].tolist())
        assert np.allclose(got, want) and some == set(gram.tolist())


def test_noise_goes_and_clean_stays(spark):
    rng = random.Random(6)
    texts, lang, labels = [], [], []
    for k in range(240):
        noise = k % 8 == 0
        t = syllables(rng, 60)
        texts.append("".join(chr(rng.randint(33, 120)) for _ in range(300)) if noise else t)
        lang.append(("en", "de", None)[k % 3])
        if k % 4:
            labels.append((k, 1, 0, "x"))
    labels += [(None, 1, 0, "x"), (16, None, 0, "x"), (1, 1, None, "x")]
    got = Q.classify(frame(spark, texts, lang=lang), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")).collect()
    assert len(got) == 240
    assert not any(r.kept for r in got if r.doc_id % 8 == 0) and sum(r.kept for r in got if r.doc_id % 8) >= 0.97 * 210


def test_rows_and_edges_of_the_classifier(spark):
    texts, ids = [None, "", "a", "a", "b"], [None, 1, 2, 2, 3]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.classify(frame(spark, texts, ids, lang=["en", None, "en", "en", "de"]), none).collect()
    same([(r.doc_id, r.n_chars, r.kept) for r in got], [(None, 0, True), (1, 0, True), (2, 1, True), (2, 1, True), (3, 1, True)])
    assert Q.classify(frame(spark, [], lang=[]), none).count() == 0


def test_quantile_bounds(spark):
    bins = spark.createDataFrame([("en", k) for k in range(100)] + [("de", 7)], "lang string, bin long")
    table, whole = Q.bounds(bins, 0.02, 0.95)
    got = {r.lang: (r.low, r.high) for r in table.collect()}
    more = 94 * (Q.ALLOWANCE + Q.FEW / 10)
    assert np.allclose(got["en"], (1 - more, 95 + more)) and np.allclose(got["de"], (7 - Q.ALLOWANCE - Q.FEW, 8 + Q.ALLOWANCE + Q.FEW))
    assert whole[0] < 2 and whole[1] > 95


def plain_bounds(rows, below):
    """The level and the bounds by trying all levels on plain lists of (lang, bin, good)."""
    good = [(lang, b) for lang, b, g in rows if g]
    bad = [(lang, b) for lang, b, g in rows if not g]
    none = -np.inf if below else np.inf

    def quantile(values, level):
        values, share = sorted(values), level if below else 1 - level
        return next(v for k, v in enumerate(values) if k + 1 >= share * len(values)) + (0 if below else 1)

    def at(level):
        if not level:
            return {lang: none for lang, _, _ in rows}, none
        whole = quantile([b for _, b in good], level)
        out = {}
        for lang in {lang for lang, _, _ in rows}:
            own = [b for x, b in good if x == lang]
            out[lang] = (len(own) * quantile(own, level) + Q.PRIOR * whole) / (len(own) + Q.PRIOR) if own else whole
        return out, whole

    def gain(level):
        bound, _ = at(level)
        share = lambda part: sum((b + 0.5 < bound[lang]) if below else (b + 0.5 > bound[lang]) for lang, b in part) / len(part)
        return share(bad) - share(good)

    level = max(Q.LEVELS, key=lambda x: (round(gain(x), 12), -x))
    return level, at(level)


@pytest.mark.parametrize("below", [False, True])
@pytest.mark.parametrize("shift", [0, 60, 400])
def test_bounds_are_quantiles_at_the_level_that_the_labels_say(spark, below, shift):
    rng = np.random.default_rng(shift)
    rows = [(str(lang), int(b), True) for lang, n, mean in (("en", 300, 2000), ("de", 12, 2100), ("fr", 1, 1900)) for b in rng.normal(mean, 50, n)]
    rows += [(str(lang), int(b), False) for lang, n in (("en", 40), ("fr", 9), ("xx", 5)) for b in rng.normal(2000 + (-shift if below else shift), 60, n)]
    make = lambda kind: spark.createDataFrame([(lang, b) for lang, b, g in rows if g == kind], "lang string, bin long")
    level, (want, whole) = plain_bounds(rows, below)
    table, got = Q.calibrated(Q.counted(make(True), make(False)), below)
    assert got == whole and {r.lang: r.bound for r in table.collect()} == pytest.approx({k: v for k, v in want.items() if k != "xx"})
    assert (level > 0) == (shift > 0) or shift == 0


def test_half_noisy_texts_go(spark):
    rng = random.Random(12)
    texts, labels = [], []
    for k in range(700):
        noise = k % 5 == 0
        words = syllables(rng, 60).split()
        if noise:
            words = ["".join(chr(rng.randint(33, 120)) for _ in w) if j % 2 else w for j, w in enumerate(words)]
        texts.append(" ".join(words))
        labels.append((k, 0 if noise else 1, 0))
    got = Q.classify(frame(spark, texts, lang=["en"] * 700), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sum(r.kept for r in got if r.doc_id % 5 == 0) <= 2 and sum(r.kept for r in got if r.doc_id % 5) >= 0.98 * 560


# ---- rules and the forest


def plainly(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count, hit, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit |= set(range(i, i + 5))
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def test_statistics_match_plain_counts(spark):
    texts = [*awkward_texts(), "a b c d e " * 2, "a b c d e\x0ba b c d e f g h", "l one\nl one\n \nl one\n\n \n", "#a* $b| é<>&% ü", "a " * 5, "x y " * 6 + "  z"]
    ids = [None if k == 3 else k for k in range(len(texts))]
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = R.judge(frame(spark, texts, ids), none).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got],
         [(d, *plainly(t), not plainly(t)[-1]) for d, t in zip(ids, texts)])
    assert R.judge(frame(spark, []), none).count() == 0


def test_repeated_words_of_any_length():
    rng = random.Random(7)
    for n in (0, 4, 5, 6, 11, 200, 5000):
        words = [rng.choice("abc").encode() for _ in range(n)]
        assert R.repeated_words(words) == plainly(b" ".join(words).decode())[4]


def test_paths_match_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6))
    trees = []
    for k in range(10):
        nodes = np.array(R.grow(x[k * 16:k * 16 + 16], np.random.default_rng(k), 4), float)
        trees.append((nodes[:, 0].astype(int), nodes[:, 1], nodes[:, 2].astype(int), nodes[:, 3]))
    got = R.path_scores(trees, x, 16)
    for i in range(0, 200, 17):
        total = 0.0
        for f, s, r, e in trees:
            at = depth = 0
            while f[at] >= 0:
                at = at + 1 if x[i, f[at]] < s[at] else r[at]
                depth += 1
            total += depth + e[at]
        assert abs(got[i] - 2 ** (-total / 10 / R.mean_path(16))) < 1e-9


def test_forest_finds_the_odd_ones(spark):
    rng = random.Random(9)
    texts, labels = [], []
    for k in range(600):
        bad = k % 10 == 0
        t = syllables(rng, rng.randint(30, 90))
        texts.append(" ".join(w + rng.choice(["###", "&&&"]) for w in t.split()) if bad else t)
        if k % 2 == 0:
            labels.append((k, 0 if bad else 1, "x"))
    got = R.judge(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, text string"), trees=50, tree_rows=64).collect()
    odd = [r for r in got if r.doc_id % 10 == 0]
    fine = [r for r in got if r.doc_id % 10 and not r.base_failed]
    assert sum(not r.kept for r in odd) >= 0.8 * len(odd) and sum(r.kept for r in fine) >= 0.98 * len(fine)


def test_bad_rows_have_their_share_at_any_size():
    for good, bad in ((3409, 571), (24_800, 4000), (100, 100), (10**6, 10**5), (10**6, 50)):
        got = R.drawn({True: good, False: bad}, 100, 256, 1 / 32)
        n = {k: c * c2 * s for (k, (c2, s)), c in zip(got.items(), (good, bad))}
        assert all(1 <= c <= 100 and 0 <= s <= 1 for c, s in got.values())
        assert abs(n[False] / (n[True] + n[False]) - 1 / 32) < 1e-9 and abs(sum(n.values()) - min(25_600, 100 * good * 32 / 31)) < 1
    assert R.drawn({True: 5}, 100, 256, 1 / 32)[False] == (1, 0.0) and R.drawn({False: 5}, 100, 256, 1 / 32)[False][1] == 0.0


def test_rows_odd_in_one_feature_are_found(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for k in range(800):
        words = syllables(rng, rng.randint(30, 90)).split()
        if k % 7 == 0:  # half a symbol a word
            words = [w + "#" if j % 2 else w for j, w in enumerate(words)]
        elif k % 5 == 0:  # good ones are odd in other ways
            words = [w.upper() if rng.random() < 0.3 else w + "!" * (k % 3) for w in words]
        texts.append(" ".join(words))
        labels.append((k, int(k % 7 > 0), "x"))
    got = R.judge(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, text string"), good_loss=0.01).collect()
    bad = [r for r in got if r.doc_id % 7 == 0]
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)
    assert sum(not r.kept and not r.base_failed for r in got if r.doc_id % 7) <= 0.01 * 685


def test_threshold_keeps_to_the_loss():
    counts = {900: (0, 5), 800: (1, 5), 700: (1, 0), 100: (998, 0)}
    assert R.threshold(counts, 0.001) == 800 / R.BINS and R.threshold(counts, 0.002) == 700 / R.BINS
    assert R.threshold({5: (3, 0)}, 0.1) == math.inf
