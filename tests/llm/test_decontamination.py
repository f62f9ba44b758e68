import random

import numpy as np
from llm_helpers import awkward_texts, frame, syllables

from shelfwise.llm import lsi_decontamination as L


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_subsequences_match_the_table():
    rng = np.random.default_rng(2)
    for _ in range(200):
        item = rng.integers(0, 9, rng.integers(1, 40)).astype(np.uint64)
        words = rng.integers(0, 12, rng.integers(0, 90)).tolist()
        common, last = L.Item(1, item).common(words)
        assert round(common * len(item)) == lcs(item.tolist(), words)
        tail = item.tolist()[-L.ANSWER:]
        assert round(last * len(tail)) == lcs(tail, words)
        assert L.Item(1, item).common(words, 0.5) == ((common, last) if common >= 0.5 else (0.0, 0.0))


def vocabulary(rng, n=800):
    return ["".join(rng.choice(("ka", "to", "mi", "re", "su", "no", "ha", "li")) for _ in range(rng.randint(2, 5))) for _ in range(n)]


def planted(seed=3, items=30, docs=300):
    """Items, texts, and which text has which item: as it is, in other case and marks, or paraphrased."""
    rng = random.Random(seed)
    words = vocabulary(rng)
    text = lambda n: [rng.choice(words[:20]) if rng.random() < 0.35 else rng.choice(words) for _ in range(n)]
    bench = [text(rng.randint(15, 55)) for _ in range(items)]
    texts, has = [], set()
    for k in range(docs):
        t = text(rng.randint(0, 220))
        if k % 3 == 0:
            i = rng.randrange(items)
            own = list(bench[i])
            if k % 9 == 0:
                own = [w.upper() + "," if j % 2 else w + "&&&" for j, w in enumerate(own)]
            if k % 9 == 3:  # every eighth word is another one
                own = [rng.choice(words) if j % 8 == 4 else w for j, w in enumerate(own)]
            at = rng.randint(0, len(t))
            t[at:at] = own
            has.add((k, i))
        elif k % 3 == 1 and k % 2:  # a short piece of an item is no leak
            own = bench[rng.randrange(items)]
            t += own[:len(own) // 4]
        texts.append(" ".join(t))
    return [" ".join(b) for b in bench], texts, has


def test_recall_and_precision_against_brute_force(spark):
    bench, texts, has = planted()
    items = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(bench)], "item_id long, text string, doc_id string, key string")
    got = {(r.doc_id, r.item_id) for r in L.contaminated(frame(spark, texts), items).collect()}
    # brute force: the words of each item against every stretch of every text
    every = set()
    for i, b in enumerate(bench):
        item = L.Item(i, L.Words([L.plain(b)]).hash)
        for k, t in enumerate(texts):
            w = L.Words([L.plain(t)]).hash.tolist()
            for at in range(0, max(len(w) - item.n, 0) + 1, 4):
                common, last = item.common(w[at:at + item.n + 8])
                if common >= 0.75 and last >= 0.5:
                    every.add((k, i))
                    break
    assert has <= every
    assert len(got & every) >= 0.95 * len(every) and len(got - every) <= 0.02 * len(every) + 1


def test_verbatim_parts_are_found(spark):
    rng = random.Random(8)
    words = vocabulary(rng)
    bench = [[rng.choice(words) for _ in range(rng.choice((20, 30, 45, 59)))] for _ in range(24)]
    texts, has = [], set()
    for i, b in enumerate(bench):
        for share in (0.5, 0.6, 0.7, 0.8):
            n = int(len(b) * share)
            if n < min(L.RUN, L.RUN_SHARE * len(b)):
                continue
            for begin in (0, (len(b) - n) // 2):  # the answer is missing
                t = [rng.choice(words) for _ in range(rng.randint(30, 250))]
                at = rng.randint(0, len(t))
                t[at:at] = b[begin:begin + n]
                has.add((len(texts), i))
                texts.append(" ".join(t))
    items = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(bench)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in L.contaminated(frame(spark, texts), items).collect()} == has


def test_runs_and_parts_of_an_item():
    item = L.Item(1, np.arange(100, 159, dtype=np.uint64))
    other = list(range(5000, 5040))
    near = [w if k % 7 else 9 for k, w in enumerate(range(120, 145))]  # 21 of 25
    assert item.part([*other, *near, *other]) and not item.part([*other, *near[:12], *other])
    words = np.array([*other, *range(120, 140), *other], np.uint64)
    at, of, own = L.Seeds([item, L.Item(2, np.arange(5, dtype=np.uint64)), item]).found(L.seeds(words))
    assert sorted(zip(at.tolist(), of.tolist(), own.tolist())) == [(40 + k, i, 20 + k) for k in range(11) for i in (0, 2)]
    assert item.longest(words, 45, 25) == 20


def test_short_items_as_they_are(spark):
    """Every whole item of five words and more is found, wherever it stands, also without any cosine; then its halves are not."""
    rng = random.Random(12)
    words = vocabulary(rng)
    bench = [[rng.choice(words) for _ in range(n)] for n in range(5, 17) for _ in range(4)] + [["only", "four", "words", "here"]]
    texts, has = [], set()
    for i, b in enumerate(bench):
        t = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        at = rng.choice((0, len(t), rng.randint(0, len(t))))
        if len(b) >= L.SHORTEST:
            has.add((len(texts), i))
        texts += [" ".join([*t[:at], *(w.upper() for w in b), *t[at:]]), " ".join([*t[:at], *b[:len(b) // 2], *t[at:]])]
    items = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(bench)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in L.contaminated(frame(spark, texts), items).collect()} >= has
    assert {(r.doc_id, r.item_id) for r in L.contaminated(frame(spark, texts), items, cosine=2.0).collect()} == has


def test_one_scan_for_all_blocks(spark, monkeypatch):
    bench, texts, _ = planted(items=12, docs=40)
    items = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    monkeypatch.setattr(L, "QUERY_WORDS", 100)
    plan = lambda: L.contaminated(frame(spark, texts), items)._jdf.queryExecution().toString()
    assert "Union" not in plan()
    monkeypatch.setattr(L, "SCAN_WORDS", 250)
    assert "Union" in plan()


def test_queries_in_blocks_are_the_same(spark, monkeypatch):
    bench, texts, _ = planted(items=12, docs=60)
    items = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    run = lambda: sorted((r.doc_id, r.item_id) for r in L.contaminated(frame(spark, texts), items).collect())
    whole = run()
    monkeypatch.setattr(L, "QUERY_WORDS", 100)
    assert whole and run() == whole
    monkeypatch.setattr(L, "SCAN_WORDS", 200)
    assert run() == whole


def test_edges(spark):
    bench = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    items = spark.createDataFrame([(1, bench), (2, None), (None, ""), (3, "!!!")], "item_id long, text string")
    texts = [*awkward_texts(), bench, bench, None]
    ids = [*range(len(texts) - 3), None, 99, None]
    got = L.contaminated(frame(spark, texts, ids), items).collect()
    assert sorted((r.doc_id is None, r.item_id) for r in got) == [(False, 1), (True, 1)]
    assert L.contaminated(frame(spark, []), items).count() == 0
    assert L.contaminated(frame(spark, texts, ids), items.limit(0)).count() == 0


def test_latent_space_keeps_neighbours(spark):
    """The factors are those of a plain decomposition, up to the sketch."""
    rng = np.random.default_rng(0)
    topics = [rng.integers(0, L.FEATURES, 40) for _ in range(5)]
    rows = [(np.unique(rng.choice(topics[k % 5], 25)).astype(int).tolist(),) for k in range(200)]
    factors, spread, mean = L.randomised_svd(spark.createDataFrame(rows, "f array<int>"), np.ones(L.FEATURES + 1), 5)
    a = np.zeros((200, L.FEATURES))
    for k, (f,) in enumerate(rows):
        a[k, f] = 1 / np.sqrt(len(f))
    exact = np.linalg.svd(a, full_matrices=False)[2][:5]
    assert np.allclose(np.linalg.svd(exact @ factors)[1], 1, atol=0.02)
    assert np.allclose(mean, a.mean(0)) and np.allclose(spread, np.linalg.svd(a)[1][:5] / np.sqrt(200), rtol=0.02)


def test_the_space_is_fitted_on_every_passage(spark):
    """Each word of each text is in a passage, and the mean row is that of all passages: more than any bounded sample."""
    rng = random.Random(4)
    words = vocabulary(rng)
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 15, 16, 17, 32, 33, 48, 64, 65, 200)] + ["one two three"] * 6000
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.f for r in L.passages(docs).collect()]
    sizes = [len(t.split()) for t in texts]
    rows = [-(-n // L.BLOCK) for n in sizes]
    assert len(got) == sum(-(-r // 2) for r in rows) and all(0 < len(f) <= 2 * L.BLOCK for f in got)
    feature = lambda t: ((L.Words([L.plain(t)]).hash >> np.uint64(11)) % np.uint64(L.FEATURES)).tolist()
    want = []
    for t, n, r in zip(texts, sizes, rows):
        starts = [2 * k for k in range(r // 2)] + ([max(r - 2, 0)] if r % 2 else [])
        want += [feature(t)[k * L.BLOCK:(k + 2) * L.BLOCK] for k in starts]
    assert sorted(got) == sorted(want)
    mean = np.zeros(L.FEATURES)
    for f in want:
        np.add.at(mean, f, 1 / np.sqrt(len(f)))
    _, _, found = L.randomised_svd(L.passages(docs), np.ones(L.FEATURES + 1), 5)
    assert np.allclose(found, mean / len(want))


def test_sums_by_place():
    rng = np.random.default_rng(5)
    for often in (0, 3, 99):
        at, row, y = rng.integers(0, 9, 60) ** 2 % 11, rng.integers(0, 20, 60), rng.standard_normal((20, 4))
        got, want = np.zeros((11, 4)), np.zeros((11, 4))
        L.add_rows(got, at, row, y, often)
        np.add.at(want, at, y[row])
        assert np.allclose(got, want)
    L.add_rows(got, at[:0], row[:0], y)
    assert np.allclose(got, want)
