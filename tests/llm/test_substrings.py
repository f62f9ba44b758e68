import numpy as np
import pytest
from llm_helpers import awkward_texts, frame, phrase_dedup, same, suffix_dedup

from shelfwise.llm import lpf_dedup, phrase_automata, repeats


def rows_of():
    texts = awkward_texts()
    ids = [7 * k % 101 for k in range(len(texts))]
    ids[3] = None
    ids[10] = None
    return list(zip(ids, texts))


@pytest.mark.parametrize("window", [50, 30])
def test_bytes_match_brute_force(spark, window):
    rows = rows_of()
    rows += [rows[7], (rows[11][0], "other text of the same id " + rows[11][1])]  # a repeated row, and an id with two texts
    got = lpf_dedup.dedup_bytes(frame(spark, [t for _, t in rows], [d for d, _ in rows]), window=window, digest=True).collect()
    same(got, suffix_dedup(rows, window))


def test_bytes_kept_are_the_rest(spark):
    passage = "0123456789" * 7
    got = {r.doc_id: r for r in lpf_dedup.dedup_bytes(frame(spark, ["a" + passage, "b" + passage + "c"])).collect()}
    assert bytes(got[0].kept) == ("a" + passage).encode() and bytes(got[1].kept) == b"bc" and got[1].n_spans == 1


@pytest.mark.parametrize("window,phrase", [(35, 8), (10, 3)])
def test_words_match_brute_force(spark, window, phrase):
    rows = rows_of()
    rows += [rows[7]]
    got = phrase_automata.dedup_phrases(frame(spark, [t for _, t in rows], [d for d, _ in rows]), window, phrase, digest=True).collect()
    same(got, phrase_dedup(rows, window))


def test_the_largest_id_comes_back(spark):
    docs = frame(spark, ["some text of its own", "another text"], [2 ** 63 - 1, None])
    for out in (lpf_dedup.dedup_bytes(docs), phrase_automata.dedup_phrases(docs)):
        assert {r.doc_id for r in out.collect()} == {2 ** 63 - 1, None}


def test_tables_of_short_texts(spark):
    """No text has a window, so no bucket has an anchor."""
    for texts in (["a", "a", "", None], ["b" * 49, "c " * 34], [None] * 3):
        rows = list(enumerate(texts))
        docs = frame(spark, texts).repartition(3)
        same(lpf_dedup.dedup_bytes(docs, digest=True).collect(), suffix_dedup(rows))
        same(phrase_automata.dedup_phrases(docs, digest=True).collect(), phrase_dedup(rows))


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert lpf_dedup.dedup_bytes(empty).count() == 0 and phrase_automata.dedup_phrases(empty).count() == 0


def in_one_bucket(rows, window, gram, crowded):
    """Operator 5 without Spark, one bucket and three shards."""
    import hashlib

    import pyarrow as pa
    import pyarrow.compute as pc

    keys = [hashlib.md5((t or "").encode()).digest() for _, t in rows]
    table = pa.table({"key": pa.array(keys, pa.binary()), "doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t or "" for _, t in rows])})
    h, _ = lpf_dedup.anchor_hashes(window, gram)(repeats.unique(table)[2])
    every = np.unique(h >> np.uint64(24))
    known = pa.table({"hashes": pa.array([repeats.pack(h=every, crowded=crowded(len(every)).astype(np.uint8))], pa.binary())})
    sent = lpf_dedup.segments(window, gram, 3, 1)(table, known)
    spans = []
    for s in set(sent.column("shard").to_pylist()):
        spans += lpf_dedup.factored(window, gram, 3, 1)(sent.filter(pc.equal(sent.column("shard"), s))).column("spans").to_pylist()
    out = {o["key"]: o for o in lpf_dedup.removed(window, True)(table, pa.table({"spans": pa.array(spans, pa.binary())})).to_pylist()}
    nothing = hashlib.sha256(b"").hexdigest()
    return [(d, o["n_bytes"], o["n_bytes"], 1, nothing) if d > o["least"] and o["n_bytes"] >= window else (d, o["n_bytes"], o["n_removed"], o["n_spans"], o["kept"])
            for (d, _), o in zip(rows, (out[k] for k in keys))]


@pytest.mark.parametrize("letters,window", [(1, 16), (2, 16), (3, 21), (2, 50)])
def test_previous_factors_by_comparing_all_suffixes(letters, window):
    """Lengths from previous and next smaller ids, against the longest common prefix with every suffix of a smaller id."""
    rng = np.random.default_rng(letters * window)
    offsets = [*range(0, window - 7, 8), *([window - 8] if window % 8 else [])]
    for n in (0, 1, 2, 3, 40, 300):
        text = rng.integers(97, 97 + letters, n + window + 8).astype(np.uint8)
        at = rng.permutation(n + 8)[:n]
        text[at[: n // 3, None] + np.arange(window)] = text[:window] if n > 9 else text[at[: n // 3, None] + np.arange(window)]   # many equal windows
        own = rng.integers(0, max(1, n // 4) + 1, n)
        words = [text[p:p + window].tobytes() for p in at]
        common = lambda a, b: next((k for k in range(window) if a[k] != b[k]), window)
        want = [max((common(words[i], words[j]) for j in range(n) if own[j] < own[i]), default=0) for i in range(n)]
        suffix = [lpf_dedup.loads(text, at + o, ">") for o in offsets]
        assert lpf_dedup.previous_factors(suffix, offsets, own).tolist() == want
        for least in (5, window):
            assert (lpf_dedup.previous_factors(suffix, offsets, own, least) >= least).tolist() == [x >= least for x in want]


@pytest.mark.parametrize("window,gram", [(50, 16), (30, 9)])
def test_slices_and_crowded_anchors_change_nothing(monkeypatch, window, gram):
    """Whatever the pieces, and whether an anchor's windows go together or each for itself."""
    texts = [*awkward_texts(5), "a" * 700, "ab" * 300 + "c" + "a" * 200, "For " * 400 + "the end"]
    rows = [(7 * k % 211, t) for k, t in enumerate(texts)]
    want = suffix_dedup(rows, window)
    for piece, cut, suffixes in ((1 << 21, 1 << 16, 1 << 19), (97, 50, 100), (1000, 7, 33)):
        monkeypatch.setattr(repeats, "PIECE", piece)
        monkeypatch.setattr(lpf_dedup, "SEGMENTS", cut)
        monkeypatch.setattr(lpf_dedup, "SUFFIXES", suffixes)
        for crowded in (np.zeros, np.ones, lambda n: np.arange(n) % 2):
            assert in_one_bucket(rows, window, gram, crowded) == want


def test_words_of_slices_are_those_of_the_whole(monkeypatch):
    raw = [(t or "").encode() for t in awkward_texts(6)]
    whole = phrase_automata.Words(raw)
    assert [int(x) for x in np.bincount(whole.doc, minlength=len(raw))] == [len(t.split()) for t in raw]
    for piece in (13, 100, 1000):
        monkeypatch.setattr(repeats, "PIECE", piece)
        part = phrase_automata.Words(raw)
        assert (whole.hash == part.hash).all() and (whole.doc == part.doc).all() and (whole.first == part.first).all()


def test_anchors_are_the_least_grams_of_windows():
    rng = np.random.default_rng(5)
    grams = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    grams[100:140] = grams[100]  # ties: the leftmost
    place, first, last = repeats.anchors(grams, 7, np.ones(494, bool))
    own = {p: q for q, a, b in zip(place, first, last) for p in range(a, b + 1)}
    short = (grams >> np.uint64(31)).astype(np.uint64) & np.uint64((1 << 32) - 1)
    assert own == {p: p + int(np.argmin(short[p:p + 7])) for p in range(494)}


def test_packed_arrays_come_back():
    h = np.random.default_rng(0).integers(0, 1 << 63, 50).astype(np.uint64) * np.uint64(2)
    assert (repeats.long(repeats.short(h).ravel()) == h >> np.uint64(24)).all()
    tag = np.repeat(np.arange(5, dtype=np.uint64), 10)
    t, x = repeats.opened(repeats.tagged(tag, x=h.astype("<u8")), "<u8")
    assert (t == tag).all() and (x == h).all()
