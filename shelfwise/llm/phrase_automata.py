"""Operator 10: substring dedup by repeated-phrase automata.

A passage recurs if it holds a window of ``window`` words that starts anywhere else too. Phrases are
short word sequences (``phrase`` words), the anchors of windows (see ``repeats``).

1. Recurring phrases are confirmed: anchors' hashes are counted over all distinct texts.
2. Each bucket of texts compiles the phrases that recur and that it has into Aho-Corasick automata of
   a bounded size (its shard of the dictionary), and streams all its texts through them to locate
   every occurrence. Windows whose anchor was located are candidates; their hashes (96 bits) are dealt
   to shards, each once a bucket with its count, and added up there, which confirms the windows
   themselves. Where they are stays with the bucket.
3. Which of its windows are confirmed goes back to each bucket, where words are removed.

Texts that are whole copies take part once; with ``window`` words or more all their words go.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from .base import stored

WINDOW, PHRASE = 35, 8
#: Phrases in one automaton.
AUTOMATON = 50_000
BASE = 32

SPACE = re.compile(rb"[\x20\x09-\x0D]")
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LONGEST = 1 << 12
POWERS = np.random.default_rng(20).integers(0, 1 << 63, LONGEST, np.uint64) << np.uint64(1) | np.uint64(1)


def sliced(raw: list[bytes]):
    """Groups of slices of the texts, cut at white space, and the number of each slice's text: a long text is worked on in pieces."""
    slices, of = [], []
    for k, t in enumerate(raw):
        at = 0
        while len(t) - at > R.PIECE and (cut := SPACE.search(t, at + R.PIECE)):
            slices.append(t[at:cut.start()])
            of.append(k)
            at = cut.start()
        slices.append(t[at:])
        of.append(k)
    for part in R.pieces([len(t) for t in slices]):
        yield slices[part], np.array(of[part])


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words, one text after another, and each text's first."""
    buffer = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = ~SPACES[buffer]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begins, at = np.flatnonzero(begin), np.flatnonzero(inside)
    first = np.flatnonzero(begin[at])
    length = np.diff(np.append(first, len(at)))
    place = at - np.repeat(begins, length)  # of each byte in its word
    if len(place) and place.max() >= LONGEST:
        part = R.mixed((buffer[at].astype(np.uint64) + np.uint64(1)) * POWERS[place % LONGEST] + (place // LONGEST).astype(np.uint64))
    else:
        part = (buffer[at].astype(np.uint64) + np.uint64(1)) * POWERS[place]
    h = np.add.reduceat(part, first) if len(first) else np.zeros(0, np.uint64)
    ends = np.cumsum([len(t) + 1 for t in raw], dtype=np.int64)
    return R.joined(h, length.astype(np.uint64)), np.searchsorted(begins, np.append(0, ends[:-1])[:len(raw)])


class Words:
    """Hashes of the words of some texts, one after another, and the number of each word's text."""

    def __init__(self, raw: list[bytes]):
        hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(raw), np.int64)
        for slices, of in sliced(raw):
            h, first = word_hashes(slices)
            hashes.append(h)
            np.add.at(counts, of, np.diff(np.append(first, len(h))))
        self.hash = np.concatenate(hashes)
        self.first = np.cumsum(counts) - counts  # of each text's first word
        self.doc = np.repeat(np.arange(len(raw)), counts)

    def windows(self, width: int) -> np.ndarray:
        """Which windows of ``width`` words lie in one text."""
        n = len(self.doc) - width + 1
        return self.doc[:n] == self.doc[width - 1:] if n > 0 else np.zeros(0, bool)


def sequences(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all sequences of ``width`` neighbours, put together from those of powers of two."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    n = len(h) - width + 1
    out, at, size, power = None, 0, 1, h
    while True:
        if width & size:
            own = power[at:at + n]
            out = own if out is None else R.joined(out, own)
            at += size
        if 2 * size > width:
            return out
        power, size = R.joined(power[:-size], power[size:]), 2 * size


def anchor_hashes(window: int, phrase: int):
    def hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = Words(raw)
        grams = sequences(words.hash, phrase)
        place, _, _ = R.anchors(grams, window - phrase + 1, words.windows(window))
        place = np.unique(place)
        return grams[place], words.doc[place]

    return hashes


def located(pieces: list[Words], known: np.ndarray, window: int, phrase: int):
    """For each piece, the first words of all occurrences of known phrases, from the automata."""
    import ahocorasick

    anchored = []
    phrases: dict[int, np.ndarray] = {}
    for words in pieces:
        grams = sequences(words.hash, phrase)
        anchored.append(R.anchors(grams, window - phrase + 1, words.windows(window)))
        place = anchored[-1][0]
        h, first = np.unique(grams[place], return_index=True)
        for g, q in zip(h[R.among(h, known)].tolist(), place[first[R.among(h, known)]].tolist()):
            phrases.setdefault(g, words.hash[q:q + phrase])
    if not phrases:
        return
    every = np.stack(list(phrases.values()))
    letters = np.unique(every)  # the words of the phrases, numbered
    digits = 1
    while BASE ** digits <= len(letters):
        digits += 1
    coded = spelled(np.searchsorted(letters, every.ravel()) + 1, digits)
    size, automata = phrase * digits, []
    for at in range(0, len(every), AUTOMATON):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for k in range(at, min(at + AUTOMATON, len(every))):
            automaton.add_word(coded[k * size:(k + 1) * size])
        automaton.make_automaton()
        automata.append(automaton)
    for words, (place, first, last) in zip(pieces, anchored):
        at = np.minimum(np.searchsorted(letters, words.hash), len(letters) - 1)
        stream = spelled(np.where(letters[at] == words.hash, at + 1, 0), digits)
        found = np.zeros(len(words.hash) + 1, bool)
        for automaton in automata:
            ends = np.array([end for end, _ in automaton.iter(stream)], np.int64)
            found[(ends + 1) // digits - phrase] = True
        hit = found[place]
        yield words, first[hit], last[hit]


def spelled(numbers: np.ndarray, digits: int) -> str:
    """Each number as ``digits`` characters; a digit's place is told from its character, so no match begins inside a word.

    An automaton's node looks through its children one by one, so a small base is fast.
    """
    out = np.empty((len(numbers), digits), "<u4")
    rest = numbers.astype(np.int64)
    for k in range(digits):
        out[:, k] = rest % BASE + 1 + k * BASE
        rest = rest // BASE
    return out.tobytes().decode("utf-32-le")


SENT = "kind int, to long, bucket long, blob binary"
WINDOWS, PLACES = 0, 1


def candidates(window: int, phrase: int, shards: int, buckets: int):
    """Of a bucket: its distinct candidate windows by shard, each once with its count; and where they are, for the bucket itself."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, _, raw = R.unique(left)
        tags, (known, _) = R.tags(left, len(keys), buckets), R.known(right)
        bucket = left.column("bucket")[0].as_py() if len(left) else 0
        got = []
        if len(known):
            parts = list(R.pieces([len(t) for t in raw]))
            for part, (words, first, last) in zip(parts, _aligned(located([Words(raw[p]) for p in parts], known, window, phrase), len(parts))):
                at = R.ranges(first, last)
                if not len(at):
                    continue
                doc = words.doc[at]
                got.append((sequences(words.hash, window)[at], (sequences(R.mixed(words.hash ^ R.MIX1), window)[at] >> np.uint64(32)).astype("<u4"),
                            tags[part][doc], (at - words.first[doc]).astype("<u4")))
        kind, to, blobs = [], [], []
        if got:
            h, more, tag, place = (np.concatenate([g[i] for g in got]) for i in range(4))
            del got
            shard = (more % np.uint32(shards)).astype(np.int64)
            order = np.lexsort((more, h, shard))
            new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (more[order][1:] != more[order][:-1]) | (shard[order][1:] != shard[order][:-1])])
            number = np.empty(len(h), np.int64)
            number[order] = np.cumsum(new) - 1      # of each place's window, in the order of shards
            first = order[new]
            n = np.diff(np.append(np.flatnonzero(new), len(order)))
            for s, of in R.split(shard[first]):
                kind.append(WINDOWS)
                to.append(s)
                blobs.append(R.pack(h=h[first[of]].astype("<u8"), more=more[first[of]], n=n[of].astype("<u4")))
            by = np.lexsort((place, tag))
            kind.append(PLACES)
            to.append(-1)
            blobs.append(R.tagged(tag[by], place=place[by], number=number[by].astype("<u4")))
        return pa.table({"kind": pa.array(kind, pa.int32()), "to": pa.array(to, pa.int64()), "bucket": pa.array([bucket] * len(to), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def _aligned(found, n: int):
    got = list(found)
    return got or [(None, np.zeros(0, np.int64), np.zeros(0, np.int64))] * n


def confirmed(table: pa.Table) -> pa.Table:
    """Of a shard: for each bucket, which of the windows it sent occur twice or more anywhere, in the order sent."""
    got = [R.unpack(x, "<u8", "<u4", "<u4") for x in table.column("blob").to_pylist()]
    h, more, n = (np.concatenate([x[i] for x in got]) for i in range(3))
    ends = np.cumsum([len(x[0]) for x in got])
    del got
    order = np.lexsort((more, h))
    h, more = h[order], more[order]
    group = np.cumsum(np.concatenate([[True], (h[1:] != h[:-1]) | (more[1:] != more[:-1])])) - 1
    often = np.empty(len(order), bool)
    often[order] = (np.bincount(group, weights=n[order]) > 1)[group]
    return pa.table({"kind": pa.array([WINDOWS] * len(ends), pa.int32()), "to": table.column("to"), "bucket": table.column("bucket"),
                     "blob": pa.array([R.pack(often=x.astype(np.uint8)) for x in np.split(often, ends[:-1])], pa.binary())})


def confirmed_places(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts and first words of the confirmed windows of a bucket, in order."""
    kind, to, blobs = (table.column(c).to_pylist() for c in ("kind", "to", "blob"))
    masks = {t: R.unpack(x, np.uint8)[0] for k, t, x in zip(kind, to, blobs) if k == WINDOWS}
    own = [R.opened(x, "<u4", "<u4") for k, x in zip(kind, blobs) if k == PLACES]
    if not own or not masks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tag, place, number = own[0]
    often = np.concatenate([masks[t] for t in sorted(masks)]) > 0     # windows are numbered in the order of shards
    hit = often[number]
    return tag[hit], place[hit].astype(np.int64)


def removed(window: int, digest: bool, buckets: int):
    """Of a bucket: each distinct text's counts and what is kept of it."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, ids, raw = R.unique(left)
        tags = R.tags(left, len(keys), buckets)
        tag, place = confirmed_places(right)
        lo, hi = np.searchsorted(tag, tags), np.searchsorted(tag, tags, "right")
        n_words, n_removed, kept = [], [], []
        for t, a, b in zip(raw, lo.tolist(), hi.tolist()):
            words = t.split()
            n_words.append(len(words))
            if a < b:
                gone = R.covered(len(words), place[a:b], place[a:b] + window)
                n_removed.append(int(gone.sum()))
                words = [words[i] for i in np.flatnonzero(~gone)]
            else:
                n_removed.append(0)
            joined = b" ".join(words)
            kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
        return pa.table({"key": pa.array(keys, pa.binary()), "n_words": pa.array(n_words, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    return run


def dedup_phrases(df: DataFrame, window: int = WINDOW, phrase: int = PHRASE, digest: bool = False,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: the words that no recurring window covers, joined by one space.

    With ``digest``, ``kept`` is their SHA-256. All copies of a window go, the first too. A null or
    empty text has no words and nothing is removed. Repeated rows are copies of one another, whatever
    their ids; null ids come back as they are; other columns are not read; an empty table gives an
    empty one. Texts of any length are read whole: a bucket's texts bound a task's memory.
    """
    docs = R.keyed(df, doc_id, text)
    ids = stored(docs.select(F.col("id").alias("doc_id"), "key", F.octet_length("text").alias("n")), "keys")
    buckets = R.buckets(ids)
    texts = R.distinct_texts(docs, buckets)         # one exchange for the three that read it
    known = R.recurring(texts, buckets, anchor_hashes(window, phrase), within=True)
    found = stored(texts.groupBy("bucket").cogroup(known.groupBy("bucket"))
                   .applyInArrow(candidates(window, phrase, buckets, buckets), SENT), "candidates")
    masks = found.where(F.col("kind") == WINDOWS).groupBy("to").applyInArrow(confirmed, SENT)
    back = masks.union(found.where(F.col("kind") == PLACES))
    results = (texts.groupBy("bucket").cogroup(back.groupBy("bucket"))
               .applyInArrow(removed(window, digest, buckets), "key binary, n_words long, n_removed long, kept string"))
    results = results.join(ids.groupBy("key").agg(F.count("*").alias("copies")), "key")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= window)
    nothing = hashlib.sha256(b"").hexdigest() if digest else ""
    results = results.select("key", "n_words", F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
                             F.when(whole, nothing).otherwise(F.col("kept")).alias("kept"))
    return ids.select("doc_id", "key").join(results, "key").select("doc_id", "n_words", "n_removed", "kept")
