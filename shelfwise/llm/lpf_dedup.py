"""Operator 5: exact substring dedup by longest-previous-factor arrays of sharded suffix orders.

A byte goes if it lies in a string of ``window`` bytes that also starts in a document with a smaller
id. Only the surroundings of recurring anchors (see ``repeats``) can hold such strings. Each anchor
occurrence becomes a segment: the bytes of the windows that it is the anchor of. Segments with the
same anchor meet in one shard, which is then complete for these windows.

In a shard, equal segments are told first: all but those of the least id go whole. Of the distinct
segments that share an anchor, the suffixes that begin a window are put in order, with the prefix that
each shares with the one before (order and prefixes up to ``window`` bytes: longer ones count the
same). The previous and the next smaller value of the ids along that order give each suffix its
longest previous factor: the longest string that it shares with one of an earlier document. Where that
reaches ``window`` bytes, the window goes.

An anchor with very many occurrences (``repeats.CROWDED``) is split: its windows become segments of
their own, dealt by their content, so that a passage in a third of all documents is spread, and what
is equal in a bucket is sent once. Whole copies take part once and go whole if they are long enough.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from .base import stored

WINDOW, GRAM = 50, 16
#: Suffixes that are put in order at a time.
SUFFIXES = 1 << 19
#: Segments that are cut out of the texts at a time.
SEGMENTS = 1 << 16


def loads(buffer: np.ndarray, at: np.ndarray | slice, order: str = "<") -> np.ndarray:
    """The 8 bytes from each place as a number."""
    return np.ndarray((len(buffer) - 7,), f"{order}u8", buffer, 0, (1,))[at]


class Bytes:
    """Hashes of the grams of some texts, put one after another."""

    def __init__(self, raw: list[bytes], window: int, gram: int):
        self.buffer = np.frombuffer(b"".join(raw) + bytes(2 * window), np.uint8)
        n = sum(map(len, raw))
        length = np.array([len(t) for t in raw], np.int64)
        self.first = np.cumsum(length) - length
        self.doc = np.repeat(np.arange(len(raw)), length)
        self.grams = np.zeros(n, np.uint64)
        for at in [*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
            self.grams = R.mixed(self.grams * R.MIX1 + loads(self.buffer, slice(at, at + n)))
        self.valid = np.zeros(max(n - window + 1, 0), bool)
        if len(self.valid):
            self.valid = self.doc[:n - window + 1] == self.doc[window - 1:]


def sliced(raw: list[bytes], window: int):
    """Groups of slices of the texts, with each slice's text and place: every window lies in one slice.

    So a long text is worked on in pieces like short ones.
    """
    slices, of, at = [], [], []
    for k, t in enumerate(raw):
        for a in range(0, max(len(t) - window + 1, 0), R.PIECE):
            slices.append(t[a:a + R.PIECE + window - 1])
            of.append(k)
            at.append(a)
    for part in R.pieces([len(t) for t in slices]):
        yield slices[part], np.array(of[part]), np.array(at[part])


def anchor_hashes(window: int, gram: int):
    def hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for slices, of, _ in sliced(raw, window):
            x = Bytes(slices, window, gram)
            place, _, _ = R.anchors(x.grams, window - gram + 1, x.valid)
            place = np.unique(place)
            h.append(x.grams[place])
            doc.append(of[x.doc[place]])
        return np.concatenate(h), np.concatenate(doc)

    return hashes


def segments(window: int, gram: int, shards: int, buckets: int):
    """Of a bucket: segments by shard; and, under shard numbers from ``shards`` on, spans that are already known to go."""
    width, before = 2 * window - gram, window - gram  # of a segment, and of it before the anchor
    column = np.arange(width)

    def bodies(padded, place, lo, hi) -> np.ndarray:
        """Segments: the bytes of the windows from ``lo`` to ``hi``, zeros around them, and the two numbers."""
        body = np.where((column >= lo[:, None]) & (column < hi[:, None] + window), padded[place[:, None] + column], 0).astype(np.uint8)
        return np.concatenate([body, lo[:, None].astype(np.uint8), hi[:, None].astype(np.uint8)], 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, ids, raw = R.unique(left)
        tags, (known, crowded) = R.tags(left, len(keys), buckets), R.known(right)
        got = []
        for slices, of, offset in sliced(raw, window) if len(known) else ():
            x = Bytes(slices, window, gram)
            place, first, last = R.anchors(x.grams, before + 1, x.valid)
            hit = R.among(x.grams[place], known)
            place, first, last = place[hit], first[hit], last[hit]
            split = R.among(x.grams[place], crowded)
            alone = np.zeros(len(place), bool)
            if split.any():  # their windows become segments of their own
                n = (last - first + 1)[split]
                each = R.ranges(first[split], last[split])
                place = np.concatenate([place[~split], np.repeat(place[split], n)])
                first, last = np.concatenate([first[~split], each]), np.concatenate([last[~split], each])
                alone = np.arange(len(place)) >= (~split).sum()
            padded = np.concatenate([np.zeros(before, np.uint8), x.buffer])
            for k in range(0, len(place), SEGMENTS):
                p, f, e, own_shard = (v[k:k + SEGMENTS] for v in (place, first, last, alone))
                body = bodies(padded, p, f - p + before, e - p + before)
                shard = (x.grams[p] % np.uint64(shards)).astype(np.int64)
                if own_shard.any():
                    shard[own_shard] = (content_hash(body[own_shard]) % np.uint64(shards)).astype(np.int64)
                local = x.doc[p]
                got.append(collapsed(body, shard, ids[of[local]], tags[of[local]], (f - x.first[local] + offset[local]).astype("<u4")))
        out_shard, out_blob = [], []
        if got:
            body, shard, own, tag, n, start = (np.concatenate([g[i] for g in got]) for i in range(6))
            del got
            begin = np.cumsum(n) - n
            gone, _, _ = later_copies(body, own)
            if gone.any():
                at = np.flatnonzero(gone)
                for bucket, of in R.split(R.bucket_of(tag[at], buckets)):
                    of = at[of]
                    from_ = start[R.ranges(begin[of], begin[of] + n[of] - 1)]
                    length = np.repeat(body[of, -1].astype(np.int64) - body[of, -2] + window, n[of])
                    out_shard.append(shards + bucket)
                    out_blob.append(R.tagged(np.repeat(tag[of], n[of]), start=from_, end=(from_ + length).astype("<u4")))
            at = np.flatnonzero(~gone)
            for s, of in R.split(shard[at]):
                of = at[of]
                out_shard.append(s)
                out_blob.append(R.tagged(tag[of], body=body[of].ravel(), own=own[of].astype("<i8"), times=n[of].astype("<u4"),
                                         start=start[R.ranges(begin[of], begin[of] + n[of] - 1)]))
        return pa.table({"shard": pa.array(out_shard, pa.int64()), "blob": pa.array(out_blob, pa.binary())})

    return run


def content_hash(body: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    view = np.ascontiguousarray(np.concatenate([body, np.zeros((len(body), -body.shape[1] % 8), np.uint8)], 1)).view("<u8")
    out = np.zeros(len(body), np.uint64)
    for k in range(view.shape[1]):
        out = R.joined(out, view[:, k])
    return out


def collapsed(body, shard, own, tag, start) -> tuple[np.ndarray, ...]:
    """Equal segments of one text as one row: their number, and their places one after another."""
    order = np.lexsort((start, content_hash(body), tag))
    body, tag = body[order], tag[order]
    new = np.flatnonzero(np.concatenate([[True], (tag[1:] != tag[:-1]) | (body[1:] != body[:-1]).any(1)]))
    return body[new], shard[order][new], own[order][new], tag[new], np.diff(np.append(new, len(tag))), start[order]


def later_copies(body: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which segments equal one of a smaller id; the order of segments by content and id, and where a content begins in it.

    Contents are put in order by their hash and compared byte by byte. Should two have one hash, a content
    may begin more than once; its windows are then told by the suffix order.
    """
    order = np.lexsort((own, content_hash(body)))
    same = np.concatenate([[False], (body[order][1:] == body[order][:-1]).all(1)]) if len(order) else np.zeros(0, bool)
    starts = np.flatnonzero(~same)
    least = np.repeat(own[order][starts], np.diff(np.append(starts, len(order))))
    gone = np.zeros(len(own), bool)
    gone[order] = own[order] > least
    return gone, order, starts


def common_prefixes(chunks: list[np.ndarray], offsets: list[int]) -> np.ndarray:
    """How many leading bytes each suffix has in common with the one before it; 0 for the first.

    ``chunks`` has eight bytes of each suffix from each offset on, as big-endian numbers.
    """
    n = len(chunks[0])
    out, open_ = np.zeros(n, np.uint8), np.ones(max(n - 1, 0), bool)
    for x, at in zip(chunks, offsets):
        other = x[1:] ^ x[:-1]
        same = np.full(len(other), 8, np.uint8)
        for k in range(8):  # a number below 256 ** k has 8 - k leading zero bytes
            same -= other >= np.uint64(1 << 8 * k)
        out[1:][open_] = at + same[open_]
        open_ &= other == 0
    return out


def smaller_before(rank: np.ndarray, prefix: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each asked place, the common prefix with the nearest place before it that has a smaller rank; 0 without one.

    Least ranks and prefixes of stretches of 1, 2, 4 ... places are tables; a place steps back over
    stretches without a smaller rank, the long ones first, and keeps the least prefix on its way.
    """
    n = len(rank)
    ranks, prefixes = [rank], [prefix]
    while 2 << (len(ranks) - 1) <= n:
        have = 1 << (len(ranks) - 1)
        ranks.append(np.minimum(ranks[-1][:-have], ranks[-1][have:]))
        prefixes.append(np.minimum(prefixes[-1][:-have], prefixes[-1][have:]))
    own, at, low = rank[asked], asked.copy(), np.full(len(asked), 255, np.uint8)
    for k in range(len(ranks) - 1, -1, -1):
        to = at - (1 << k)
        over = to >= 0
        over[over] = ranks[k][to[over]] >= own[over]
        low[over] = np.minimum(low[over], prefixes[k][to[over] + 1])
        at[over] = to[over]
    return np.where(at > 0, np.minimum(low, prefix[at]), 0).astype(np.uint8)


def previous_factors(suffix: list[np.ndarray], offsets: list[int], own: np.ndarray, least: int = 0) -> np.ndarray:
    """The longest previous factor of each suffix, up to the window: from its neighbours of smaller id in suffix order.

    The order is that of the window's bytes. The longest prefix that a suffix shares with one of a
    smaller id is the one it shares with the nearest such suffix before or after it, the previous or
    next smaller value of the ids along the order; in between, prefixes only get shorter. No factor is
    longer than the prefix that a suffix shares with its direct neighbours, so one of less than
    ``least`` is not asked for, and counts as 0.
    """
    n = len(own)
    if not n:
        return np.zeros(0, np.uint8)
    order = np.lexsort(suffix[::-1])
    prefix = common_prefixes([x[order] for x in suffix], offsets)
    rank = np.unique(own, return_inverse=True)[1].astype(np.int32)[order]
    after = np.append(prefix[1:], np.uint8(0))
    asked = np.flatnonzero(np.maximum(prefix, after) >= least)
    before = smaller_before(rank, prefix, asked)
    backward = np.append(np.uint8(0), prefix[1:][::-1])  # the same order from its end
    behind = smaller_before(rank[::-1].copy(), backward, n - 1 - asked)
    out = np.zeros(n, np.uint8)
    out[order[asked]] = np.maximum(before, behind)
    return out


def factored(window: int, gram: int, shards: int, buckets: int):
    """Of a shard: spans to remove, by bucket."""
    width, before = 2 * window - gram, window - gram
    offsets = [*range(0, window - 7, 8), *([window - 8] if window % 8 else [])]

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        blobs = table.column("blob").to_pylist()
        if shard >= shards:  # known before
            return pa.table({"bucket": pa.array([shard - shards] * len(blobs), pa.int64()), "spans": pa.array(blobs, pa.binary())})
        got = [R.opened(b, np.uint8, "<i8", "<u4", "<u4") for b in blobs]
        tag, body, own, times, start = (np.concatenate([x[i] for x in got]) for i in range(5))
        del got, blobs
        body, times = body.reshape(-1, width + 2), times.astype(np.int64)
        begin_at = np.cumsum(times) - times
        gone, order, starts = later_copies(body, own)
        # distinct segments, and the occurrences with the least id of each
        content = np.zeros(len(own), np.int64)
        content[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        first = order[starts]
        one, least = body[first], own[first]
        lo, hi = one[:, -2].astype(np.int64), one[:, -1].astype(np.int64)
        anchor = np.ascontiguousarray(one[:, before:before + gram]).view(f"S{gram}").ravel()
        _, group, members = np.unique(anchor, return_inverse=True, return_counts=True)
        found_c, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        open_ = np.flatnonzero(members[group] > 1)
        open_ = open_[np.argsort(group[open_], kind="stable")]
        n = (hi - lo + 1)[open_]
        flat = np.concatenate([np.ascontiguousarray(one[:, :width]).ravel(), np.zeros(8, np.uint8)])
        for piece in whole_groups(group[open_], n, SUFFIXES):
            c = np.repeat(open_[piece], n[piece])
            j = np.repeat(lo[open_[piece]], n[piece]) + np.arange(n[piece].sum()) - np.repeat(np.cumsum(n[piece]) - n[piece], n[piece])
            at = c * width + j
            hit = previous_factors([loads(flat, at + o, ">") for o in offsets], offsets, least[c], window) >= window
            found_c.append(c[hit])
            found_j.append(j[hit])
        c, j = np.concatenate(found_c), np.concatenate(found_j)
        order = np.lexsort((j, c))
        c, j = c[order], j[order]
        # neighbouring windows of a segment make one span
        begin = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (j[1:] != j[:-1] + 1)])) if len(c) else np.zeros(0, np.int64)
        stop = np.append(begin[1:], len(c)) - 1
        run_c, run_lo, run_hi = c[begin], j[begin], j[stop] + window if len(c) else j
        # each row with the least id has its content's spans, at all its places
        keep = np.flatnonzero(~gone)
        keep = keep[np.argsort(content[keep], kind="stable")]
        a, b = np.searchsorted(content[keep], run_c), np.searchsorted(content[keep], run_c, "right")
        row = keep[R.ranges(a, b - 1)]
        run = np.repeat(np.arange(len(run_c)), b - a)
        late = np.flatnonzero(gone)
        row, lo_, hi_ = (np.concatenate([x, y]) for x, y in (
            (row, late), (run_lo[run], body[late, -2].astype(np.int64)), (run_hi[run], body[late, -1].astype(np.int64) + window)))
        n = times[row]
        from_ = start[R.ranges(begin_at[row], begin_at[row] + n - 1)].astype(np.int64) - np.repeat(body[row, -2].astype(np.int64), n)
        tag, from_, to = np.repeat(tag[row], n), from_ + np.repeat(lo_, n), from_ + np.repeat(hi_, n)
        ids, out = [], []
        for bucket, at in R.split(R.bucket_of(tag, buckets)):
            at = at[np.lexsort((from_[at], tag[at]))]
            ids.append(bucket)
            out.append(R.tagged(tag[at], start=from_[at].astype("<u4"), end=to[at].astype("<u4")))
        return pa.table({"bucket": pa.array(ids, pa.int64()), "spans": pa.array(out, pa.binary())})

    return run


def whole_groups(group: np.ndarray, n: np.ndarray, limit: int):
    """Slices of whole groups with about ``limit`` suffixes; a larger group stands alone."""
    if not len(group):
        return
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    total = np.add.reduceat(n, starts)
    at, have = 0, 0
    for k, t in enumerate(total):
        if have and have + t > limit:
            yield slice(starts[at], starts[k])
            at, have = k, 0
        have += t
    yield slice(starts[at], len(group))


def removed(window: int, digest: bool, buckets: int = 1):
    """Of a bucket: what is kept of each distinct text."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, ids, raw = R.unique(left)
        tags = R.tags(left, len(keys), buckets)
        tag, start, end = R.spans_of(right, "spans", "<u4", "<u4")
        lo, hi = np.searchsorted(tag, tags), np.searchsorted(tag, tags, "right")
        n_removed, n_spans, kept = [], [], []
        for t, a, b in zip(raw, lo.tolist(), hi.tolist()):
            n_out = runs = 0
            if a < b:
                gone = R.covered(len(t), start[a:b].astype(np.int64), end[a:b].astype(np.int64))
                n_out = int(gone.sum())
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                t = np.frombuffer(t, np.uint8)[~gone].tobytes()
            n_removed.append(n_out)
            n_spans.append(runs)
            kept.append(hashlib.sha256(t).hexdigest() if digest else t)
        return pa.table({"key": pa.array(keys, pa.binary()), "least": pa.array(ids, pa.int64()), "n_bytes": pa.array([len(t) for t in raw], pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()),
                         "kept": pa.array(kept, pa.string() if digest else pa.binary())})

    return run


def dedup_bytes(df: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: each text's bytes without what an earlier document has.

    With ``digest``, ``kept`` is the SHA-256 of the remaining bytes (which need not be whole
    characters), else the bytes. ``n_spans`` counts maximal removed runs. A null or empty text has no
    bytes. A row without an id comes after all others (but for the largest long), and such rows are not earlier than one another.
    Repeated rows with one id are not earlier than one another either. Other columns are not read; an
    empty table gives an empty one. A bucket's texts and a shard's segments bound a task's memory.
    """
    if gram < 8 or window < gram + 1 or 2 * window - gram > 255:
        raise ValueError("grams have 8 bytes or more, windows more than a gram, segments 255 at most")
    docs = R.keyed(df, doc_id, text)
    ids = stored(docs.select("id", "doc_id", "key", F.octet_length("text").alias("n")), "keys")
    buckets = R.buckets(ids)
    texts = R.distinct_texts(docs, buckets)         # one exchange for the three that read it
    known = R.recurring(texts, buckets, anchor_hashes(window, gram), within=False)
    found = (texts.groupBy("bucket").cogroup(known.groupBy("bucket"))
             .applyInArrow(segments(window, gram, buckets, buckets), "shard long, blob binary"))
    spans = found.groupBy("shard").applyInArrow(factored(window, gram, buckets, buckets), "bucket long, spans binary")
    results = (texts.groupBy("bucket").cogroup(spans.groupBy("bucket"))
               .applyInArrow(removed(window, digest, buckets), f"key binary, least long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}"))
    later = (F.col("doc_id") > F.col("least")) & (F.col("n_bytes") >= window)
    nothing = F.lit(hashlib.sha256(b"").hexdigest()) if digest else F.lit(bytearray())
    return ids.select("id", "doc_id", "key").join(results, "key").select(
        F.col("id").alias("doc_id"), "n_bytes",
        F.when(later, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(later, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(later, nothing).otherwise(F.col("kept")).alias("kept"))
