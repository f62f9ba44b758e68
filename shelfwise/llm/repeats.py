"""Shared steps of the two substring operators: distinct texts, anchors, and where they recur.

Windows (of bytes or words) that occur twice must be found without sending every window. A window's
anchor is its gram with the least hash, the leftmost of equals: equal windows have equal anchors at
equal places, and neighbouring windows mostly share one, so anchors are about ``2 / (grams a window)``
of all places. Three exchanges follow, each of small packed arrays or of texts:

* ``distinct_texts`` deals the texts, equal ones once, to buckets of a bounded size;
* ``recurring`` deals the hashes of each bucket's anchors to shards, a hash once a bucket with its
  count, keeps those that occur in two different texts, or twice in one if asked for, and sends them
  back to the buckets that have them. So an anchor in a third of all texts is a row for each bucket;
* the operator compares what surrounds the recurring anchors, exactly.

Texts are told apart by their MD5, so whole copies meet in one bucket and take part once. Within a
bucket a text's number is its place in the order of these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import shuffle_parts, sub_batches, texts

#: Bytes of text in a bucket and of the pieces in which it is worked on.
BUCKET, PIECE = 16 << 20, 2 << 20
#: An anchor with more occurrences is crowded: what surrounds it must not go to one task.
CROWDED = 200_000
#: Keys that a task remembers to leave out copies before the shuffle.
REMEMBERED = 1 << 17
NO_ID = np.iinfo(np.int64).max

MIX1, MIX2, MIX3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit number of each 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x ^= x >> np.uint64(27)
    x *= MIX3
    x ^= x >> np.uint64(31)
    return x


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two neighbours from theirs."""
    return mixed(left * MIX1 + right)


def keyed(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, doc_id, text, key``: the id as it is, and one to compare by, where a null id counts as the largest number."""
    docs = texts(df, doc_id, text)
    return docs.select(F.col("doc_id").alias("id"), F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc_id"), "text", F.unhex(F.md5("text")).alias("key"))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """``key``: the first 8 bytes of the texts' keys as numbers, or ``tags``."""
    return (key % np.uint64(buckets)).astype(np.int64)


def buckets(ids: DataFrame) -> int:
    """The number of buckets and shards for texts whose bytes ``n`` are given."""
    total = ids.agg(F.sum("n").alias("n")).first()["n"] or 0
    return max(shuffle_parts(ids.sparkSession), total // BUCKET + 1)


def numbers(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), "<u8").astype(np.uint64)


def distinct_texts(docs: DataFrame, buckets: int) -> DataFrame:
    """``bucket, key, doc_id, text``: each task sends a text once, and a copy's smaller id without its text."""
    def run(batches):
        seen: dict[bytes, int] = {}
        for b in batches:
            keys, ids = b.column("key").to_pylist(), b.column("doc_id").to_pylist()
            take, bare = [], []
            for i, (k, d) in enumerate(zip(keys, ids)):
                had = seen.get(k)
                if had is None:
                    take.append(i)
                elif d < had:
                    bare.append(i)
                else:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[k] = d
            text = b.column("text")
            for rows, t in ((take, text.take(pa.array(take, pa.int32()))), (bare, pa.nulls(len(bare), pa.string()))):
                if rows:
                    k = [keys[i] for i in rows]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket_of(numbers(k), buckets)), pa.array(k, pa.binary()), pa.array([ids[i] for i in rows], pa.int64()),
                         t.cast(pa.string())], ["bucket", "key", "doc_id", "text"])

    return docs.select("key", "doc_id", "text").mapInArrow(run, "bucket long, key binary, doc_id long, text string")


def unique(table: pa.Table) -> tuple[list[bytes], np.ndarray, list[bytes]]:
    """Keys, least ids and UTF-8 texts of a bucket of ``distinct_texts``."""
    text, least = {}, {}
    for k, d, t in zip(table.column("key").to_pylist(), table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()):
        if t is not None:
            text[k] = t
        least[k] = min(d, least.get(k, d))
    keys = sorted(text)
    return keys, np.array([least[k] for k in keys], np.int64), [text[k] for k in keys]


def tags(table: pa.Table, n: int, buckets: int) -> np.ndarray:
    """A number for each of a bucket's n distinct texts, in the order of ``unique``; ``bucket_of`` tells the bucket from it."""
    bucket = table.column("bucket")[0].as_py() if "bucket" in table.column_names and len(table) else 0
    return np.arange(n, dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)


def pieces(lengths: list[int]):
    """Slices of about ``PIECE`` bytes."""
    return sub_batches(lengths, PIECE)


def anchors(grams: np.ndarray, width: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, and the first and last window that each has.

    Window p has the grams p to p + width - 1; ``valid`` says which windows there are.
    """
    n = len(valid)
    if not n or not valid.any():
        return (np.zeros(0, np.int64),) * 3
    least = ((grams >> np.uint64(31)) << np.uint64(31)).view(np.int64) & np.int64(0x7FFFFFFFFFFFFFFF) | np.arange(len(grams), dtype=np.int64)
    have = 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[:len(least) - (width - have)], least[width - have:])
    at = np.flatnonzero(valid)
    place = least[at] & np.int64(0x7FFFFFFF)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.append(first[1:], len(at)) - 1
    return place[first], at[first], at[last]


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    import zstandard

    head = b"".join(len(a).to_bytes(8, "little") for a in arrays.values())
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values()))


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(types), []
    for i, t in enumerate(types):
        n = int.from_bytes(raw[8 * i:8 * i + 8], "little")
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def split(by: np.ndarray):
    """(value, places) of an array's values, in order."""
    order = np.argsort(by, kind="stable")
    values = by[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    for s, e in zip(starts, np.append(starts[1:], len(values))):
        yield int(values[s]), order[s:e]


def short(h: np.ndarray) -> np.ndarray:
    """The upper 40 bits, in five bytes each; the shard that they go to says a few bits more."""
    return np.ascontiguousarray(h).astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:]


def long(h: np.ndarray) -> np.ndarray:
    out = np.zeros((len(h) // 5, 8), np.uint8)
    out[:, 3:] = h.reshape(-1, 5)
    return out.view("<u8").ravel() >> np.uint64(24)


def recurring(texts: DataFrame, shards: int, hashes, within: bool) -> DataFrame:
    """``bucket, hashes``: packed hashes (40 bits) that occur in two different texts, or twice if ``within``.

    ``texts`` are ``distinct_texts``; ``hashes(texts)`` gives the anchors' hashes of a list of texts,
    and for each the number of its text.
    """
    def send(table: pa.Table) -> pa.Table:
        _, _, raw = unique(table)
        h, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for part in pieces([len(t) for t in raw]):
            own, of = hashes(raw[part])
            h.append(own)
            doc.append(of + part.start)
        h, doc = np.concatenate(h), np.concatenate(doc)
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(h))[:len(first)] - 1
        n = last - first + 1
        twice = (n > 1) if within else doc[first] != doc[last]
        h = h[first]
        ids, blobs = [], []
        for s, at in split((h % np.uint64(shards)).astype(np.int64)):
            ids.append(s)
            blobs.append(pack(h=short(h[at]).ravel(), n=n[at].astype("<u4"), twice=twice[at].astype(np.uint8)))
        return pa.table({"shard": pa.array(ids, pa.int64()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(ids), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def find(table: pa.Table) -> pa.Table:
        got = [unpack(x, np.uint8, "<u4", np.uint8) for x in table.column("blob").to_pylist()]
        h = np.concatenate([long(x[0]) for x in got])
        n, twice = (np.concatenate([x[i] for x in got]) for i in (1, 2))
        bucket = np.repeat(table.column("bucket").to_numpy(), [len(x[1]) for x in got])
        del got
        order = np.argsort(h, kind="stable")
        h, n, twice, bucket = h[order], n[order], twice[order], bucket[order]
        group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
        often = (np.bincount(group) > 1) | (np.bincount(group, weights=twice) > 0)
        crowded = (np.bincount(group, weights=n) > CROWDED)[group]
        take = often[group]
        h, crowded, bucket = h[take], crowded[take], bucket[take]
        ids, blobs = [], []
        for to, at in split(bucket):
            own, first = np.unique(h[at], return_index=True)
            ids.append(to)
            blobs.append(pack(h=own, crowded=crowded[at][first].astype(np.uint8)))
        return pa.table({"bucket": pa.array(ids, pa.int64()), "hashes": pa.array(blobs, pa.binary())})

    sent = texts.groupBy("bucket").applyInArrow(send, "shard long, bucket long, blob binary")
    return sent.groupBy("shard").applyInArrow(find, "bucket long, hashes binary")


def known(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All hashes that ``recurring`` sent to a bucket, sorted, and those of them that are crowded."""
    got = [unpack(x, "<u8", np.uint8) for x in table.column("hashes").to_pylist()]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h, crowded = (np.concatenate([x[i] for x in got]) for i in (0, 1))
    return np.unique(h), np.unique(h[crowded > 0])


def among(h: np.ndarray, sorted_known: np.ndarray) -> np.ndarray:
    """Which hashes' upper 40 bits are known."""
    if not len(sorted_known):
        return np.zeros(len(h), bool)
    h = h >> np.uint64(24)
    at = np.minimum(np.searchsorted(sorted_known, h), len(sorted_known) - 1)
    return sorted_known[at] == h


def tagged(tag: np.ndarray, **arrays: np.ndarray) -> bytes:
    """Packed arrays with the texts' numbers, sent once for each run of them; ``opened`` takes them apart."""
    runs = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]])) if len(tag) else np.zeros(0, np.int64)
    return pack(tag=tag[runs], n=np.diff(np.append(runs, len(tag))).astype("<u4"), **arrays)


def opened(blob: bytes, *types) -> list[np.ndarray]:
    tag, n, *rest = unpack(blob, "<u8", "<u4", *types)
    return [np.repeat(tag, n), *rest]


def spans_of(table: pa.Table, column: str, *types) -> list[np.ndarray]:
    """The arrays of all blobs of a bucket, put in the order of the texts' numbers."""
    got = [opened(x, *types) for x in table.column(column).to_pylist()]
    if not got:
        return [np.zeros(0, np.uint64), *(np.zeros(0, t) for t in types)]
    both = [np.concatenate([x[i] for x in got]) for i in range(len(types) + 1)]
    order = np.argsort(both[0], kind="stable")
    return [x[order] for x in both]


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All whole numbers from each first to its last (none if that is smaller)."""
    n = last - first + 1
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge)[:n] > 0
