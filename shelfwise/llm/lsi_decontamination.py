"""Operator 6: benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all passages (blocks of ``BLOCK`` words), in one scan.
2. A randomised SVD of the TF-IDF rows of every passage of every document and of the benchmark, written
   once as lists of features: Spark sums the products (feature by sketch, then sketch by sketch), the
   driver only factors matrices of a fixed size.
3. The benchmark is the query set, in blocks of a bounded size, many of them in a scan. A scan projects
   every passage (two neighbouring blocks) of every document into the latent space once and takes the
   benchmark passages of all blocks within a cosine as candidates. Those that share too little weight with the item in the full
   feature space are let go; the others are confirmed on the words: the longest common subsequence
   of the item and the surroundings of the passage, and whether the item's answer (its last words)
   is there too. Or a part of the item is there nearly as it is: a high share of ``PART`` of its words
   in a row.
4. The same scan looks up each run of ``SEED`` words among the items', so a verbatim part of ``RUN``
   words, wherever it is in the item, is found whatever its cosine. Items of fewer words have shorter
   runs, down to whole items of ``SHORTEST`` words.

Every direction of the latent space counts the same (its coordinates are divided by their spread), and
rare words count with the square of their inverse document frequency. Otherwise the languages and the
frequent words fill the first directions, and all passages of a language are near one another.

Words are compared without case and ASCII punctuation, so a changed mark or case hides nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, stored
from . import repeats as R
from .base import texts
from .phrase_automata import Words

BLOCK = 16
FEATURES = 1 << 14
RANK, OVERSAMPLING = 96, 16
#: Words of benchmark text in a block and in all blocks of one scan; a shorter item counts as ``ITEM_WORDS``, so their number is bounded too.
QUERY_WORDS, SCAN_WORDS, ITEM_WORDS = 25_000, 250_000, 40
ANSWER = 6
SHARED = 0.3
#: Words of an item in a row that give it away (of a short item, ``RUN_SHARE`` of its words, of one under ``SEED`` words all),
#: found from runs of ``SEED`` or that many. An item under ``SHORTEST`` words has no run: too many texts hold it by chance.
RUN, RUN_SHARE, SEED, SHORTEST = 14, 0.7, 10, 5
#: Neighbouring words of an item, and the share of them in a common subsequence that gives it away.
PART, PART_STEP, PART_SHARE = 20, 5, 0.8

PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 0x20 for c in range(256))


def plain(text: str) -> bytes:
    return text.lower().encode().translate(PLAIN)


class Blocks:
    """Words of some texts in rows of ``BLOCK``; ``FEATURES`` fills up a text's last row."""

    def __init__(self, values: list[str]):
        words = Words([plain(t) for t in values])
        self.hash, self.first = words.hash, np.append(words.first, len(words.hash))
        n = np.diff(self.first)
        self.rows = -(-n // BLOCK)  # of each text
        self.row0 = np.cumsum(self.rows) - self.rows
        self.doc = np.repeat(np.arange(len(values)), self.rows)
        place = np.arange(len(self.hash)) - np.repeat(self.first[:-1], n)
        feature = np.full(self.rows.sum() * BLOCK, FEATURES, np.int32)
        feature[np.repeat(self.row0 * BLOCK, n) + place] = (self.hash >> np.uint64(11)) % np.uint64(FEATURES)
        self.feature = feature.reshape(-1, BLOCK)

    def latent(self, factors: np.ndarray) -> np.ndarray:
        """The rows' sums of factors; ``factors`` has zeros for ``FEATURES``."""
        out = np.zeros((len(self.feature), factors.shape[1]), np.float32)
        for at in range(0, len(out), 4096):
            f, sum_ = self.feature[at:at + 4096], out[at:at + 4096]
            for j in range(BLOCK):
                sum_ += factors[f[:, j]]
        return out


def frequencies(feature: np.ndarray) -> np.ndarray:
    """In how many rows each feature is."""
    rows = np.sort(feature, 1)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    return np.bincount(rows[new], minlength=FEATURES + 1)[:FEATURES]


def pieces(values: list[str]):
    return R.sub_batches([len(t) for t in values], 2 << 20)


def totals(df: DataFrame) -> np.ndarray:
    """The sum of equally long arrays of doubles, given as ``part, blob`` rows of their equal parts."""
    def add(table: pa.Table) -> pa.Table:
        out = 0
        for x in table.column("blob").to_pylist():
            out = out + np.frombuffer(x)
        return pa.table({"part": table.column("part")[:1], "blob": pa.array([out.tobytes()], pa.binary())})

    got = df.groupBy("part").applyInArrow(add, "part long, blob binary").collect()
    return np.concatenate([np.frombuffer(r.blob) for r in sorted(got, key=lambda r: r.part)]) if got else np.zeros(0)


def parted(x: np.ndarray, parts: int = 16) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int64()), pa.array([np.ascontiguousarray(p).tobytes() for p in np.array_split(x.ravel().astype(float), parts)], pa.binary())], ["part", "blob"])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Of all rows of all documents: in how many each feature is, and how many there are."""
    def run(batches):
        count, n = np.zeros(FEATURES), 0
        for b in batches:
            values = b.column("text").to_pylist()
            for part in pieces(values):
                x = Blocks(values[part])
                count += frequencies(x.feature)
                n += len(x.feature)
        yield parted(np.append(count, n))

    out = totals(docs.select("text").mapInArrow(run, "part long, blob binary"))
    return (out[:-1], int(out[-1])) if len(out) else (np.zeros(FEATURES), 0)


def passages(docs: DataFrame) -> DataFrame:
    """``f``: the features of each passage of every document: pairs of rows one after another, at last the last two; every word is in one."""
    def run(batches):
        for b in batches:
            values = b.column("text").to_pylist()
            for part in pieces(values):
                x = Blocks(values[part])
                rows, place = x.rows[x.doc], np.arange(len(x.doc)) - x.row0[x.doc]
                head = np.flatnonzero((place % 2 == 0) & (place + 1 < rows) | (rows % 2 == 1) & (place == np.maximum(rows - 2, 0)))
                after = np.where((rows[head] > 1)[:, None], x.feature[np.minimum(head + 1, len(x.feature) - 1)], FEATURES)
                both = np.concatenate([x.feature[head], after], 1)
                own = both < FEATURES
                first = np.append(0, np.cumsum(own.sum(1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(first), pa.array(both[own]))], ["f"])

    return docs.select("text").mapInArrow(run, "f array<int>")


def add_rows(z: np.ndarray, at: np.ndarray, row: np.ndarray, y: np.ndarray, often: int = 32) -> None:
    """Add ``y[row]`` to ``z[at]``: by a product for the places that are there more than ``often`` times, else all first ones, all second ones and so on."""
    n = np.bincount(at, minlength=len(z))
    dense = np.flatnonzero(n > often)
    code = np.full(len(z), -1)
    code[dense] = np.arange(len(dense))
    code = code[at]
    if len(dense):
        has = np.bincount((row * len(dense) + code)[code >= 0], minlength=len(y) * len(dense)).reshape(len(y), -1)
        z[dense] += has.T.astype(y.dtype) @ y
    at, row = at[code < 0], row[code < 0]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[:len(at)])
    n = np.diff(np.append(first, len(at)))
    for k in range(n.max(initial=0)):
        some = first[n > k] + k
        z[at[some]] += y[row[some]]


def randomised_svd(rows: DataFrame, weight: np.ndarray, rank: int, seed: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Right singular vectors (features by ``rank``) of the normalised TF-IDF rows ``f``, the root mean square along each, and the mean row.

    Two distributed passes over the rows; the sums have a fixed size, a task each.
    """
    width = rank + OVERSAMPLING
    weight = np.append(weight[:FEATURES], 0.0)     # what fills up a row has none

    def product(batches, other):
        """Sparse rows times a matrix, some rows at a time: (places, each one's row, the rows' norms, the product)."""
        other = (np.append(other, np.zeros((1, width)), 0) * weight[:, None]).astype(np.float32)
        for b in batches:
            every, n = b.column("f").flatten().to_numpy(), np.diff(b.column("f").offsets.to_numpy())
            n = n[n > 0]
            begin = np.append(0, np.cumsum(n))
            for at in range(0, len(n), 2000):
                own = n[at:at + 2000]
                f, row = every[begin[at]:begin[at + len(own)]], np.repeat(np.arange(len(own)), own)
                wide = np.full((len(own), own.max()), FEATURES)
                wide[row, np.arange(len(f)) - np.repeat(np.cumsum(own) - own, own)] = f
                norm = np.maximum(np.sqrt((weight ** 2)[wide].sum(1)), 1e-9)
                y = np.zeros((len(own), width), np.float32)
                for j in range(wide.shape[1]):
                    y += other[wide[:, j]]
                yield f, row, norm, y / norm.astype(np.float32)[:, None]

    def sketch(batches):
        z, mean, count = np.zeros((FEATURES, width)), np.zeros(FEATURES), 0
        for f, row, norm, y in product(batches, np.random.default_rng(seed).standard_normal((FEATURES, width))):
            add_rows(z, f, row, y / norm.astype(np.float32)[:, None])
            mean += np.bincount(f, 1 / norm[row], FEATURES)
            count += len(y)
        yield parted(np.concatenate([(z * weight[:-1, None]).ravel(), mean * weight[:-1], [count]]))

    # few tasks: each one's sum has FEATURES x width numbers
    rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    first = totals(rows.mapInArrow(sketch, "part long, blob binary"))
    basis, _ = np.linalg.qr(first[:FEATURES * width].reshape(FEATURES, width))
    mean = first[FEATURES * width:-1] / max(first[-1], 1)

    def turn(batches):
        c = np.zeros((width, width))
        for _, _, _, y in product(batches, basis):
            c += y.T @ y
        yield parted(c)

    c = totals(rows.mapInArrow(turn, "part long, blob binary")).reshape(width, width)
    value, vector = np.linalg.eigh(c)
    first_ = np.argsort(-value)[:rank]
    return basis @ vector[:, first_], np.sqrt(np.maximum(value[first_], 1e-9) / max(first[-1], 1)), mean


class Latent:
    """The fitted space: features to factors, with a fixed size whatever the input."""

    def __init__(self, factors: np.ndarray, mean: np.ndarray):
        self.factors = np.concatenate([factors, np.zeros((1, factors.shape[1]))]).astype(np.float32)
        self.mean = mean.astype(np.float32)

    def units(self, sums: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Unit vectors of passages given as sums of factors and of squared weights, without the common part."""
        x = sums / np.maximum(np.sqrt(weight), 1e-9)[:, None] - self.mean
        return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-9)[:, None]


def fitted(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> tuple[Latent, np.ndarray]:
    """The latent space of all passages of the documents and the benchmark, and the features' weights (squared inverse document frequencies)."""
    count, n = document_frequencies(docs)
    weight = np.append((np.log((n + 1) / (count + 1)) + 0.1) ** 2, 0.0)
    rows = stored(passages(docs.select("text").union(benchmark.select("text"))), "passages")
    factors, spread, mean = randomised_svd(rows, weight, rank)
    forget(rows)
    factors /= spread
    return Latent(factors * weight[:-1, None], mean @ factors), weight


class Item:
    def __init__(self, item_id: int, words: np.ndarray):
        self.id, self.n = item_id, len(words)
        self.places: dict[int, int] = {}
        for i, w in enumerate(words.tolist()):
            self.places[w] = self.places.get(w, 0) | 1 << i
        self.answer = min(ANSWER, self.n)
        self.words = words
        self.run = self.n if self.n < SEED else min(RUN, -int(-RUN_SHARE * self.n // 1))
        self.seed = min(SEED, self.run) if self.n >= SHORTEST else None

    def common(self, words: list[int], least: float = 0.0) -> tuple[float, float]:
        """Shares of the item's words, and of its last ones, in a longest common subsequence with these; zeros if under ``least``."""
        found = [m for m in map(self.places.get, words) if m]
        if len(found) < least * self.n:
            return 0.0, 0.0
        share = subsequence(found, self.n) / self.n
        if share < least:
            return 0.0, 0.0
        shift = self.n - self.answer
        return share, subsequence([m >> shift for m in found], self.answer) / self.answer


    def part(self, words: list[int]) -> bool:
        """Is a share ``PART_SHARE`` of some ``PART`` neighbouring words of the item in a common subsequence?"""
        found, seen, need = [], 0, PART_SHARE * PART
        for w in words:
            if m := self.places.get(w):
                found.append(m)
                seen |= m
        if len(found) < need:
            return False
        last, mask = self.n - PART, (1 << PART) - 1
        for at in sorted({*range(0, last + 1, PART_STEP), last}) if last >= 0 else ():
            if ((seen >> at) & mask).bit_count() >= need and subsequence([x for m in found if (x := (m >> at) & mask)], PART) >= need:
                return True
        return False

    def longest(self, words: np.ndarray, at: int, own: int) -> int:
        """Words in a row that are the same around places ``at`` and ``own`` of some words and of the item."""
        left = right = 0
        while at - left and own - left and words[at - left - 1] == self.words[own - left - 1]:
            left += 1
        while at + right < len(words) and own + right < self.n and words[at + right] == self.words[own + right]:
            right += 1
        return left + right


class Seeds:
    """All runs of ``width`` words of the items that are looked up by such runs, by hash."""

    def __init__(self, items: list[Item], width: int = SEED):
        items = [(k, x) for k, x in enumerate(items) if x.seed == width]
        hashes = [seeds(x.words, width) for _, x in items]
        n = np.array([len(h) for h in hashes], np.int64)
        every = np.concatenate(hashes) if items else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.hash = every[order]
        self.item = np.repeat(np.array([k for k, _ in items], np.int64), n)[order]
        self.own = (np.arange(len(every)) - np.repeat(np.cumsum(n) - n, n))[order]
        self.maybe = np.zeros(1 << 20, bool)  # most runs are none: by the first bits
        self.maybe[self.hash >> np.uint64(44)] = True

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``hashes`` that an item has, the item, and where it has it; all pairs."""
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
        low, high = (np.searchsorted(self.hash, hashes[at], side) for side in ("left", "right"))
        n = high - low
        entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[entry], self.own[entry]


def seeds(words: np.ndarray, width: int = SEED) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    n = max(len(words) - width + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(width if n else 0):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[j:j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def subsequence(places: list[int], n: int) -> int:
    """Length of a longest common subsequence: bit i of a word's places says that the item's word i is the same."""
    every = v = (1 << n) - 1
    for m in places:
        u = v & m
        v = ((v + u) | (v - u)) & every
    return (~v & every).bit_count()


class Query:
    """A block of the benchmark: its items, the latent vectors of their passages, each vector's item, each item's features and their weight."""

    def __init__(self, rows: list, space: Latent, weight: np.ndarray):
        self.items, vectors, of, bits, size = [], [], [], [], []
        for r in rows:
            words = Words([plain(r["text"])]).hash
            if not len(words):
                continue
            self.items.append(Item(r["item_id"], words))
            f = ((words >> np.uint64(11)) % np.uint64(FEATURES)).astype(np.int64)
            own = np.zeros(FEATURES + 8, np.uint8)
            own[f] = 1
            bits.append(np.packbits(own, bitorder="little"))
            size.append((weight[f] ** 2).sum())
            last = max(len(f) - 2 * BLOCK, 0)
            for at in sorted({*range(0, last + 1, BLOCK // 2), last}):
                own = f[at:at + 2 * BLOCK]
                sums = space.factors[own].sum(0, keepdims=True)
                vectors.append(space.units(sums, (weight[own] ** 2).sum(keepdims=True)))
                of.append(len(self.items) - 1)
        width = space.factors.shape[1]
        self.vectors = np.concatenate(vectors).astype(np.float32) if vectors else np.zeros((0, width), np.float32)
        self.of, self.size = np.array(of, np.int64), np.array(size, np.float32)
        self.bits = np.stack(bits) if bits else np.zeros((0, FEATURES // 8 + 1), np.uint8)
        self.known = {w: Seeds(self.items, w) for w in sorted({x.seed for x in self.items} - {None})}

    def shared(self, square: np.ndarray, rows: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The weight of passages' words (``rows``) that an item has."""
        has = np.unpackbits(self.bits, axis=1, bitorder="little").ravel()
        place = rows + (item * (FEATURES + 8))[:, None]
        return (has.take(place) * square.take(rows)).sum(1)


def blocks(rows: list, space: Latent, weight: np.ndarray) -> list[Query]:
    """The items of a scan in blocks of about ``QUERY_WORDS`` words."""
    sizes = [max(len(r["text"].split()), ITEM_WORDS) for r in rows]
    made = (Query(rows[part], space, weight) for part in R.sub_batches(sizes, QUERY_WORDS))
    return [q for q in made if q.items]


def leaks(docs: DataFrame, queries: list[Query], space: Latent, weight: np.ndarray, cosine: float, least: float, answer: float) -> DataFrame:
    """``doc_id, key, item_id, cosine, subsequence, answer`` of some blocks of the benchmark against all documents, in one scan."""
    square = (weight ** 2).astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast(queries)  # SCAN_WORDS words and their vectors at most

    def run(batches):
        for b in batches:
            values, ids, keys = b.column("text").to_pylist(), b.column("doc_id").to_pylist(), b.column("key").to_pylist()
            out: list[tuple] = []
            for part in pieces(values):
                x = Blocks(values[part])
                if not len(x.feature):
                    continue
                sums, size = x.latent(space.factors), square[x.feature].sum(1)
                # a passage is a row and the next one of the same text; a text of one row is its own
                pair = np.append(x.doc[1:] == x.doc[:-1], False)
                head = np.flatnonzero(pair | (x.rows[x.doc] == 1))
                pair = pair[head]
                sums = sums[head] + np.where(pair[:, None], sums[np.minimum(head + 1, len(sums) - 1)], 0)
                size = size[head] + np.where(pair, size[np.minimum(head + 1, len(size) - 1)], 0)
                units = space.units(sums, size)
                for q in sent.value:
                    found = matches(q, x, units, head, pair, size, square, cosine, least, answer)
                    out += [(ids[part.start + k], keys[part.start + k], q.items[i].id, c, common, last) for (k, i), (common, c, last) in sorted(found.items())]
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))],
                                             ["doc_id", "key", "item_id", "cosine", "subsequence", "answer"])

    return docs.mapInArrow(run, "doc_id long, key binary, item_id long, cosine double, subsequence double, answer double")


def matches(q: Query, x: Blocks, units: np.ndarray, head: np.ndarray, pair: np.ndarray, size: np.ndarray, square: np.ndarray,
            cosine: float, least: float, answer: float) -> dict[tuple[int, int], tuple]:
    """(text, item) -> (subsequence, cosine, answer) of a block's items in some texts.

    ``units`` are the passages' vectors; a passage is the row ``head``, and the next one if ``pair``.
    """
    best: dict[tuple[int, int], tuple] = {}
    for at in range(0, len(units), 2048):
        near = units[at:at + 2048] @ q.vectors.T
        hit = np.flatnonzero(near >= cosine)
        if not len(hit):
            continue
        p, i = hit // len(q.of), q.of[hit % len(q.of)]
        # in order of passage and item: each once, with the nearest
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (i[1:] != i[:-1])]))
        found = np.maximum.reduceat(near.ravel()[hit], first)
        p, i = p[first], i[first]
        row = head[at + p]
        after = np.where(pair[at + p][:, None], x.feature[np.minimum(row + 1, len(x.feature) - 1)], FEATURES)
        enough = q.shared(square, np.concatenate([x.feature[row], after], 1), i) >= SHARED * np.minimum(size[at + p], q.size[i])
        for row, i1, c in zip(row[enough].tolist(), i[enough].tolist(), found[enough].tolist()):
            k = int(x.doc[row])
            item = q.items[i1]
            start = (row - x.row0[k]) * BLOCK
            lo = x.first[k] + max(start - item.n, 0)
            hi = min(x.first[k] + start + 2 * BLOCK + item.n, x.first[k + 1])
            near_words = x.hash[lo:hi].tolist()
            common, last = item.common(near_words, least)
            if not (common and (last >= answer or common >= (1 + least) / 2)):
                if not item.part(near_words):
                    continue
                common, last = item.common(near_words)
            if (k, i1) not in best or (common, c) > best[k, i1][:2]:
                best[k, i1] = (common, c, last)
    held: dict[tuple[int, int], tuple] = {}
    for width, known in q.known.items():
        for at, i1, own in zip(*(v.tolist() for v in known.found(seeds(x.hash, width)))):
            k = int(np.searchsorted(x.first, at, "right")) - 1
            words, item = x.hash[x.first[k]:x.first[k + 1]], q.items[i1]
            at -= int(x.first[k])
            # the run ends with the text; one begun before is known from its first place
            if at and own and words[at - 1] == item.words[own - 1]:
                continue
            if (n := item.longest(words, at, own)) >= item.run and n > held.get((k, i1), (0,))[0]:
                held[k, i1] = (n, at)
    for (k, i1), (n, at) in held.items():
        if (k, i1) in best:
            continue
        item = q.items[i1]
        words = x.hash[x.first[k]:x.first[k + 1]]
        common, last = item.common(words[max(at - item.n, 0):at + n + item.n].tolist())
        rows = np.arange(np.searchsorted(head, x.row0[k] + at // BLOCK, "right") - 1, np.searchsorted(head, x.row0[k] + (at + n - 1) // BLOCK, "right"))
        best[k, i1] = (common, float((units[rows] @ q.vectors[q.of == i1].T).max()), last)
    return best


def contaminated(df: DataFrame, benchmark: DataFrame, cosine: float = 0.5, subsequence: float = 0.6, answer: float = 0.5,
                 doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rank: int = RANK) -> DataFrame:
    """``doc_id, key, item_id, cosine, subsequence, answer``: a row for each document and benchmark item that it gives away.

    An item is given away if a passage's latent cosine to one of the item's is at least ``cosine``,
    the words that they share have ``SHARED`` of the weight of the lighter one, at least a share ``subsequence`` of its words follow one another in the passage's surroundings, and a
    share ``answer`` of its last words do; more common words make up for a missing answer. A part of the
    item does so too: ``RUN`` of its words in a row, whatever their cosine (of an item of ``SHORTEST`` to
    ``SEED`` words, all), or in a candidate's surroundings ``PART_SHARE`` of ``PART`` neighbouring ones. ``key`` is the MD5 of the text. Null or empty texts and items give nothing; null ids and repeated rows come
    back as they are, each row for itself; other columns are not read; an empty table gives an empty
    one. Items without an id are searched for as well. One text bounds a task's memory.
    """
    docs = texts(df, doc_id, text)
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    space, weight = fitted(docs, items.select("text"), rank)
    docs = docs.select("doc_id", F.unhex(F.md5("text")).alias("key"), "text")
    total = items.agg(F.sum(F.greatest(F.size(F.split("text", r"\s+")), F.lit(ITEM_WORDS))).alias("n")).first()["n"] or 0
    scans = total // SCAN_WORDS + 1
    out = None
    for k in range(scans):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(scans)) == k).orderBy("item_id", "text").collect()
        queries = blocks(rows, space, weight)
        if queries:
            found = leaks(docs, queries, space, weight, cosine, subsequence, answer)
            out = found if out is None else out.union(found)
    return out if out is not None else leaks(docs.limit(0), [], space, weight, cosine, subsequence, answer)
