"""Operator 8: token counts, with overlap resynchronisation for huge documents.

A text of up to ``chunk_chars`` is cut into segments where the tokenizer's own pre-splitting begins a
word whatever stands before: in front of a blank that no blank or other space follows. (Its pattern
leaves the last blank before a word to that word, and no other part of it holds a blank but a run of
spaces.) Each distinct segment is encoded by the library once and remembered by the worker, up to a
bound. A tokenizer whose file doesn't say that it splits like this gets its texts whole.

A longer text is encoded in chunks that overlap, and
spliced where both chunks begin a word of the tokenizer's own pre-splitting. That splitting reads
from left to right and remembers nothing at the start of a word, so after a start that is right in
the left chunk, the right chunk's words are the words of the whole text. A start is right in the left
chunk if it lies far enough before its end (``MARGIN``: more than a special token and the look-ahead
of the split pattern) and the chunk itself began at a right start. Without a common start the overlap
is doubled, and if it then reaches back to the last proven start, the next chunk begins there and is
doubled as well, so that each step gets on.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import sub_batches, texts

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 512
#: Over the longest special token plus the characters that the split pattern looks ahead.
MARGIN = 64

_loaded: dict = {}


def tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


class Chunk:
    """The tokens of text[base:base + size] and the words' starts as places in the whole text."""

    def __init__(self, tok, text: str, base: int, size: int):
        self.base, self.end = base, min(len(text), base + size)
        e = tok.encode(text[self.base:self.end], add_special_tokens=False)
        self.ids, self.words, self.first = e.ids, e.word_ids, [x for x, _ in e.offsets]

    def starts(self, lo: int, hi: int) -> dict[int, int]:
        """Words that start in [lo, hi): the place in the whole text, and the number of the first token."""
        i, stop = bisect_left(self.first, lo - self.base), bisect_left(self.first, hi - self.base)
        words = self.words
        return {self.first[k] + self.base: k for k in range(stop - 1, i - 1, -1) if not k or words[k] is None or words[k] != words[k - 1]}


def spliced(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """The ids of the whole text, from overlapping chunks."""
    out: list[int] = []
    proven, first = 0, 0  # a word of the whole text starts at ``proven``; its token in ``left``
    left = Chunk(tok, text, 0, chunk)
    while left.end < len(text):
        lap = overlap
        while True:
            base = max(proven, left.end - lap)
            right = Chunk(tok, text, base, max(chunk, 2 * lap, 2 * (left.end - base)))
            if base == proven:
                common = proven
                break
            there, here = left.starts(base + 1, left.end - MARGIN), right.starts(base + 1, left.end - MARGIN)
            common = min(there.keys() & here.keys(), default=None)
            if common is not None:
                break
            lap *= 2
        cut = first if common == proven else there[common]
        out.extend(left.ids[first:cut])
        proven, first, left = common, 0 if common == base else here[common], right
    out.extend(left.ids[first:])
    return out


#: In front of a blank before anything but a space (the older Mongolian separator counted as one); never within a run of spaces.
CUT = re.compile(r" (?=[^\s\u180e])")
#: A text without these can be cut at every blank.
UNEVEN = re.compile(r" (?:[\s\u180e]|\Z)")
#: Segments that a worker remembers, and their characters in all.
REMEMBERED, REMEMBERED_CHARS = 1 << 19, 1 << 24


def cuts_at_blanks(tok) -> bool:
    """Does the tokenizer's file say that a word begins at each single blank?"""
    told = json.loads(tok.to_str())
    split = told.get("pre_tokenizer") or {}
    return (told.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
            and not split.get("add_prefix_space", True)
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told.get("added_tokens", ())))


class SegmentCounts:
    """Token counts of texts from those of their segments, each distinct one encoded once."""

    def __init__(self, tok):
        self.tok, self.cutting, self.known, self.chars = tok, cuts_at_blanks(tok), {}, 0

    def encoded(self, texts: list[str]) -> list[int]:
        out = []
        for part in sub_batches([len(t) for t in texts], 1 << 20):
            out += [len(e) for e in self.tok.encode_batch_fast(texts[part], add_special_tokens=False)]
        return out

    def counts(self, texts: list[str]) -> list[int]:
        if not self.cutting:
            return self.encoded(texts)
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.known.clear()
            self.chars = 0
        known, cut, heads, new = self.known, [], [], {}
        for t in texts:
            first, *rest = t.split(" ") if not UNEVEN.search(t) else CUT.split(t)
            heads.append(first)
            cut.append(rest)
            new.update((p, None) for p in rest if p not in known)
        for p, n in zip(new, self.encoded([" " + p for p in new])):
            known[p] = n
            self.chars += len(p)
        get = known.__getitem__
        return [n + sum(map(get, rest)) for n, rest in zip(self.encoded(heads), cut)]


_counters: dict = {}


def segment_counts(path: str) -> SegmentCounts:
    if path not in _counters:
        _counters[path] = SegmentCounts(tokenizer(path))
    return _counters[path]


def token_counts(df: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text",
                 chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every text, a row for each input row.

    Counts are those of the whole text without begin, end or added tokens; special strings inside a
    text are handled as the tokenizer does by default. A null or empty text has no tokens; null ids
    and repeated rows come back as they are; other columns are not read; an empty table gives an
    empty one. A task holds a few MB of short texts, or one long text and two of its chunks.
    """
    def run(batches):
        tok, segments = tokenizer(path), segment_counts(path)
        for b in batches:
            values = b.column("text").to_pylist()
            n = [0] * len(values)
            short = [i for i, t in enumerate(values) if len(t) <= chunk_chars]
            for part in sub_batches([len(values[i]) for i in short], 1 << 20):
                for i, found in zip(short[part], segments.counts([values[i] for i in short[part]])):
                    n[i] = found
            for i, t in enumerate(values):
                if len(t) > chunk_chars:
                    n[i] = len(spliced(tok, t, chunk_chars, overlap_chars))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    docs = texts(df, doc_id, text)
    docs = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return (docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
