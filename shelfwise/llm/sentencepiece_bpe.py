"""Operator 9: exact merge-type SentencePiece encoding by backtracking, and decoding.

A token sequence is the encoding of a text exactly if every two adjacent tokens are what their own
joined text encodes to. So the encoder walks the text from the left: at each position it takes the
longest piece that starts there (all matches come from one Aho-Corasick pass), checks it against the
token before by merging just these two again, takes a shorter piece if that fails, and if none is
left goes back one token. A bitfield holds the positions from which nothing fitted, so that none is
tried twice.

The text is cut first where no piece can lie across: a piece holds the space mark only in front, and
a character that is in no longer piece stands alone. Both facts are read from the model. A cache of
bounded size keeps the segments seen.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import sub_batches, texts

SPACE = "▁"
#: Of each of a cache's two generations: a full young one becomes the old one.
CACHE_ENTRIES = 250_000
CACHED_CHARS = 48
ONE = [1]  # where no longer piece starts, the character alone

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class MergeEncoder:
    """Encodes as the model does; ``encode`` returns ids, ``decode`` their text."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_unknown(i) or lib.is_control(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.score = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_fallback = lib.is_byte(self.bytes[0])
        self.unknown = lib.unk_id()
        long = [p for p in self.ids if len(p) > 1]
        inside = "".join(re.escape(c) for c in sorted({c for p in long for c in p} - {SPACE}))
        if any(SPACE in p.lstrip(SPACE) for p in long):
            self.segment = re.compile(r"[\s\S]+")  # a piece may lie across spaces: nothing can be cut
        else:
            self.segment = re.compile(f"{SPACE}+[{inside}]*|[{inside}]+|[^{SPACE}{inside}]" if inside else r"[\s\S]")
        self.automaton = ahocorasick.Automaton()
        for p in long:
            if self.merge(p) == [p]:  # others never come out of merging
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, text: str) -> list[str]:
        """Plain merging: join the best-scored adjacent pair, the leftmost of equals, until none is left."""
        parts, score = list(text), self.score.get
        none = -float("inf")
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == none:
                break
            i = scores.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Does merging the two again give just the two?"""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= CACHE_ENTRIES:
                self.fits.clear()
            known = self.fits[left, right] = self.merge(left + right) == [left, right]
        return known

    def pieces(self, text: str) -> list[str]:
        """The tokens of one segment as strings."""
        n, fits = len(text), self.fits.get
        starts: dict[int, list[int]] = {}  # lengths of the pieces from each position, the longest last
        for end, length in self.automaton.iter(text):
            at = end - length + 1
            if at in starts:
                starts[at].append(length)
            else:
                starts[at] = [1, length]
        failed = bytearray(n + 1)  # the bitfield: 1 where nothing fitted
        out: list[str] = []
        took: list[int] = []  # for each token, which of the lengths from its start it has
        pos, last, lengths = 0, None, starts.get(0, ONE)
        choice = len(lengths) - 1
        while True:
            while choice >= 0:
                end = pos + lengths[choice]
                if not failed[end]:
                    token = text[pos:end]
                    if last is None or (ok := fits((last, token))) or ok is None and self.compatible(last, token):
                        break
                choice -= 1
            if choice >= 0:
                out.append(token)
                if end == n:
                    return out
                took.append(choice)
                pos, last, lengths = end, token, starts.get(end, ONE)
                choice = len(lengths) - 1
            else:
                failed[pos] = 1
                if not out:
                    raise ValueError(f"no encoding of {text!r}: the model is not of the merge type")
                pos -= len(out.pop())
                last, lengths, choice = out[-1] if out else None, starts.get(pos, ONE), took.pop() - 1

    def _ids(self, segment: str) -> tuple[int, ...]:
        ids: list[int] = []
        for p in self.pieces(segment) if len(segment) > 1 else (segment,):
            own = self.ids.get(p)
            if own is not None:
                ids.append(own)
            elif self.byte_fallback:
                ids.extend(self.bytes[b] for b in p.encode())
            else:
                ids.append(self.unknown)
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, extend = self.young.get, out.extend
        for segment in self.segment.findall(self.library.normalize(text)):
            ids = known(segment)
            if ids is None:
                ids = self.old.get(segment) or self._ids(segment)
                if len(segment) <= CACHED_CHARS:
                    if len(self.young) >= CACHE_ENTRIES:
                        self.old, self.young = self.young, {}
                        known = self.young.get
                    self.young[segment] = ids
            extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_encoders: dict[str, MergeEncoder] = {}


def encoder(model_file: str) -> MergeEncoder:
    """One encoder for each worker process and model."""
    if model_file not in _encoders:
        _encoders[model_file] = MergeEncoder(model_file)
    return _encoders[model_file]


def encode_documents(df: DataFrame, model_file: str, check: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every text: ``doc_id, ids array<int>, decoded string``, a row for each input row.

    With ``check``, instead of ``decoded``, ``decodes``: whether the ids decode to the text.
    A null or empty text has no ids and decodes to the empty text; null ids and repeated rows come
    back as they are; other columns are not read. An empty table gives an empty one. The longest
    text bounds a task's memory.
    """
    def run(batches):
        enc = encoder(model_file)
        for b in batches:
            values = b.column("text").to_pylist()
            for part in sub_batches([len(t) for t in values], 1 << 22):
                ids = [enc.encode(t) for t in values[part]]
                back = [enc.decode(x) for x in ids]
                last = pa.array([x == t for x, t in zip(back, values[part])], pa.bool_()) if check else pa.array(back, pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[part.start:part.stop], pa.array(ids, pa.list_(pa.int32())), last],
                                                 ["doc_id", "ids", "decodes" if check else "decoded"])

    return texts(df, doc_id, text).mapInArrow(run, f"doc_id long, ids array<int>, {'decodes boolean' if check else 'decoded string'}")


def encoding_digests(df: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, without moving the ids.

    The cases are those of ``encode_documents``; the digests of no ids are those of the empty text.
    """
    def run(batches):
        enc, sha = encoder(model_file), hashlib.sha256
        for b in batches:
            n, of_ids, of_text = [], [], []
            for t in b.column("text").to_pylist():
                ids = enc.encode(t)
                n.append(len(ids))
                of_ids.append(sha(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                of_text.append(sha(enc.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(df, doc_id, text).mapInArrow(run, SCHEMA)
