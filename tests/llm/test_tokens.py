import hashlib
import random

import public_tokenizers
import pytest
from llm_helpers import awkward_texts, frame, same, sha

from shelfwise.llm import sentencepiece_bpe, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SPECIAL = [" ", "  ", "   ", "a", "the", "ing", "é", "\n", "\t", "梦", "🙂", ".", "<|endoftext|>", "'re", "'", "0", "abc " * 20, "x" * 300, " " * 300, "\n" * 5, "▁", "<s>", "<0x0A>", "\x00"]


def drawn(rng, n):
    return "".join(rng.choice(SPECIAL) for _ in range(n))


def test_pieces_as_the_library():
    rng, enc = random.Random(3), sentencepiece_bpe.encoder(PIECES)
    for k in range(3000):
        text = drawn(rng, rng.randint(0, 14)) if k % 2 else "".join(rng.choice("abcdefghiklmnoprstu  eeettaao,.") for _ in range(rng.randint(0, 80)))
        ids = enc.encode(text)
        assert ids == enc.library.encode(text)
        assert enc.decode(ids) == enc.library.decode(ids)


def test_pieces_need_backtracking():
    """Some words' greedy longest match is not their encoding, and is mended."""
    enc, rng = sentencepiece_bpe.encoder(PIECES), random.Random(4)
    words = ["▁" + "".join(rng.choice("aeinorst") for _ in range(10)) for _ in range(500)]
    def greedy(w):
        out = []
        while w:
            n = max((n for n in range(1, len(w) + 1) if n == 1 or w[:n] in enc.ids), default=1)
            out.append(w[:n])
            w = w[n:]
        return out
    assert any(greedy(w) != enc.pieces(w) for w in words) and all(enc.merge(w) == enc.pieces(w) for w in words)


def test_piece_digests_and_rows(spark):
    texts = awkward_texts()
    ids = [None if k == 4 else k for k in range(len(texts))]
    lib = sentencepiece_bpe.encoder(PIECES).library
    want = []
    for d, t in zip(ids, texts):
        x = lib.encode(t or "")
        want.append((d, len(x), sha(",".join(map(str, x)).encode()), sha(lib.decode(x).encode())))
    same(sentencepiece_bpe.encoding_digests(frame(spark, texts, ids), PIECES).collect(), want)
    full = sentencepiece_bpe.encode_documents(frame(spark, texts, ids), PIECES).collect()
    same([(r.doc_id, len(r.ids), sha(",".join(map(str, r.ids)).encode()), sha(r.decoded.encode())) for r in full], want)
    assert sentencepiece_bpe.encoding_digests(frame(spark, []), PIECES).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(100, 65), (200, 70), (500, 100), (1000, 512)])
def test_spliced_chunks_give_the_whole_encoding(chunk, overlap):
    rng, tok = random.Random(chunk), token_counts.tokenizer(BYTES)
    for _ in range(60):
        text = drawn(rng, rng.randint(0, 300))
        assert token_counts.spliced(tok, text, chunk, overlap) == tok.encode(text, add_special_tokens=False).ids


def test_counts_of_short_and_long_texts(spark):
    texts = [*awkward_texts(), "<|endoftext|>" * 5, "y" * 5000, "z z" * 3000]
    tok = token_counts.tokenizer(BYTES)
    want = [(k, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 100) for k, t in enumerate(texts)]
    for chunk in (1 << 15, 700):
        got = token_counts.token_counts(frame(spark, texts), BYTES, limit=100, chunk_chars=chunk, overlap_chars=128).collect()
        same(got, want)
    assert token_counts.token_counts(frame(spark, []), BYTES).count() == 0


def test_segments_as_the_library():
    """Counts from segments are those of whole texts, whatever spaces, specials and cuts there are."""
    rng, tok = random.Random(9), token_counts.tokenizer(BYTES)
    counter = token_counts.SegmentCounts(tok)
    assert counter.cutting
    spaces = [" ", " ", " ", "  ", "\n", " \n", "\n ", "\t", "\u00a0", "\u2003 ", " \u3000", "\x1c", "\x85 ", "\u180e", " \u180e", "\u200b", "\r\n", "\x00"]
    texts = ["".join(rng.choice(spaces if rng.random() < 0.5 else SPECIAL) for _ in range(rng.randint(0, 14))) for _ in range(6000)] + [t or "" for t in awkward_texts()]
    want = [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    for _ in range(2):                                    # nothing known, then all of it
        assert counter.counts(texts) == want
    counter.cutting = False
    assert counter.counts(texts) == want


def test_forgotten_segments_are_encoded_again(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    tok = token_counts.tokenizer(BYTES)
    counter, texts = token_counts.SegmentCounts(tok), ["some words here", "and other words there", "here some"]
    for _ in range(3):
        assert counter.counts(texts) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_other_tokenizers_are_not_cut():
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.BPE())
    assert not token_counts.cuts_at_blanks(other)
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    assert not token_counts.cuts_at_blanks(other)
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    assert token_counts.cuts_at_blanks(other)
    other.add_special_tokens(["a b"])
    assert not token_counts.cuts_at_blanks(other)
