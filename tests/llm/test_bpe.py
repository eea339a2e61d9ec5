import hashlib
import random
from functools import cache

import public_tokenizers
import pyarrow as pa
import tiktoken

from vidmatch.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder(PATH).ranks, special_tokens={})


def test_random_texts_and_all_code_points():
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "'s", "'re", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", "漢", "😀", "́", "\x85", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["a" * 3000, "!" * 2500, "", "\n\n ", " 's", "\n's", "x'll'd", "<|endoftext|>"]
    points = [chr(c) for c in [*range(0x3000), *range(0x3000, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"a{c}1{c}" for c in points[i : i + 200]) for i in range(0, len(points), 200)]
    own = bpe.encoder(PATH)
    got = list(own.encode(pa.array(texts)))
    assert got == [reference().encode_ordinary(t) for t in texts]
    assert [own.decode(ids) for ids in got] == [t.encode() for t in texts]


def test_small_cache_gives_equal_ids():
    texts = [f"some words {i} and more words{i % 7}" for i in range(300)]
    small = bpe.Encoder(bpe.encoder(PATH).ranks, cache_size=5)
    assert list(small.encode(pa.array(texts))) == [reference().encode_ordinary(t) for t in texts]


def test_pieces_of_a_block_are_merged_side_by_side(monkeypatch):
    rng = random.Random(2)
    own = bpe.Encoder(bpe.encoder(PATH).ranks)
    texts = ["".join(rng.choice("abcdefgeirstné漢\0") for _ in range(rng.choice([1, 2, 5, 9, 30, 199, 200, 201, 260]))) for _ in range(500)]
    texts += ["z" * n for n in (150, 199, 200, 201, 400)] + ["".join(rng.choice("0123456789") for _ in range(90)) for _ in range(20)]
    calls = []
    many = own._merge_many
    monkeypatch.setattr(own, "_merge_many", lambda pieces: calls.append(len(pieces)) or many(pieces))
    assert list(own.encode(pa.array(texts))) == [reference().encode_ordinary(t) for t in texts]
    # A few calls for hundreds of pieces; pieces beyond SHORT_PIECE are not kept.
    assert sum(calls) > 300 and len(calls) < 30
    assert max(map(len, own.known)) <= bpe.SHORT_PIECE
    for t in texts[:50]:
        assert own.merge(t.encode()) == tuple(reference()._encode_single_piece(t.encode()))


def test_ranks_without_some_bytes_or_pairs():
    ranks = {bytes([i]): i * 3 for i in range(256)} | {b"ab": 900, b"abab": 901, b"ba": 1000, b"cab": 2000}
    own = bpe.Encoder(ranks)
    reference = tiktoken.Encoding("gaps", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["abababab", "bababa", "cababcab", "xyz", "ccababa" * 9, "", " ab"]
    assert list(own.encode(pa.array(texts))) == [reference.encode_ordinary(t) for t in texts]


def test_frames(docs_of, odd_texts):
    docs = docs_of(odd_texts)
    encoded = bpe.encode(docs, PATH)
    assert encoded.columns == [*docs.columns, "ids", "token_bytes"]
    decoded = bpe.decode(encoded, PATH).collect()
    digests = {r["doc_id"]: r for r in bpe.digests(docs, PATH).collect()}
    for r in decoded:
        text = r["text"] or ""
        ids = reference().encode_ordinary(text)
        assert r["ids"] == ids and bytes(r["decoded"]) == text.encode() and sum(r["token_bytes"]) == len(text.encode())
        d = digests[r["doc_id"]]
        assert d["n_tokens"] == len(ids) and d["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert d["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(docs_of([]), PATH).count() == 0
    assert bpe.encode(docs_of([]), PATH).count() == 0
