import hashlib
import random
import re

import pytest

from vidmatch.llm import phrases


def brute(rows, size):
    """(doc_id, n_words, n_removed, sha, kept) of every row, a null key last."""
    order = lambda d: (1, 0) if d is None else (0, d)
    split = [(order(d), re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in split:
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            least[key] = min(least.get(key, d), d)
    out = []
    for (doc, _), (d, w) in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def shared_texts(seed, n=40, size=13):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    passages = [" ".join(word() for _ in range(rng.randint(size, 3 * size))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), "\n".join(word() for _ in range(rng.randint(0, 9)))]
        texts.append("  ".join(parts))
    return texts + texts[:5]


def got(df):
    return sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in df.collect()], key=str)


def test_against_brute_force(docs_of, odd_texts, monkeypatch):
    texts = shared_texts(1) + odd_texts
    ids = [(7 * i) % len(texts) for i in range(len(texts))]
    ids[3] = ids[5]  # a repeated key
    ids[-1] = None
    wanted = brute(list(zip(ids, texts, strict=True)), 13)
    assert got(phrases.remove(docs_of(texts, ids))) == wanted
    texts = shared_texts(1)
    ids = list(range(len(texts)))
    wanted = brute(list(enumerate(texts)), 13)
    monkeypatch.setattr(phrases, "PASSAGES", 3000)  # many automata, each streamed in parts
    monkeypatch.setattr(phrases, "SEGMENTS", 2000)
    assert got(phrases.remove(docs_of(texts, ids))) == wanted


def test_hash_collisions_are_told_apart_by_words(docs_of):
    def weak(*args):  # only sixteen hashes: almost every window collides with others
        hashes, count = phrases.windows(*args)
        return hashes >> phrases.np.uint64(60) << phrases.np.uint64(60), count

    texts = shared_texts(2, 15, 4)
    assert got(phrases.remove(docs_of(texts), size=4, hashed=weak)) == brute(list(enumerate(texts)), 4)


def test_empty(docs_of):
    assert phrases.digests(docs_of([])).count() == 0


def test_long_repeated_text_goes_through_bounded_automata(docs_of, monkeypatch):
    """One owner of more words than one automaton may hold, and a key as large as a long."""
    monkeypatch.setattr(phrases, "PASSAGES", 4000)
    long = " ".join(f"{i:x}" for i in range(6000))
    texts = [long, long + " new end", "before " + long[500:], "plain " * 20, "plain " * 20]
    ids = [0, 1, (1 << 63) - 1, 3, None]
    assert got(phrases.remove(docs_of(texts, ids))) == brute(list(zip(ids, texts, strict=True)), 13)


def test_chunks_keep_every_window(monkeypatch):
    monkeypatch.setattr(phrases, "PASSAGES", 50)
    passages = [(1, " ".join(f"w{i}" for i in range(200))), (2, "a b c d"), (3, "x" * 500 + " y z q")]
    pieces = [(o, w) for chunk in phrases.chunks(passages, 4) for o, w in chunk]
    windows = lambda ps: {(o, tuple(w[i : i + 4])) for o, w in ps for i in range(len(w) - 3)}
    assert windows(pieces) == windows([(o, p.split(" ")) for o, p in passages])
    assert max(sum(len(w) for _, ws in chunk for w in ws) for chunk in phrases.chunks(passages, 4)) < 700


def test_lost_file_is_an_error(spark, docs_of, tmp_path):
    known = phrases.np.ones(1, bool)
    with pytest.raises(FileNotFoundError):
        phrases.owners(str(tmp_path / "gone"), known, phrases.np.zeros(3, phrases.np.uint64))


def test_number_of_shards_does_not_matter(docs_of, monkeypatch):
    texts = shared_texts(4, 20)
    monkeypatch.setattr(phrases, "shards_for", lambda size: 16)
    assert got(phrases.remove(docs_of(texts))) == brute(list(enumerate(texts)), 13)
