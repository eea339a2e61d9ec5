import hashlib
import random
from collections import Counter

from vidmatch.llm import suffixes


def brute(rows, length):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def got(df):
    return sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in df.collect()], key=str)


def texts(seed, scale):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    passages = [some(rng.randint(scale // 2, 3 * scale)) for _ in range(6)]
    out = []
    for _ in range(25):
        out.append(some(rng.randint(0, 2 * scale)) + "".join(rng.choice(passages) + some(rng.randint(0, scale)) for _ in range(rng.randint(0, 3))))
    near = list(out[3] + some(4 * scale))
    copy = near.copy()
    copy[len(copy) // 2] = "X"
    return [*out, *out[:3], "".join(near), "".join(copy), None, "", "short", "a" * (5 * scale), "ab" * (3 * scale)]


def test_against_brute_force(docs_of):
    for seed, length, anchor in ((1, 200, 32), (2, 20, 6), (3, 8, 1)):
        t = texts(seed, length)
        wanted = brute(list(enumerate(t)), length)
        assert got(suffixes.remove(docs_of(t), length, anchor)) == wanted


def test_repeated_rows_nulls_and_empty_tables(docs_of, odd_texts):
    ids = [None, 1, 1, *range(3, 10)]
    some = [t if t is None or len(t) < 3000 else t[:3000] for t in odd_texts]
    assert got(suffixes.remove(docs_of(some, ids))) == brute(list(zip(ids, some, strict=True)), 200)
    assert suffixes.remove(docs_of([])).count() == 0


def test_number_of_shards_does_not_matter(docs_of, monkeypatch):
    monkeypatch.setattr(suffixes, "shards_for", lambda size: 16)
    t = texts(4, 20)
    assert got(suffixes.remove(docs_of(t), 20, 6)) == brute(list(enumerate(t)), 20)
