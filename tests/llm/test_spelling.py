import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from vidmatch.llm import spelling

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_group(counts, ratio=10):
    out, forms = {}, {}
    for w, n in counts.items():
        close = [(-counts[o], o) for o in counts if near(w, o)]
        best = min(close, default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        forms[w] = form
        out[w] = [form, w, n, len(close), counts.get(form)]
    for w in out:
        while forms[out[w][1]] is not None:
            out[w][1] = forms[out[w][1]]
    return {w: tuple(v) for w, v in out.items()}


def brute(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                counts[w] += 1
    return brute_group({w: n for w, n in counts.items() if n >= 2})


def got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def edited(rng, word, alphabet):
    i = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    if kind == 0:
        return word[:i] + rng.choice(alphabet) + word[i:]
    return word[:i] + (rng.choice(alphabet) if kind == 1 else "") + word[i + 1 :]


@pytest.mark.parametrize(("parts", "pieces"), [(1, 3), (1, 5), (2, 3), (3, 1)])
def test_groups_against_all_pairs(spark, parts, pieces):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(60)}
    words |= {edited(rng, w, "abéz") for w in list(words) for _ in range(2)}
    counts = {w: rng.choice([2, 3, 30, 400, 5000]) for w in words if len(w) >= 7}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    result = got(spelling.group(df, parts=parts, pieces=pieces))
    assert result == brute_group(counts)
    assert any(v[1] not in (v[0], w) for w, v in result.items())  # a chain of forms


def test_short_words_and_characters_beyond_sixteen_bits(spark):
    counts = {"a": 1, "b": 20, "": 300, "ab": 5, "😀": 3, "😀😀": 40, "a😀": 4000}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.group(df, least=0)) == brute_group(counts)


def test_documents_against_brute_force(spark, docs_of, odd_texts):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeÀÿ") for _ in range(rng.randint(5, 10))) for _ in range(40)]
    texts = [*odd_texts, *[" ".join(rng.choices([*vocabulary, "Commonword", "COMMONWORD"], k=80)) for _ in range(60)]]
    texts += ["wordswithout×stop wordswithout×stop", "seven77letters seventh_letter"] * 2
    ids = [None if i % 11 == 0 else i // 2 for i in range(len(texts))]
    want = brute(list(zip(ids, texts, strict=True)))
    assert got(spelling.variants(docs_of(texts, ids))) == want
    assert any(v[0] for v in want.values())


def test_no_words(docs_of):
    assert spelling.variants(docs_of([])).isEmpty()
    assert spelling.variants(docs_of([None, "", "123 4567890", "short words only"])).isEmpty()


def test_sql_agrees(spark, docs_of):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdeÀÿ") for _ in range(rng.randint(6, 9))) for _ in range(30)]
    docs = docs_of([" ".join(rng.choices([*vocabulary, "Commonword"], k=60)) for _ in range(60)])
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    rows = {r[0]: tuple(r[1:]) for r in con.sql(spelling.variants_sql()).fetchall()}
    assert got(spelling.variants(docs)) == rows


def test_bad_parameters(spark):
    df = spark.createDataFrame([("abcdefg", 2)], "word string, n long")
    with pytest.raises(ValueError):
        spelling.group(df, ratio=1)
    with pytest.raises(ValueError):
        spelling.group(df, pieces=2)
