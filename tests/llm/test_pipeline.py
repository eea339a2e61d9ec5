"""The whole pipeline against a plain version of every stage."""

import random

import pytest
from test_bpe import PATH, reference
from test_others import WORDS, distance_in
from test_simhash import brute_classes, brute_print

import corpus_pipeline
from vidmatch.llm import bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BLANKS = " \t\n\v\f\r"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return "".join(c if c.isascii() and c.isalnum() else " " for c in low).split()


def normal(text):
    out, blank = [], False
    for c in text or "":
        if c not in BLANKS:
            out.append(c)
        elif not blank:
            out.append(" ")
        blank = c in BLANKS
    return "".join(out)


def stage_by_stage(rows, items):
    """Rows left after each stage but the last."""
    left = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    yield left
    first = {}
    for r in left:
        first.setdefault(normal(r[1]), r)
    left = list(first.values())
    yield left
    label = brute_classes([brute_print(r[1]) for r in left])
    left = [r for i, r in enumerate(left) if label[i] == i]
    yield left
    cut = [words_of(t or "") for _, t in items]
    left = [r for r in left if not any(x and distance_in(x, words_of(r[1])) <= len(x) // 10 for x in cut)]
    yield left


def corpus():
    """Copies by blanks and by one word, benchmark passages with and without edits, rows without letters."""
    rng = random.Random(11)
    langs = sorted(WORDS)
    items = [(i, " ".join(f"{rng.choice(WORDS['en'])}{rng.randint(0, 30)}" for _ in range(30))) for i in range(6)]
    texts = []
    for k in range(70):
        own = [f"{rng.choice(WORDS[langs[k % 4]])}{rng.choice(['', '', 'x', 'q7'])}" for _ in range(rng.randint(20, 120))]
        texts.append((" ".join(own), langs[k % 4]))
        if k % 5 == 0:
            texts.append(("\t" + " \n".join(own).lstrip(), None))
        if k % 5 == 1:
            texts.append(("  ".join(own), langs[k % 4]))
        if k % 5 == 2:
            own[rng.randrange(len(own))] = "changed"
            texts.append((" ".join(own), langs[k % 4]))
        if k % 10 == 3:
            passage = items[k // 10 % 6][1].split()
            for _ in range(k // 10 % 5):  # up to four edits, three are allowed
                passage[rng.randrange(len(passage))] = "edited"
            texts.append((" ".join(own[:9] + passage + own[9:]).title(), langs[k % 4]))
            texts.append((" ".join(own[:9] + passage + own[9:]).title(), langs[k % 4]))
    long = " ".join(f"lang{i % 977} tail{i % 13}" for i in range(20_000))
    texts += [(None, "en"), ("", "de"), (" \n", None), ("12 34 !?", "en"), (long, "en"), (long + " ", None), ("Ünï çödé 漢字 😀", "xx")]
    rng.shuffle(texts)
    rows = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(texts)]
    return rows, [*items, (90, None), (91, ""), (92, " .!")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_equals_the_stages_by_hand(spark, folder):
    rows, items = corpus()
    *_, left = stage_by_stage(rows, items)
    encoded = corpus_pipeline.run(spark, str(folder))
    got = {r["doc_id"]: r for r in bpe.decode(encoded, PATH).collect()}
    assert set(got) == {r[0] for r in left}
    for doc_id, text, lang, source, n_chars in left:
        r = got[doc_id]
        assert (r["text"], r["lang"], r["source"], r["n_chars"]) == (text, lang, source, n_chars)
        assert list(r["ids"]) == reference().encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
        assert list(r["token_bytes"]) == [len(reference().decode_single_token_bytes(i)) for i in r["ids"]]


def test_every_stage_but_the_last_decides_and_keeps_the_columns(spark, folder):
    rows, items = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = len(rows)
    for (name, stage), left in zip(corpus_pipeline.STAGES[:-1], stage_by_stage(rows, items), strict=True):
        source = spark.createDataFrame(docs.collect(), docs.schema)
        docs = stage(spark, source, str(folder))
        assert docs.columns == source.columns, name
        assert {r["doc_id"] for r in docs.collect()} == {r[0] for r in left}, name
        assert len(left) < before, name
        before = len(left)


def test_empty_corpus(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
