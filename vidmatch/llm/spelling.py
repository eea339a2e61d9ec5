"""Spelling variants: words one code point apart, found by PartEnum signatures.

A word's letters are a multiset, hence a binary vector with one place for each letter
and how many times it came before. One inserted or deleted code point moves one place,
a replaced one two, so near words have vectors at a Hamming distance of two at most.
PartEnum cuts the places into ``n1`` parts: one of them differs in no more than
``k2 = (k + 1) / n1 - 1`` places (rounded up). That part is cut into ``n2`` pieces, and every
choice of ``n2 - k2`` pieces is a signature: vectors within ``k`` agree on at least one.
Words that agree on a signature are joined and verified by their edit distance.

A signature alone is shared by many words of a large vocabulary. Of two near words of
``least`` code points or more, either the first ``(least - 1) / 2`` code points agree or the
last; each signature is therefore joined once with the word's beginning and once with
its end. That loses no pair and no group grows with all words of a multiset.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmatch.llm.licenses import LOWER, UPPER
from vidmatch.llm.sharding import crc_entry
from vidmatch.session import cut_lineage

# The contract's letters, shortest word, smallest count, share of noise and ratio.
LETTERS = "A-Za-zÀ-ÿ"
LEAST, TIMES, NOISE, RATIO = 7, 2, 31, 10
#: Largest Hamming distance of near words.
MAX_DISTANCE = 2
#: Words whose signatures one task makes.
TASK_WORDS = 20_000
#: Parts of the first and of the second level.
PARTS, PIECES = 1, 5


def runs(docs: DataFrame, least: int = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and word (A-Z lower-cased) of every maximal run of at least ``least`` letters; a null text has none."""
    found = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select(F.col(f"`{key}`").alias(key), F.explode(found).alias("word")).withColumn("word", F.translate("word", UPPER, LOWER))


def misspelt(words: DataFrame, noise: int = NOISE, key: str = "doc_id") -> DataFrame:
    """``words`` where one occurrence in ``noise`` lost a code point; which one, and where, follows from key and word.

    A null key counts as an empty one.
    """
    h = F.crc32(F.encode(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.col("word")), "UTF-8"))
    at = (F.col("h") % F.char_length("word")).cast("int")
    shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return words.select("word", h.alias("h")).select(F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Different words of at least ``least`` code points and their counts ``n``, at least ``times``."""
    long = words.where(F.char_length("word") >= least)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def subsets(parts: int, pieces: int, distance: int = MAX_DISTANCE) -> list[tuple[int, ...]]:
    """The pieces (numbered over all parts) that make up each signature."""
    inner = -(-(distance + 1) // parts) - 1
    if pieces <= inner:
        raise ValueError(f"more than {inner} pieces are needed")
    return [tuple(g * pieces + i for i in kept) for g in range(parts) for kept in combinations(range(pieces), pieces - inner)]


def signatures(words: DataFrame, least: int = LEAST, parts: int = PARTS, pieces: int = PIECES) -> DataFrame:
    """word, n and one row for each signature ``sig``; ``least`` is the length that no word falls below."""
    letters = F.array_sort(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0)))
    # The same letter again is another place.
    place = lambda c, i: F.concat(c, (i - F.array_position("letters", c)).cast("string"))
    dealt = F.transform("letters", lambda c, i: F.struct(F.pmod(F.xxhash64(place(c, i)), F.lit(parts * pieces)).alias("piece"), place(c, i).alias("place")))
    piece = lambda j: F.array_join(F.transform(F.filter("dealt", lambda d: d["piece"] == j), lambda d: d["place"]), " ")
    cut = F.array(*[piece(j) for j in range(parts * pieces)])
    end = (least - 1) // 2
    ends = [F.substring("word", 1, end), F.substring("word", -end, end)] if end else [F.lit("")]
    every = [
        F.xxhash64(F.lit(k), *[F.get("pieces", F.lit(j)) for j in chosen], F.lit(side), chars)
        for k, chosen in enumerate(subsets(parts, pieces))
        for side, chars in enumerate(ends)
    ]
    return (
        words.select("word", "n", letters.alias("letters"))
        .select("word", "n", dealt.alias("dealt"))
        .select("word", "n", cut.alias("pieces"))
        .select("word", "n", F.explode(F.array_distinct(F.array(*every))).alias("sig"))
    )


def near_pairs(words: DataFrame, least: int = LEAST, parts: int = PARTS, pieces: int = PIECES) -> DataFrame:
    """a, b (a < b) and their counts, of all words exactly one code point apart."""
    rows = signatures(words, least, parts, pieces)
    a = rows.select("sig", F.col("word").alias("a"), F.col("n").alias("a_n"))
    # Signatures are many times the words they come from: never broadcast them.
    b = rows.select("sig", F.col("word").alias("b"), F.col("n").alias("b_n")).hint("merge")
    fits = (F.col("a") < F.col("b")) & (F.abs(F.char_length("a") - F.char_length("b")) <= 1)
    met = a.join(b, "sig").where(fits & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def group(words: DataFrame, least: int = LEAST, ratio: int = RATIO, parts: int = PARTS, pieces: int = PIECES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words`` (word, n; words differ).

    ``form`` is the near word of largest n (ties: the first in code point order) if that n
    is at least ``ratio`` (over 1) times the word's, else null; ``root`` follows forms to
    the last one and is the word itself without a form; ``n_near`` counts near words.
    """
    if ratio <= 1:
        raise ValueError("forms must be more frequent than their words")
    words = cut_lineage(words.select("word", "n"))
    words = words.repartition(1 + words.count() // TASK_WORDS, "word")
    pairs = cut_lineage(near_pairs(words, least, parts, pieces))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    )
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best")
    )
    enough = -F.col("best.less") >= F.col("n") * ratio
    formed = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    formed = cut_lineage(formed)
    roots = _roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word and root, by doubling: forms grow by the ratio at each step, so chains are short and have no circle."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        joined = cut_lineage(now.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        now = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id", noise: int = NOISE) -> DataFrame:
    """The grouped words of whole texts, with the contract's noise.

    A null, empty or letterless text has no words; repeated rows count as often as they
    come; a null key makes the noise of an empty one; a table without words gives no
    rows; other columns are ignored.
    """
    return group(vocabulary(misspelt(runs(docs, text=text, key=key), noise, key)))


def variants_sql() -> str:
    """The same over ``documents`` in DuckDB's SQL: near words by the strings that a deletion leaves."""
    table = "[" + ", ".join(str(crc_entry(i)) for i in range(256)) + "]"
    return f"""
WITH RECURSIVE runs AS MATERIALIZED (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')),
 '{UPPER}', '{LOWER}') AS w FROM documents) WHERE length(w) >= {LEAST} GROUP BY ALL),
hexed AS (SELECT w, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM runs),
hashed AS (SELECT w, k, xor(4294967295, list_reduce(list_transform(range(1, len(x), 2), lambda j: ('0x' || substr(x, j, 2))::BIGINT),
 lambda c, y: xor(c >> 8, ({table})[xor(c & 255, y) + 1]), 4294967295::BIGINT)) AS h FROM hexed),
noisy AS (SELECT CASE WHEN h % {NOISE} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM noisy WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(k) >= {TIMES}),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM
 (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS other FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {RATIO} * w.n THEN other END AS form,
 CASE WHEN most >= {RATIO} * w.n THEN most END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
up AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT u.word, f.word, f.form FROM up u JOIN formed f ON f.word = u.next)
SELECT f.word, f.form, u.root, f.n, f.n_near, f.form_n FROM formed f JOIN up u ON u.word = f.word AND u.next IS NULL"""

