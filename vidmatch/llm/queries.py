"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidmatch.llm import (
    bpe,
    decontaminate,
    exact,
    language,
    licenses,
    ngrams,
    phrases,
    sharding,
    simhash,
    spelling,
    suffixes,
    urls,
    whitening,
)
from vidmatch.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return f(spark, folder)

    QUERIES[f.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    return bpe.digests(table(spark, folder, "documents"), bpe.default_ranks(spark))


@query
def op9_urls(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict of every page's url, by rule or by its host's trust."""
    return urls.judge(table(spark, folder, "pages"), urls.RULES)


ORACLES["op9_urls"] = urls.judge_sql(urls.RULES)


@query
def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """The licence notice of every document."""
    return licenses.scan(table(spark, folder, "documents"))


ORACLES["op7_licenses"] = licenses.scan_sql()


@query
def op2_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Which document stays of every group of equal texts."""
    return exact.decide(table(spark, folder, "documents")).drop("row")


ORACLES["op2_exact"] = r"""
WITH clean AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
 sha256(t) AS text_sha256 FROM clean WINDOW w AS (PARTITION BY t)"""


@query
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.classes(table(spark, folder, "documents")).drop("row", "stays")


@query
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    """The predicted language of every document."""
    return language.identify(table(spark, folder, "documents"))


@query
def op1_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every document by a model of those that are not held out."""
    docs = table(spark, folder, "documents")
    held = language.remainder("doc_id", 7) == 2
    model = ngrams.train(docs.where(~held))
    return ngrams.score(docs.select("doc_id", held.alias("held_out"), "text"), model)


@query
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark items that documents hold, with up to one edit in ten words."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op5_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without windows that an earlier one has."""
    return phrases.digests(table(spark, folder, "documents"))


ORACLES["op5_phrases"] = r"""
WITH w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
 FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS t
 FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
firsts AS (SELECT t, min(doc_id) AS m FROM win GROUP BY t),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN firsts USING (t) WHERE m < doc_id),
kept AS (SELECT a.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY a.j) AS t
 FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w) a
 ANTI JOIN gone g ON g.doc_id = a.doc_id AND g.j = a.j GROUP BY a.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id"""


@query
def op8_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without 200-byte strings that occur twice."""
    return suffixes.remove(table(spark, folder, "documents"), with_kept=False).drop("kept")


ORACLES["op8_suffixes"] = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(h, 2 * i - 1, 400)) AS m
 FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 198)) AS i FROM d)),
twice AS (SELECT m FROM win GROUP BY m HAVING count(*) > 1),
starts AS MATERIALIZED (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM win SEMI JOIN twice USING (m)),
islands AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END)
 OVER (PARTITION BY doc_id ORDER BY i) AS k FROM starts),
spans AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM islands GROUP BY doc_id, k),
edges AS (SELECT doc_id, b AS from_byte, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 1000000000) AS to_byte FROM spans
 UNION ALL SELECT doc_id, 1, min(a) FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * from_byte - 1, 2 * (to_byte - from_byte)), '' ORDER BY from_byte) AS h
 FROM edges JOIN d USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN counts c ON c.doc_id = d.doc_id"""


@query
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Leading whitened components of every embedding; the deviation is null beyond a long."""
    found = whitening.whiten(table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query
def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document by a Feistel permutation of row numbers."""
    return sharding.places(table(spark, folder, "documents"))


ORACLES["op12_sharding"] = sharding.places_sql()


@query
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents with their near words' most frequent form."""
    return spelling.variants(table(spark, folder, "documents"))


ORACLES["op13_spelling"] = spelling.variants_sql()
