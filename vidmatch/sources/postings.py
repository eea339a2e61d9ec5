"""Keywords by token: which videos have a word, without reading the videos."""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidmatch.functions.text import MAX_SEARCH_TOKENS, search_tokens
from vidmatch.sources.keyed import PART
from vidmatch.sources.tables import read_table

POSTINGS = T.StructType(
    [
        T.StructField("token", T.StringType()),
        T.StructField("video_uuid", T.StringType()),
        T.StructField("present", T.BooleanType()),
    ]
)
#: Ranges over which the videos of one token are dealt: a word of every video is no single range.
SLICES = 16


@dataclass(frozen=True)
class Postings:
    """A log of (token, video) rows at ``path``, kept up to date by changed videos.

    Every update is one folder ``batch=<number>/part=<hash of token and slice>``. Whether a
    video has a word is what the last batch that names both says; a search folds the rows of
    the words it asks for, ``compact`` all of them. An update costs what its own words cost,
    whatever the log holds. One writer at a time.
    """

    path: str
    parts: int = 256
    slices: int = SLICES

    def _slice(self) -> Column:
        return F.pmod(F.xxhash64("video_uuid"), F.lit(self.slices)).cast("int")

    def _part(self, of: str | Column) -> Column:
        return F.pmod(F.xxhash64("token", of), F.lit(self.parts)).cast("int")

    def _rows(self, videos: DataFrame, present: bool) -> DataFrame:
        words = videos.select("video_uuid", F.explode("search_keywords").alias("token"))
        return words.where("token IS NOT NULL").select("token", "video_uuid", F.lit(present).alias("present"))

    def _dealt(self, rows: DataFrame, value: Column) -> DataFrame:
        """``rows`` with one ``value`` for a word of a video, in tasks that each hold rows of one range.

        Dealt before they are aggregated: a map task that aggregates its words first
        spills them when its share of the videos is large.
        """
        pieces = ceil(_tasks(rows.sparkSession) / self.parts)
        piece = F.pmod(F.xxhash64("video_uuid", "token"), F.lit(pieces)).cast("int")
        dealt = rows.withColumn("_task", self._part(self._slice()) * pieces + piece).repartitionById(self.parts * pieces, "_task")
        one = dealt.groupBy("_task", "token", "video_uuid").agg(value.alias("present"))
        return one.withColumn(PART, F.floor(F.col("_task") / pieces).cast("int"))

    def _write(self, rows: DataFrame, batch: int) -> None:
        rows.select(*POSTINGS.names, PART).write.mode("overwrite").partitionBy(PART).parquet(f"{self.path}/batch={batch}")

    def update(self, new: DataFrame, old: DataFrame | None = None) -> None:
        """Take in changed videos (video_uuid, search_keywords): ``old`` as they were, ``new`` as they are.

        Words that a video has no longer go; a video that is in ``old`` alone goes with all
        its words. A word that is in both stays. No stored row is read or written.
        """
        rows = self._rows(new, True)
        if old is not None:
            rows = rows.unionByName(self._rows(old, False))
        self._write(self._dealt(rows, F.bool_or("present")), self._next_batch(new.sparkSession))

    def compact(self, spark: SparkSession, path: str) -> Postings:
        """A new log at ``path`` that starts with the current rows as its only batch.

        For a pause of the writers; readers and writers switch to it afterwards. The old
        log is not touched.
        """
        target = Postings(path, self.parts, self.slices)
        rows = self._stored(spark).withColumn("_last", _order())
        target._write(self._dealt(rows, F.max("_last") % 2 == 1).where("present"), 0)
        return target

    def find(self, terms: DataFrame, tokenize: str = "space") -> DataFrame:
        """term_id and video_uuid for all ``terms`` (term_id, term): videos with any word of the term.

        At most ``MAX_SEARCH_TOKENS`` words of a term are looked up; a term without words
        finds nothing. Ranges of other words are not read.
        """
        words = search_tokens(F.col("term"), MAX_SEARCH_TOKENS, tokenize)
        slices = F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1)))
        asked = terms.select("term_id", F.explode(F.array_distinct(words)).alias("token")).select("term_id", "token", slices.alias("slice"))
        spark = terms.sparkSession
        # No more numbers than the log has ranges.
        touched = [r[0] for r in asked.select(self._part("slice").alias(PART)).distinct().collect()]
        stored = self._stored(spark).where(F.col(PART).isin(touched)).withColumns({"slice": self._slice(), "_last": _order()})
        # Words that are asked for are dealt by video before they are folded and meet their
        # terms: the pairs, a row for each word of a term, are made where they are made distinct.
        named = stored.join(asked.select("token", "slice").distinct(), ["token", "slice"], "left_semi")
        dealt = named.select("token", "video_uuid", "_last").repartition(_tasks(spark), "video_uuid")
        found = dealt.groupBy("token", "video_uuid").agg(F.max("_last").alias("_last")).where("_last % 2 = 1")
        return found.withColumn("slice", self._slice()).join(asked, ["token", "slice"]).select("term_id", "video_uuid").distinct()

    def _stored(self, spark: SparkSession) -> DataFrame:
        places = [T.StructField("batch", T.IntegerType()), T.StructField(PART, T.IntegerType())]
        return read_table(spark, self.path, T.StructType([*POSTINGS.fields, *places]))

    def _next_batch(self, spark: SparkSession) -> int:
        files = self._stored(spark).inputFiles()
        return 1 + max((int(re.search(r"/batch=(\d+)/", f)[1]) for f in files), default=-1)


def _order() -> Column:
    """Grows with the batch; odd where the video has the word."""
    return F.col("batch") * 2 + F.col("present").cast("int")


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
