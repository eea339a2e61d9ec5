"""Language identification in two steps: the family, then the language within it.

A text is the mean of hashed byte n-grams (one to three bytes, letters folded). Linear
support vector machines tell the families apart, one for each family against the rest;
within a family, one for each pair of its languages. They are fitted by Spark on a
bounded sample of labelled rows: for each language the ``sample`` rows of smallest hash.
Every text is scored whole, in place, by sums of weights over array positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vidmatch.llm.arrays import LOWER, blocks
from vidmatch.session import cut_lineage

# Families of languages by ISO 639-1 code; any other is its own family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "pl", "cs", "sk"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "celtic": ["ga", "gd", "cy", "br"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tt"],
    "indo-aryan": ["hi", "bn", "ur", "mr", "gu", "pa", "ne", "si"],
    "semitic": ["ar", "he", "am", "mt"],
    "dravidian": ["ta", "te", "kn", "ml"],
}
FAMILY_OF = {language: family for family, languages in FAMILIES.items() for language in languages}

UNKNOWN = "und"
DIMENSIONS, SAMPLE = 4096, 1000
#: Bytes of the texts that are scored at once.
SCORED = 1 << 18
#: Parts of a language from which the sample is drawn before it is drawn from them together.
SLICES = 64
ORDERS = (1, 2, 3)

#: ASCII in lower case, with a blank for what is no letter; other bytes stay.
FOLD = LOWER.copy()
FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def gram_buckets(data: np.ndarray, offsets: np.ndarray, n: int, dimensions: int) -> np.ndarray:
    """The bucket of the n-gram at every byte; ``dimensions`` where it would leave the text."""
    folded = FOLD[data].astype(np.uint32)
    code = np.full(len(data), n, np.uint32)
    for k in range(n):
        part = folded[k:]
        code[: len(part)] = code[: len(part)] * np.uint32(16777619) ^ part
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA6B)
    out = (code >> np.uint32(7)).astype(np.int64) % dimensions
    for k in range(1, n):
        at = offsets[1:] - k
        out[at[at >= offsets[:-1]]] = dimensions
    return out


def features(data: np.ndarray, offsets: np.ndarray, dimensions: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and mean counts of each text."""
    grams = [gram_buckets(data, offsets, n, dimensions) for n in ORDERS]
    for a, b in zip(offsets, offsets[1:], strict=False):
        counts = np.bincount(np.concatenate([g[a:b] for g in grams]), minlength=dimensions + 1)[:dimensions]
        at = np.flatnonzero(counts)
        yield at, counts[at] / max(1, counts.sum())


@dataclass
class Model:
    """Weights of the machines: ``weights[bucket, machine]`` and their intercepts."""

    dimensions: int = DIMENSIONS
    languages: dict[str, list[str]] = field(default_factory=dict)  # by family
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIMENSIONS + 1, 0), np.float32))
    intercepts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: ("family", name, None) or (family, language, other language), in the weights' order.
    machines: list[tuple[str, str, str | None]] = field(default_factory=list)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each text, a column for each machine."""
        n = len(offsets) - 1
        totals, sums = np.zeros(n), np.zeros((n, len(self.machines)))
        some = np.flatnonzero(np.diff(offsets))
        if len(some) and self.machines:
            for order in ORDERS:
                grams = gram_buckets(data, offsets, order, self.dimensions)
                totals[some] += np.add.reduceat((grams < self.dimensions).astype(np.int64), offsets[some])
                for m in range(len(self.machines)):
                    sums[some, m] += np.add.reduceat(self.weights[grams, m], offsets[some], dtype=np.float64)
        return sums / np.maximum(totals, 1)[:, None] + self.intercepts

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language and a score from 0 to 1 for each row of margins."""
        n = len(margins)
        if not self.languages:
            return np.full(n, UNKNOWN, object), np.zeros(n)
        chance = 1 / (1 + np.exp(-2 * np.clip(margins, -300, 300)))
        names = sorted(self.languages)
        column = {m: k for k, m in enumerate(self.machines)}
        family = np.ones((n, len(names)))
        for k, name in enumerate(names):
            if ("family", name, None) in column:
                family[:, k] = chance[:, column["family", name, None]]
            elif len(names) == 2:  # one machine tells two families apart
                family[:, k] = 1 - chance[:, column["family", names[1 - k], None]]
        chosen = family.argmax(1)
        label, score = np.full(n, UNKNOWN, object), np.zeros(n)
        for k, name in enumerate(names):
            rows = np.flatnonzero(chosen == k)
            own = self.languages[name]
            wins, sure = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for (i, a), (j, b) in combinations(enumerate(own), 2):
                p = chance[rows, column[name, a, b]]
                wins[:, i] += p >= 0.5
                wins[:, j] += p < 0.5
                sure[:, i] += p
                sure[:, j] += 1 - p
            sure = sure / (len(own) - 1) if len(own) > 1 else np.ones_like(sure)
            best = (wins + sure / 2).argmax(1)  # votes first, then certainty
            label[rows] = np.array(own, object)[best]
            total = family.sum(1)[rows]
            score[rows] = family[rows, k] / np.where(total > 0, total, 1) * sure[np.arange(len(rows)), best]
        return label, score


def training_sample(docs: DataFrame, size: int, text: str, lang: str, key: str) -> DataFrame:
    """text and lang of at most ``size`` different rows of each language: those of smallest hash.

    A row is its key, language and text, so that repeated keys and rows without one count
    by themselves and equal rows once. Rows are chosen by hashes, without their texts,
    first within ``SLICES`` slices of a language, so that no task orders all its rows.
    """
    labelled = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    labelled = labelled.withColumn("own", F.xxhash64("key", "lang", "text"))
    hashed = labelled.select("lang", F.xxhash64("key").alias("first"), "own").withColumn("slice", F.pmod("own", F.lit(SLICES)))
    for part in (["lang", "slice"], ["lang"]):
        # Equal rows have equal places: ``size`` different ones are kept.
        order = Window.partitionBy(*part).orderBy("first", "own")
        hashed = hashed.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= size).drop("n")
    # At most ``size`` hashes for each language.
    return labelled.join(F.broadcast(hashed.select("own")), "own", "left_semi").distinct().select("text", "lang")


def fit(
    docs: DataFrame,
    sample: int = SAMPLE,
    dimensions: int = DIMENSIONS,
    families: dict[str, str] = FAMILY_OF,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
) -> Model:
    """Fit on at most ``sample`` rows of each language; rows without text or language are left out."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f for _, d, o in blocks(batch.column(0)) for f in features(d, o, dimensions)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64()))],
                names=["lang", "at", "counts"],
            )

    @F.udf(VectorUDT())
    def vector(at: list[int], counts: list[float]):
        return Vectors.sparse(dimensions, at, counts)

    chosen = training_sample(docs, sample, text, lang, key)
    rows = cut_lineage(chosen.mapInArrow(counted, "lang string, at array<int>, counts array<double>"))
    known = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    model = Model(dimensions)
    for language in known:
        model.languages.setdefault(families.get(language, language), []).append(language)
    rows = rows.select("lang", vector("at", "counts").alias("features")).coalesce(4).cache()
    weights, intercepts = [], []

    def machine(part: DataFrame, positive: Column, name: tuple[str, str, str | None]) -> None:
        labelled = part.select(positive.cast("double").alias("label"), "features")
        fitted = LinearSVC(maxIter=15, tol=1e-3, regParam=1e-3).fit(labelled)
        weights.append(fitted.coefficients.toArray())
        intercepts.append(fitted.intercept)
        model.machines.append(name)

    names = sorted(model.languages)
    for name in names[:1] if len(names) == 2 else names * (len(names) > 2):
        machine(rows, F.col("lang").isin(model.languages[name]), ("family", name, None))
    for name in names:
        for a, b in combinations(model.languages[name], 2):
            machine(rows.where(F.col("lang").isin(a, b)), F.col("lang") == a, (name, a, b))
    rows.unpersist()
    stacked = np.zeros((dimensions + 1, len(weights)), np.float32, order="F")
    for k, w in enumerate(weights):
        stacked[:dimensions, k] = w
    model.weights, model.intercepts = stacked, np.array(intercepts)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` without ``text``, with the predicted language and a score.

    A null text or one without a letter is ``und`` with score 0, and so is every text
    if the model knows no language. Rows are judged one by one, whole; other columns
    are kept, those named as the new ones are replaced.
    """
    kept = [c for c in docs.columns if c not in (text, label, score)]
    narrow = docs.select(*[f"`{c}`" for c in kept], F.col(text).cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = [np.zeros(0, object)], [np.zeros(0)]
            for _, data, offsets in blocks(batch.column(len(kept)), SCORED):
                found, sure = model.predict(model.margins(data, offsets))
                none = ~has_letter(data, offsets)
                found[none], sure[none] = UNKNOWN, 0.0
                labels.append(found)
                scores.append(sure)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.concatenate(labels).tolist(), pa.string()), pa.array(np.concatenate(scores))],
                names=[*kept, label, score],
            )

    return narrow.mapInArrow(run, narrow.drop(text).schema.add(label, "string").add(score, "double"))


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True for each text with a letter of any script."""
    ascii_letter = (FOLD[data] != 0x20) & (data < 128)
    out = np.diff(np.append(0, np.cumsum(ascii_letter))[offsets]) > 0
    for k in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        rest = data[offsets[k] : offsets[k + 1]]
        if rest.max() >= 128:
            out[k] = any(map(str.isalpha, rest.tobytes().decode("utf-8", "replace")))
    return out


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % divisor


def identify(docs: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from those not held out."""
    held = remainder("doc_id", 5) == 0
    model = fit(docs.where(~held), sample, dimensions)
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model)


def recognised(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rows of no known language (``und``); all columns as they are."""
    k = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for row, data, offsets in blocks(batch.column(k), SCORED):
                found, _ = model.predict(model.margins(data, offsets))
                keep[row : row + len(found)] = (found != UNKNOWN) & has_letter(data, offsets)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
