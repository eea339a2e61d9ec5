"""Vectors for texts: the hook for an embedding model, and an offline stand-in."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmatch.functions.vectors import FULL_DIM
from vidmatch.operators.joins import skew_join
from vidmatch.session import cut_lineage

# texts -> matrix with one row per text
Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int) -> Encoder:
    """Signed word hashing: deterministic, needs no model."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode())
                out[i, h % dim] += 1.0 if h & (1 << 31) else -1.0
        return out

    return run


def _encoded(encoder: Encoder, texts: list[str], full_dim: int) -> list[np.ndarray | None]:
    """Vectors of unit length (as they are at full size); a zero vector is None."""
    if not texts:
        return []
    matrix = np.asarray(encoder(texts), dtype=float)
    if matrix.shape[1] == full_dim:
        return list(matrix)
    norms = np.linalg.norm(matrix, axis=1)
    return [row / norm if norm > 0 else None for row, norm in zip(matrix, norms, strict=True)]


def encode(
    df: DataFrame,
    text_col: str,
    encoder: Encoder | None = None,
    dim: int = 256,
    out: str = "embedding",
    full_dim: int = FULL_DIM,
) -> DataFrame:
    """Add the normalised vector of ``text_col``; a NULL text has no vector.

    The model is called with one Arrow batch of texts at a time, inside the tasks.
    """
    model = encoder or hashing_encoder(dim)

    @F.pandas_udf("array<double>")
    def encode_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            given = texts.notna().to_numpy()
            out: list = [None] * len(texts)
            vectors = _encoded(model, texts[given].tolist(), full_dim)
            for at, vector in zip(np.flatnonzero(given), vectors, strict=True):
                out[at] = vector
            yield pd.Series(out, index=texts.index, dtype=object)

    return df.withColumn(out, encode_texts(F.col(text_col)))


def encode_arrays(
    df: DataFrame,
    texts: str,
    encoder: Encoder | None = None,
    dim: int = 256,
    out: str = "embeddings",
    full_dim: int = FULL_DIM,
) -> DataFrame:
    """Vectors of an array of texts, in place: no explode and no regrouping."""
    model = encoder or hashing_encoder(dim)

    @F.pandas_udf("array<array<double>>")
    def encode_nested(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for arrays in batches:
            lists = [[] if a is None else list(a) for a in arrays]
            vectors = _encoded(model, [t for a in lists for t in a], full_dim)
            ends = np.cumsum([len(a) for a in lists])
            yield pd.Series(
                [vectors[e - len(a) : e] for a, e in zip(lists, ends, strict=True)],
                index=arrays.index,
                dtype=object,
            )

    return df.withColumn(out, encode_nested(F.col(texts)))


ENCODED = "_digest string, _vector array<double>, _error string"
#: Characters of an error that are kept.
ERROR_LENGTH = 500


def encode_distinct(
    df: DataFrame,
    text_col: str,
    encoder: Encoder | None = None,
    dim: int = 256,
    out: str = "embedding",
    full_dim: int = FULL_DIM,
) -> tuple[DataFrame, DataFrame]:
    """``df`` with the vectors of ``text_col``, and the rows whose text the model refused, with ``error``.

    Each different text (by its SHA-256) goes to the model once, however many rows have
    it. A batch that fails is halved until the texts that fail are alone; the others of
    the batch keep their vectors. The vectors are written once and joined back, a text
    of very many rows in several tasks. A NULL text has no vector and is not refused.
    """
    model = encoder or hashing_encoder(dim)
    keyed = df.withColumn("_digest", F.sha2(F.col(text_col), 256))
    texts = keyed.where(F.col("_digest").isNotNull()).groupBy("_digest").agg(F.first(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_tried(model, batch.column(1).to_pylist(), full_dim))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([None if v is None else list(v) for v, _ in found], pa.list_(pa.float64())),
                    pa.array([e for _, e in found], pa.string()),
                ],
                names=["_digest", "_vector", "_error"],
            )

    encoded = cut_lineage(texts.mapInArrow(run, ENCODED))
    joined = skew_join(keyed, encoded, ["_digest"], "left")
    good = joined.where(F.col("_error").isNull()).select(*df.columns, F.col("_vector").alias(out))
    return good, joined.where(F.col("_error").isNotNull()).select(*df.columns, F.col("_error").alias("error"))


def _tried(model: Encoder, texts: list[str], full_dim: int) -> Iterator[tuple[np.ndarray | None, str | None]]:
    """(vector, None) or (None, error) of each text."""
    try:
        vectors = _encoded(model, texts, full_dim)
        if len(vectors) != len(texts) or any(v is not None and not np.isfinite(v).all() for v in vectors):
            raise ValueError("the model gave no finite vector for each text")
    except Exception as error:  # noqa: BLE001 - whatever a model raises belongs to its texts
        if len(texts) == 1:
            yield None, f"{type(error).__name__}: {error}"[:ERROR_LENGTH]
            return
        half = len(texts) // 2
        yield from _tried(model, texts[:half], full_dim)
        yield from _tried(model, texts[half:], full_dim)
    else:
        yield from ((v, None) for v in vectors)
