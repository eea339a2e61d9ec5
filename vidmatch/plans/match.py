"""The match job: new identified products against the catalog vectors."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmatch.functions.numbers import as_column, now_seconds
from vidmatch.operators.knn import CellModel, ivf_knn, knn
from vidmatch.operators.matching import (
    attach_catalog,
    drop_existing,
    newest_embeddings,
    unmatched,
)
from vidmatch.schemas import MATCHED_PRODUCTS
from vidmatch.session import cut_lineage
from vidmatch.sources.vector_index import VectorIndex

# Fixed value: default number of matches per identified product.
TOP_K = 10


def match_new_products(
    video_analysis: DataFrame,
    matched: DataFrame,
    embeddings: DataFrame,
    catalog: DataFrame,
    k: int = TOP_K,
    as_of: Column | dt.datetime | str | None = None,
    dedupe_embeddings: bool = True,
    strict_null: bool = False,
    same_model: bool = False,
    cells: CellModel | None = None,
    nprobe: int | None = 8,
    index: VectorIndex | None = None,
    ties=None,
) -> DataFrame:
    """Rows to append to ``matched_products``.

    Top-k first, catalog and existing pairs after it, as the numbers then mean
    "up to k". With ``cells`` the search is approximate. An ``index`` is searched
    instead of ``embeddings``, exactly if ``nprobe`` is None.
    """
    # Used for the size check, the search and the texts: the history is read once.
    queries = cut_lineage(unmatched(video_analysis, matched, strict_null))
    base = newest_embeddings(embeddings) if dedupe_embeddings else embeddings
    if index is not None:
        hits = index.search(queries, k, nprobe)
    elif cells is None:
        hits = knn(queries, base, k, same_model=same_model)
    else:
        hits = ivf_knn(queries, base, cells, k, nprobe, same_model=same_model)
    texts = queries.select(
        "uuid",
        F.col("title").alias("identified_product_title"),
        F.col("description").alias("identified_product_description"),
    )
    rows = drop_existing(attach_catalog(hits, catalog, ties), matched).join(texts, "uuid")
    stamp = now_seconds() if as_of is None else as_column(as_of)
    return rows.withColumn("timestamp", stamp).select(*MATCHED_PRODUCTS.names)
