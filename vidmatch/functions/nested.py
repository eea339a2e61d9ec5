"""Arrays, maps and structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vidmatch.functions.text import is_blank

# Fixed value: links embedded per product.
MAX_IMAGE_LINKS = 3

OFFER_INFO = "struct<status:string,cpc_bid_micros:bigint,error_message:string>"
OFFERS_MAP = f"map<string,{OFFER_INFO}>"
PUSH_MAP = "map<string,timestamp>"


def empty_offers() -> Column:
    return F.create_map().cast(OFFERS_MAP)


def empty_pushes() -> Column:
    return F.create_map().cast(PUSH_MAP)


def image_links(first: Column, more: Column, n: int | None = MAX_IMAGE_LINKS) -> Column:
    """The main link and the additional ones, the first ``n`` of them."""
    empty = F.array().cast("array<string>")
    head = F.when(is_blank(first), empty).otherwise(F.array(first))
    links = F.concat(head, F.coalesce(more, empty))
    return links if n is None else F.slice(links, 1, n)


def identified_count(products: Column) -> Column:
    return F.coalesce(F.array_size(products), F.lit(0)).cast("long")


def offers_map(ids: Column, cpc_micros: Column) -> Column:
    """id -> (PENDING, bid, no error) for every distinct id."""
    entry = F.struct(
        F.lit("PENDING").alias("status"),
        cpc_micros.cast("long").alias("cpc_bid_micros"),
        F.lit(None).cast("string").alias("error_message"),
    )
    return F.map_from_entries(
        F.transform(F.array_distinct(ids), lambda i: F.struct(i, entry))
    )


def add_push(pushes: Column, request: Column, ts: Column) -> Column:
    """Set ``request`` in the map of active pushes, replacing an older entry."""
    return F.map_concat(drop_push(pushes, request), F.create_map(request, ts))


def drop_push(pushes: Column, request: Column) -> Column:
    return F.map_filter(F.coalesce(pushes, empty_pushes()), lambda k, _: k != request)


def without_embedding(product: Column) -> Column:
    return product.dropFields("embedding")
