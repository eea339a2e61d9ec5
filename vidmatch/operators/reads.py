"""Reads behind the review screens: pages, details, request statuses."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmatch.functions.nested import empty_offers, empty_pushes
from vidmatch.functions.numbers import as_column
from vidmatch.functions.status import NEEDS_REVIEW
from vidmatch.functions.text import MAX_SEARCH_TOKENS, blank_to_null, is_blank, name_with_id, search_tokens
from vidmatch.operators.joins import children_join, skew_join
from vidmatch.operators.nesting import CHUNK, SALTS, nest
from vidmatch.operators.ranking import PAGE_ROWS, first_per_key, newest_page
from vidmatch.schemas import DEFAULT_SOURCE
from vidmatch.session import cut_lineage

# Groups in which the entities of requests are counted (a power of two), the entities from
# which a group is cut and dealt apart, and those of one task.
REQUEST_GROUPS = 1 << 16
CROWD = 50_000
TASK_ROWS = 500_000


# --- videos ---------------------------------------------------------------------------


def presentable_videos(videos: DataFrame) -> DataFrame:
    """Hide rows with neither source nor video id; an empty source gets a default."""
    return videos.where(
        ~is_blank(F.col("source")) | ~is_blank(F.col("video_id"))
    ).withColumn("source", F.coalesce(blank_to_null(F.col("source")), F.lit(DEFAULT_SOURCE)))


def with_status(videos: DataFrame, status: str | None) -> DataFrame:
    return videos.where(F.col("status") == status) if status else videos


def matching_term(videos: DataFrame, term: str | None, tokenize: str = "space") -> DataFrame:
    """Videos that have any token of the term among their keywords."""
    if not term or not term.strip():
        return videos
    return videos.where(
        F.arrays_overlap("search_keywords", search_tokens(term, MAX_SEARCH_TOKENS, tokenize))
    )


def total_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_count"))


def summary_rows(videos: DataFrame) -> DataFrame:
    """Videos with the defaults a summary shows."""
    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)

    return presentable_videos(videos).select(
        "video_uuid",
        "video_id",
        "source",
        "gcs_uri",
        "md5_hash",
        "title",
        "description",
        "timestamp",
        count("stats_identified_count"),
        count("stats_matched_count"),
        count("stats_approved_count"),
        F.coalesce("active_pushes", empty_pushes()).alias("active_pushes"),
        F.coalesce("has_successful_push", F.lit(False)).alias("has_successful_push"),
        F.coalesce("status", F.lit(NEEDS_REVIEW)).alias("status"),
    )


def summary_page(
    videos: DataFrame,
    limit: int = 10,
    offset: int = 0,
    status: str | None = None,
    term: str | None = None,
    tokenize: str = "space",
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """One page, newest first, with the count of all rows that pass the filters.

    The count includes rows without a timestamp and stubs, which no page shows;
    a stub still takes its place on the page it falls on.
    """
    found = matching_term(with_status(videos, status), term, tokenize)
    page = newest_page(found, "timestamp", "video_uuid", limit, offset, page_rows)
    return summary_rows(page).withColumn("total_count", total_count(found).scalar())


def attach_inventory(candidates: DataFrame, inventory: DataFrame, as_of: Column | str) -> DataFrame:
    """Candidates with catalog data, and the defaults for what is missing."""
    # Absent rows get the defaults; a stored NULL brand or title is kept as it is.
    data = inventory.select(
        "offer_id",
        F.col("title").alias("_title"),
        F.col("brand").alias("_brand"),
        F.col("image_link").alias("_image"),
        F.col("availability").alias("_availability"),
        F.lit(True).alias("_known"),
    )
    joined = skew_join(
        candidates,
        data,
        ["offer_id"],
        "left",
        spread=["video_uuid", "identified_product_uuid"],
    )
    by_user = F.coalesce("is_added_by_user", F.lit(False))
    return joined.select(
        "video_uuid",
        "identified_product_uuid",
        F.coalesce("offer_id", F.lit("")).alias("offer_id"),
        F.when(F.col("_known"), F.col("_title")).otherwise(F.lit("Unknown")).alias("title"),
        # A product that a user added has no brand; one that the catalog lacks stays NULL.
        F.when(F.col("_known") & (F.col("_brand").isNotNull() | ~by_user), F.col("_brand"))
        .otherwise(F.lit(""))
        .alias("brand"),
        F.col("_image").alias("image_link"),
        F.col("_availability").alias("availability"),
        F.coalesce("modified_timestamp", as_column(as_of)).alias("matched_timestamp"),
        F.coalesce("distance", F.lit(0.0)).alias("distance"),
        F.coalesce("candidate_status", F.lit("UNREVIEWED")).alias("candidate_status"),
        by_user.alias("is_added_by_user"),
        F.coalesce("user", F.lit("system")).alias("user"),
    )


def attach_candidates(
    identified: DataFrame, candidates: DataFrame, count_in: DataFrame | None = None
) -> DataFrame:
    """Identified products with their candidates, one row per candidate.

    A product without candidates keeps one row with NULLs; candidates of unknown
    products are dropped. ``count_in`` holds the same candidates before anything was
    attached to them, to be counted there.
    """
    matches = candidates.withColumnRenamed("identified_product_uuid", "idp_uuid").select(
        "video_uuid",
        "idp_uuid",
        *[
            F.col(c).alias(f"matched_{c}")
            for c in candidates.columns
            if c not in ("video_uuid", "identified_product_uuid")
        ],
    )
    products = identified.select(
        "video_uuid",
        "idp_uuid",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("relevance_reasoning", F.lit("")).alias("relevance_reasoning"),
        F.coalesce("video_timestamp", F.lit(0)).cast("long").alias("video_timestamp"),
    )
    plain = candidates if count_in is None else count_in
    counted = plain.select("video_uuid", F.col("identified_product_uuid").alias("idp_uuid"))
    return children_join(products, matches, ["video_uuid", "idp_uuid"], ["matched_offer_id"], count_in=counted)


def with_matches(identified: DataFrame, candidates: DataFrame) -> DataFrame:
    """Identified products that have at least one candidate."""
    found = candidates.select(
        "video_uuid", F.col("identified_product_uuid").alias("idp_uuid")
    ).distinct()
    return identified.join(found, ["video_uuid", "idp_uuid"], "left_semi")


def video_detail_rows(
    videos: DataFrame,
    identified: DataFrame,
    candidates: DataFrame,
    inventory: DataFrame,
    as_of: Column | str,
    video_uuid: str | None = None,
) -> DataFrame:
    """Video, identified product and candidate side by side, one row per candidate."""
    if video_uuid is not None:
        only = F.col("video_uuid") == video_uuid
        videos, identified = videos.where(only), identified.where(only)
        candidates = candidates.where(only)
    products = attach_candidates(identified, attach_inventory(candidates, inventory, as_of), candidates)
    heads = presentable_videos(videos).select(
        "video_uuid", "source", "video_id", "gcs_uri", "md5_hash", F.col("title").alias("video_title")
    )
    # As many rows per video as candidates; every identified product has one.
    return children_join(
        heads, products, ["video_uuid"], ["idp_uuid", "matched_offer_id"], count_in=candidates, keys_in=identified
    )


def video_detail(
    videos: DataFrame,
    identified: DataFrame,
    candidates: DataFrame,
    inventory: DataFrame,
    as_of: Column | str,
    video_uuid: str | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Nested form: video -> identified products -> candidates.

    Arrays hold about ``chunk`` entries; larger ones go on in further rows.
    """
    if video_uuid is not None:
        only = F.col("video_uuid") == video_uuid
        videos, identified = videos.where(only), identified.where(only)
        candidates = candidates.where(only)
    products = attach_candidates(identified, attach_inventory(candidates, inventory, as_of), candidates)
    fields = [c for c in products.columns if c.startswith("matched_")]
    match = F.when(
        F.col("matched_offer_id").isNotNull(),
        F.struct(*[F.col(c).alias(c.removeprefix("matched_")) for c in fields]),
    )
    keys = ["video_uuid", "idp_uuid", "title", "description", "relevance_reasoning", "video_timestamp"]
    # collect_list leaves out the NULL of a product without candidates.
    counted = candidates.select(
        "video_uuid", F.col("identified_product_uuid").alias("idp_uuid")
    )
    nested = nest(
        products, keys, "matched_offer_id", match, "matched_products", chunk, count_in=counted
    )
    product = F.struct(*keys[1:], "match_chunk", "matched_products")
    per_video = nest(
        nested.withColumn("match_chunk", F.col("chunk_no")).drop("chunk_no"),
        ["video_uuid"],
        "idp_uuid",
        product,
        "identified_products",
        chunk,
        count_in=identified,
    )
    heads = presentable_videos(videos).select(
        "video_uuid", "source", "video_id", "gcs_uri", "md5_hash", F.col("title").alias("video_title")
    )
    empty = F.array().cast(per_video.schema["identified_products"].dataType)
    return heads.join(per_video, "video_uuid", "left").withColumn(
        "identified_products", F.coalesce("identified_products", empty)
    )


# --- push requests ----------------------------------------------------------------------


def by_user(requests: DataFrame, user: str | None) -> DataFrame:
    return requests.where(F.col("submitting_user") == user) if user else requests


def request_page(
    requests: DataFrame, limit: int = 10, offset: int = 0, user: str | None = None, page_rows: int = PAGE_ROWS
) -> DataFrame:
    """One page of requests, newest first, with the count of all of them."""
    found = by_user(requests, user)
    page = newest_page(found, "timestamp", "request_uuid", limit, offset, page_rows)
    return page.withColumn("total_count", total_count(found).scalar())


def entity_defaults(deployments: DataFrame) -> DataFrame:
    """Missing ids become 0, missing offers an empty map."""
    out = deployments
    for name in ("customer_id", "campaign_id", "ad_group_id"):
        out = out.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out.withColumn("offers", F.coalesce("offers", empty_offers()))


def offer_rows(deployments: DataFrame) -> DataFrame:
    """One row per offer of a deployment; no stored status means PENDING."""
    keys = [c for c in deployments.columns if c not in ("offers", "error_message")]
    exploded = (
        entity_defaults(deployments)
        # Outer, with the test behind it: see publish.expand_submissions.
        .select(*keys, F.explode_outer("offers").alias("offer_id", "info"))
        .where(F.col("offer_id").isNotNull())
    )
    return exploded.select(
        *keys,
        "offer_id",
        F.coalesce("info.status", F.lit("PENDING")).alias("status"),
        F.col("info.cpc_bid_micros").alias("cpc_bid_micros"),
        F.col("info.error_message").alias("error_message"),
    )


def attach_video(requests: DataFrame, videos: DataFrame) -> DataFrame:
    heads = presentable_videos(videos).select(
        "video_uuid",
        F.struct("source", "video_id", "gcs_uri", "md5_hash", "title", "description").alias("video"),
    )
    return skew_join(requests, heads, ["video_uuid"], "left", spread=["request_uuid"])


def attach_deployments(requests: DataFrame, deployments: DataFrame) -> DataFrame:
    """Requests with their deployments, one row per deployment.

    A request without deployments keeps one row. The offers stay a map inside it.
    """
    entities = entity_defaults(deployments).select(
        "request_uuid",
        "customer_id",
        "campaign_id",
        "ad_group_id",
        "offers",
        F.col("error_message").alias("entity_error_message"),
    )
    return children_join(
        requests, entities, ["request_uuid"], ["campaign_id", "ad_group_id"], count_in=deployments
    )


def nested_requests(requests: DataFrame, deployments: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Requests with ``ads_entities``; a request with very many goes on in more rows."""
    entity = F.struct(
        "customer_id",
        "campaign_id",
        "ad_group_id",
        F.col("offers"),
        F.col("error_message"),
    )
    grouped = nest(
        entity_defaults(deployments), ["request_uuid"], "ad_group_id", entity, "ads_entities", chunk
    )
    empty = F.array().cast(grouped.schema["ads_entities"].dataType)
    return requests.join(grouped, "request_uuid", "left").withColumn(
        "ads_entities", F.coalesce("ads_entities", empty)
    )


def request_detail(
    requests: DataFrame, deployments: DataFrame, videos: DataFrame, request_uuid: str
) -> DataFrame:
    """One request with its deployments and video; an unknown one gives no rows."""
    only = F.col("request_uuid") == request_uuid
    return attach_deployments(attach_video(requests.where(only), videos), deployments.where(only))


def video_request_status(
    deployments: DataFrame,
    requests: DataFrame,
    video_uuid: str | None,
    as_of: Column | dt.datetime | str,
) -> DataFrame:
    """Requests that have deployments of a video, with the stored request fields.

    A request that is not stored counts as PROCESSING, submitted by nobody, as of now. The
    error message of the request is not read here, as in the list view.
    """
    mine = deployments if video_uuid is None else deployments.where(F.col("video_uuid") == video_uuid)
    groups = mine.groupBy("request_uuid", "video_uuid").agg(
        F.count(F.lit(1)).alias("entities"),
        F.sum(F.size(F.coalesce("offers", empty_offers()))).cast("long").alias("offers"),
    )
    parent = requests.select(
        "request_uuid",
        "submitting_user",
        F.col("status").alias("_status"),
        F.col("timestamp").alias("_ts"),
        F.lit(True).alias("_known"),
    )
    return groups.join(parent, "request_uuid", "left").select(
        "request_uuid",
        "video_uuid",
        "submitting_user",
        F.when(F.col("_known"), F.col("_status")).otherwise(F.lit("PROCESSING")).alias("status"),
        F.coalesce("_ts", as_column(as_of)).alias("timestamp"),
        "entities",
        "offers",
    )


def requests_of_videos(
    deployments: DataFrame,
    requests: DataFrame,
    videos: DataFrame,
    as_of: Column | dt.datetime | str,
    video_uuid: str | None = None,
    chunk: int = CHUNK,
    task_rows: int = TASK_ROWS,
    crowd: int = CROWD,
) -> DataFrame:
    """The requests that have deployments of a video, each with its video and its entities.

    Deployments whose request was never stored show up as well, as in
    ``video_request_status``; those that name no request or no video do not. ``ads_entities``
    holds about ``chunk`` entities of (request, video); more go on in further rows, numbered
    by ``chunk_no``. ``video`` is NULL where the video is not stored.

    The entities are dealt once, by request, over tasks of about ``task_rows``; the requests
    are dealt to the same tasks, and every video to the tasks that have entities of it. Only
    requests in groups with more than ``crowd`` entities are counted one by one and spread.
    """
    keys = ["request_uuid", "video_uuid"]
    mine = deployments if video_uuid is None else deployments.where(F.col("video_uuid") == video_uuid)
    mine = entity_defaults(mine.dropna(subset=keys))
    fields = [c for c in ("customer_id", "campaign_id", "ad_group_id", "strategy", "offers", "error_message") if c in mine.columns]
    crowded, large, tasks = _entity_counts(mine, keys, chunk, task_rows, crowd)

    def salted(rows: DataFrame, salt: Callable[[Column], Column]) -> DataFrame:
        """With the salt, of the many of a crowded group, and the task that goes with it."""
        task = F.pmod(F.xxhash64("request_uuid", "_salt"), F.lit(tasks)).cast("int")
        return rows.withColumn("_salt", salt(F.coalesce("_salts", F.lit(1)))).withColumn("_task", task)

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_group", _request_group()).join(F.broadcast(crowded), "_group", "left")

    # Entities of crowded groups are numbered before they are dealt, as in ``nest``, by the
    # hash of their key: two keys of one hash are cut finer than they need.
    pieces = large.select(
        "_key", F.ceil(F.col("_n") / chunk).cast("int").alias("_pieces"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_p_salt")
    )
    piece = F.xxhash64("ad_group_id")
    numbered = (
        grouped(mine)
        .withColumns({"_key": F.xxhash64(*keys), "_p_salt": F.pmod(piece, F.lit(SALTS)).cast("int")})
        .join(pieces, ["_key", "_p_salt"], "left")
        .withColumn("_no", F.when(F.col("_salts").isNotNull(), F.pmod(piece, F.coalesce("_pieces", F.lit(1))).cast("int")))
    )
    entities = salted(numbered, lambda n: F.pmod(F.xxhash64("video_uuid", "_no"), n).cast("int"))
    whole = (
        entities.select("_task", "_salt", *keys, "_no", *fields)
        .repartitionById(tasks, "_task")
        .groupBy("_task", "_salt", *keys, "_no")
        .agg(F.collect_list(F.struct(*fields)).alias("_all"))
    )
    # The others are together now, no more than ``crowd``, and are cut where they are.
    count = F.ceil(F.size("_all") / chunk).cast("int")
    as_it_is = F.array(F.struct(F.coalesce("_no", F.lit(0)).alias("chunk_no"), F.col("_all").alias("ads_entities")))
    cut = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.struct(
            i.alias("chunk_no"), F.filter("_all", lambda e: F.pmod(F.xxhash64(e.ad_group_id), count) == i).alias("ads_entities")
        ),
    )
    parts = F.when(F.col("_no").isNotNull() | (count <= 1), as_it_is).otherwise(F.filter(cut, lambda part: F.size(part.ads_entities) > 0))
    # Outer for the reason given in ``publish.expand_submissions``; no array is empty.
    nested = whole.select("_task", "_salt", *keys, F.explode_outer(parts).alias("_part")).select("_task", "_salt", *keys, "_part.*")
    parent = requests.select(
        "request_uuid",
        "submitting_user",
        F.col("status").alias("_status"),
        F.col("timestamp").alias("_ts"),
        F.lit(True).alias("_known"),
    )
    parents = salted(grouped(parent), lambda n: F.explode(F.sequence(F.lit(0), n - 1))).drop("_group", "_salts")
    video = videos.select(
        F.col("video_uuid").alias("_video"),
        F.struct("video_uuid", "video_id", "source", "title", "gcs_uri").alias("video"),
    )
    # A row for each video and no more numbers in it than there are tasks.
    asked = entities.groupBy("video_uuid").agg(F.collect_set("_task").alias("_tasks"))
    found = asked.join(video, F.col("video_uuid") == F.col("_video")).select(F.explode("_tasks").alias("_task"), "video_uuid", "video")
    return (
        nested.join(parents.repartitionById(tasks, "_task"), ["_task", "_salt", "request_uuid"], "left")
        .join(found.repartitionById(tasks, "_task"), ["_task", "video_uuid"], "left")
        .select(
            *keys,
            "chunk_no",
            "ads_entities",
            "submitting_user",
            F.when(F.col("_known"), F.col("_status")).otherwise(F.lit("PROCESSING")).alias("status"),
            F.coalesce("_ts", as_column(as_of)).alias("timestamp"),
            "video",
        )
    )


def _request_group() -> Column:
    return F.xxhash64("request_uuid").bitwiseAND(F.lit(REQUEST_GROUPS - 1))


def _entity_counts(
    mine: DataFrame, keys: list[str], chunk: int, task_rows: int, crowd: int
) -> tuple[DataFrame, DataFrame, int]:
    """Groups of requests with more than ``crowd`` entities, the keys among them with more
    than ``chunk``, and the number of tasks."""
    sizes = cut_lineage(mine.groupBy(_request_group().alias("_group")).agg(F.count(F.lit(1)).alias("_n")))
    salts = F.ceil(F.col("_n") / task_rows).cast("int").alias("_salts")
    # Written apart, so that the entities are not shuffled to find out that there are few of them.
    crowded = cut_lineage(sizes.where(F.col("_n") > crowd).select("_group", salts))
    among = mine.withColumn("_group", _request_group()).join(F.broadcast(crowded), "_group", "left_semi")
    counts = among.groupBy(F.xxhash64(*keys).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    large = cut_lineage(counts.where(F.col("_n") > chunk))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    return crowded, large, max(int(mine.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(total / task_rows))


def inserted_offers(deployments: DataFrame) -> DataFrame:
    """Distinct offers with a success status, in any request of a video."""
    return (
        offer_rows(deployments)
        .where(F.upper("status") == "SUCCESS")
        .select("video_uuid", "offer_id")
        .distinct()
    )


def previous_destinations(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct destinations already pushed to, with readable labels.

    Failed requests and entities with an error do not count; of several entities
    of one destination the first in (timestamp desc, request) order names it.
    """
    live = requests.where(~F.col("status").eqNullSafe("FAILED")).select(
        "request_uuid", "video_uuid", F.col("timestamp").alias("_ts")
    )
    clean = entities.where(is_blank(F.col("error_message")))
    joined = clean.drop("video_uuid").join(live, "request_uuid")
    first = first_per_key(
        joined,
        ["video_uuid", "customer_id", "ad_group_id"],
        [F.col("_ts").desc_nulls_last(), "request_uuid", "campaign_id"],
    )
    return first.select(
        "video_uuid",
        name_with_id(F.col("customer_name"), F.col("customer_id")).alias("account"),
        name_with_id(F.col("campaign_name"), F.col("campaign_id")).alias("campaign"),
        name_with_id(F.col("ad_group_name"), F.col("ad_group_id")).alias("ad_group"),
    )


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
