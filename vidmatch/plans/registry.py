"""Named queries over the sample tables, flat and with fixed column names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidmatch.functions import ids, nested, numbers, text, vectors
from vidmatch.functions.status import counts_as_push, request_status, video_status
from vidmatch.operators import (
    accounts,
    analysis,
    catalog,
    intake,
    knn,
    matching,
    merge,
    publish,
    ranking,
    reads,
    review,
    sync,
    validate,
    variants,
)
from vidmatch.plans import sync as jobs
from vidmatch.plans.catalog import embed_new_products, text_of_products
from vidmatch.plans.match import TOP_K, match_new_products
from vidmatch.plans.totals import MatchCounts
from vidmatch.schemas import MATCHED_PRODUCTS, PRODUCT_EMBEDDINGS, SYNC_STATE
from vidmatch.session import new_folder, ship_package
from vidmatch.sources import files, tables
from vidmatch.sources.keyed import KeyedTable
from vidmatch.sources.postings import Postings
from vidmatch.sources.testdata import AS_OF, LISTING_TIES, SPLIT, SampleTables
from vidmatch.sources.vector_index import VectorIndex
from vidmatch.streaming.match_state import match_totals, stream_match_state
from vidmatch.streaming.sync import analysis_stream, match_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEARCH_TERM = "The est shoes"
OP_LIMIT = 560


def query(build: Callable[[SampleTables], DataFrame]) -> Callable[[SampleTables], DataFrame]:
    """Register a query under the name of its function."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return build(SampleTables(spark, folder))

    QUERIES[build.__name__] = run
    return build


def _round(c: str | Column) -> Column:
    return F.round(c, 6)


# --- catalog ---------------------------------------------------------------------------


@query
def latest_partition(t: SampleTables) -> DataFrame:
    return catalog.latest_partition(t.product_feed())


@query
def latest_snapshot(t: SampleTables) -> DataFrame:
    return catalog.latest_snapshot(t.product_feed()).select(
        "data_date", "offer_id", "title", "channel", "content_language", *LISTING_TIES
    )


@query
def snapshot_is_stale(t: SampleTables) -> DataFrame:
    feed = t.product_feed()
    old = feed.where(F.col("data_date") < F.lit("2000-01-01").cast("date"))
    return (
        catalog.snapshot_is_stale(None, feed)
        .select(F.lit("no table").alias("case"), "stale")
        .unionByName(
            catalog.snapshot_is_stale(catalog.latest_snapshot(feed), feed).select(
                F.lit("current").alias("case"), "stale"
            )
        )
        .unionByName(
            catalog.snapshot_is_stale(catalog.latest_snapshot(old), feed).select(
                F.lit("older").alias("case"), "stale"
            )
        )
        .unionByName(
            catalog.snapshot_is_stale(feed.where(F.col("offer_id") == ""), feed).select(
                F.lit("empty").alias("case"), "stale"
            )
        )
    )


@query
def new_products(t: SampleTables) -> DataFrame:
    rows = catalog.new_products(t.product_feed(), t.product_embeddings(), ties=LISTING_TIES)
    return rows.drop("additional_image_links")


@query
def listing_pick_embed(t: SampleTables) -> DataFrame:
    picked = catalog.pick_listing(t.product_feed(), ("channel", "language"), LISTING_TIES)
    return picked.select("offer_id", "channel", "content_language", *LISTING_TIES)


@query
def listing_pick_match(t: SampleTables) -> DataFrame:
    picked = catalog.pick_listing(t.product_feed(), ("channel",), LISTING_TIES)
    return picked.select("offer_id", "channel", "content_language", *LISTING_TIES)


@query
def product_text(t: SampleTables) -> DataFrame:
    return text_of_products(
        catalog.rename_category(catalog.latest_snapshot(t.product_feed()))
    )


@query
def image_links(t: SampleTables) -> DataFrame:
    feed = t.product_feed()
    more = F.array(F.concat("image_link", F.lit("?a")), F.concat("image_link", F.lit("?b")),
                   F.concat("image_link", F.lit("?c")))
    return (
        feed.select("offer_id", nested.image_links(F.col("image_link"), more).alias("links"))
        .select("offer_id", F.posexplode("links").alias("pos", "link"))
        .groupBy("pos", "link")
        .agg(F.count(F.lit(1)).alias("listings"))
        .withColumn("pos", F.col("pos").cast("long"))
    )


@query
def embed_products(t: SampleTables) -> DataFrame:
    """Vectors of the offline encoder for new offers: their size and length."""
    return embed_new_products(
        t.product_feed(), t.product_embeddings(), "offline", dim=64, ties=LISTING_TIES
    ).select("id", F.size("embedding").alias("dim"), _round(vectors.l2_norm(F.col("embedding"))).alias("norm"))


# --- vectors and matching -----------------------------------------------------------------


@query
def l2_normalize(t: SampleTables) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x * F.lit(3.0))
    unit = vectors.l2_normalize(scaled)
    return t.product_embeddings().select("id", F.posexplode(unit).alias("pos", "x")).select(
        "id", F.col("pos").cast("long").alias("pos"), _round("x").alias("x")
    )


@query
def unmatched_identified(t: SampleTables) -> DataFrame:
    return matching.unmatched(t.video_analysis(), t.matched_products()).select(
        "video_uuid", "uuid", "title"
    )


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("uuid", "id", _round("distance").alias("distance"), F.col("rank").cast("long").alias("rank"))


@query
def knn_match(t: SampleTables) -> DataFrame:
    return _hits(knn.knn(matching.explode_identified(t.video_analysis()), t.product_embeddings(), TOP_K))


@query
def knn_match_blocks(t: SampleTables) -> DataFrame:
    """Many queries: several blocks, a bound from a first look, heaps merged in a tree."""
    products = matching.explode_identified(t.video_analysis())
    quarter = products.agg(F.sum(F.size("embedding") * 2)).first()[0] or 1
    return _hits(knn.knn(products, t.product_embeddings(), TOP_K, max_broadcast_bytes=quarter))


@query
def knn_match_dirty(t: SampleTables) -> DataFrame:
    """Vectors with NaN, NULL or infinite elements are neither queries nor neighbours."""
    last = {"0": float("nan"), "1": None, "2": float("inf")}

    def spoilt(vector: str, label: Column) -> Column:
        cut = F.slice(vector, 2, F.size(vector))
        out = F.col(vector)
        for text, value in last.items():
            out = F.when(label == text, F.concat(F.array(F.lit(value).cast("double")), cut)).otherwise(out)
        return out.alias("embedding")

    products = matching.explode_identified(t.video_analysis())
    queries = products.select("uuid", spoilt("embedding", F.split("description", " ")[1]))
    labels = t.table("embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("label"))
    base = t.product_embeddings().join(labels, "id").select("id", spoilt("embedding", F.col("label")))
    return _hits(knn.knn(queries, base, TOP_K))


def _index(t: SampleTables, cells: int) -> VectorIndex:
    """A new index of all vectors, appended in two batches."""
    base = t.product_embeddings()
    index = VectorIndex(new_folder(t.spark))
    index.fit(base, cells)
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    index.append(base.where(half == 0), 0)
    index.append(base.where(half == 1), 1)
    return index


@query
def knn_match_cells(t: SampleTables) -> DataFrame:
    """Exact search in a stored index: the nearest cell gives the bound, the rest is pruned by it."""
    products = matching.explode_identified(t.video_analysis())
    return _hits(_index(t, 8).search(products, TOP_K))


@query
def ann_match(t: SampleTables) -> DataFrame:
    """Rows only: approximate by design, see ``ann_recall``."""
    return _hits(_index(t, 16).search(matching.explode_identified(t.video_analysis()), TOP_K, nprobe=6))


@query
def ann_match_all_cells(t: SampleTables) -> DataFrame:
    """Probing every cell must give the exact result."""
    return _hits(_index(t, 16).search(matching.explode_identified(t.video_analysis()), TOP_K, nprobe=16))


@query
def ann_recall(t: SampleTables) -> DataFrame:
    """Per query: the exact k-th distance, and whether 13 of 16 cells find nine tenths of the neighbours."""
    products = matching.explode_identified(t.video_analysis())
    index = _index(t, 16)
    exact, near = index.search(products, TOP_K), index.search(products, TOP_K, nprobe=13)
    found = exact.join(near.select("uuid", "id", F.lit(1).alias("hit")), ["uuid", "id"], "left")
    return found.groupBy("uuid").agg(
        _round(F.max("distance")).alias("kth_distance"),
        (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_ok"),
    )


@query
def vector_index_cells(t: SampleTables) -> DataFrame:
    """What the stored index holds: every vector once, none outside its cell's range."""
    index = _index(t, 8)
    stored = index.vectors(t.spark, "64", list(range(8)))
    sizes = index.sizes(t.spark).agg(F.sum("n").alias("counted"))
    return stored.agg(
        F.count(F.lit(1)).alias("stored"),
        F.count_distinct("bid").alias("ids"),
        F.lit(sizes.first()["counted"]).alias("counted"),
    )


@query
def match_catalog_join(t: SampleTables) -> DataFrame:
    hits = t.matched_products().select(
        "uuid", F.col("matched_product_offer_id").alias("id"), "distance", "timestamp"
    )
    joined = matching.attach_catalog(hits, catalog.latest_snapshot(t.product_feed()), LISTING_TIES)
    return joined.withColumn("distance", _round("distance"))


@query
def match_not_existing(t: SampleTables) -> DataFrame:
    """Decisions of the update whose pair the log before the split does not hold."""
    log = t.matched_products()
    split = F.lit(SPLIT).cast("timestamp")
    fresh = log.where(F.col("timestamp") >= split)
    return matching.drop_existing(fresh, log.where(F.col("timestamp") < split)).select(
        "uuid", "matched_product_offer_id", "timestamp", _round("distance").alias("distance")
    )


@query
def match_new_products_flow(t: SampleTables) -> DataFrame:
    """The whole match job; see ``entry``."""
    rows = match_new_products(
        t.video_analysis(),
        t.matched_products(),
        t.product_embeddings(),
        catalog.latest_snapshot(t.product_feed()),
        as_of="2024-02-01 00:00:00",
        ties=LISTING_TIES,
    )
    return rows.withColumn("distance", _round("distance"))


def _with_picture(t: SampleTables) -> DataFrame:
    """Log rows as candidates with catalog data."""
    log = t.matched_products().select(
        F.col("uuid").alias("identified_product_uuid"),
        F.col("matched_product_offer_id").alias("offer_id"),
        "distance",
    )
    nearest = ranking.first_per_key(log, ["identified_product_uuid", "offer_id"], ["distance"])
    return nearest.join(
        t.inventory().select("offer_id", "title", "brand", "image_link"), "offer_id", "left"
    )


@query
def variant_heroes(t: SampleTables) -> DataFrame:
    return variants.heroes(_with_picture(t)).withColumn("hero_distance", _round("hero_distance"))


@query
def variant_groups(t: SampleTables) -> DataFrame:
    grouped = variants.group_variants(_with_picture(t))
    return grouped.select(
        "identified_product_uuid",
        "image_link",
        "hero_offer_id",
        _round("hero_distance").alias("hero_distance"),
        F.explode("variants").alias("v"),
    ).select(
        "identified_product_uuid",
        "image_link",
        "hero_offer_id",
        "hero_distance",
        "v.variant_offer_id",
        "v.variant_title",
        "v.variant_brand",
    )


@query
def match_dedupe(t: SampleTables) -> DataFrame:
    rows = t.matched_products().select(
        F.col("uuid").alias("identified_product_uuid"),
        F.col("matched_product_offer_id").alias("offer_id"),
        "distance",
    )
    return ranking.dedupe_matches(rows, keys=("identified_product_uuid",)).withColumn(
        "distance", _round("distance")
    )


# --- analysis --------------------------------------------------------------------------------


@query
def json_ingest_identified(t: SampleTables) -> DataFrame:
    return analysis.parse_identified(t.raw_answers()).select(
        "video_uuid", F.col("pos").cast("long").alias("pos"), "title", "description", "video_timestamp"
    )


@query
def build_video_analysis(t: SampleTables) -> DataFrame:
    """Nested rows of the answers; here with the size of what they hold."""
    none = F.lit(None).cast("string")
    videos = t.raw_answers().select(
        F.col("uuid").alias("video_id"),
        F.lit("google_ads").alias("source"),
        none.alias("gcs_uri"),
        none.alias("md5_hash"),
        F.lit("t").alias("title"),
        none.alias("description"),
        "answer",
    )
    rows = analysis.build_video_analysis(videos, "offline", "sample", dim=32)
    first = F.col("identified_products")[0]
    return rows.select(
        "uuid",
        "source",
        "status",
        F.col("metadata.title").alias("title"),
        nested.identified_count(F.col("identified_products")).alias("products"),
        first.title.alias("first_title"),
        F.size(first.embedding).cast("long").alias("dim"),
        first.video_timestamp.alias("video_timestamp"),
    )


@query
def identified_text(t: SampleTables) -> DataFrame:
    none = F.lit(None).cast("string")
    line = text.identified_text(
        F.col("source"), F.col("text"), none, F.col("lang"), F.lit("")
    )
    return t.table("documents").select("doc_id", line.alias("text"))


@query
def identified_rows(t: SampleTables) -> DataFrame:
    return analysis.identified_rows(t.video_analysis()).drop("pos")


@query
def video_rows(t: SampleTables) -> DataFrame:
    return analysis.video_rows(t.video_analysis()).select(
        "video_uuid", "video_id", "source", "timestamp", "title", "description",
        "stats_identified_count", F.explode("search_keywords").alias("keyword"),
    )


# --- sync --------------------------------------------------------------------------------------


@query
def incremental_filter(t: SampleTables) -> DataFrame:
    return sync.since(t.matched_products(), SPLIT).select(
        "timestamp", "uuid", "matched_product_offer_id"
    )


@query
def match_video_join(t: SampleTables) -> DataFrame:
    return sync.with_video(t.matched_products(), t.video_analysis()).select(
        "idp_uuid", "video_uuid", "matched_product_offer_id", "timestamp",
        _round("distance").alias("distance"),
    )


@query
def first_seen_matches(t: SampleTables) -> DataFrame:
    return sync.first_seen_since(t.matched_products(), SPLIT).withColumn(
        "distance", _round("distance")
    )


@query
def delta_matches(t: SampleTables) -> DataFrame:
    return sync.match_delta(t.matched_products(), t.video_analysis(), SPLIT).withColumn(
        "distance", _round("distance")
    )


@query
def video_match_totals(t: SampleTables) -> DataFrame:
    return sync.match_totals(t.matched_products(), t.video_analysis())


@query
def sync_matches(t: SampleTables) -> DataFrame:
    return sync.new_matches(t.matched_products(), t.video_analysis(), SPLIT).withColumn(
        "distance", _round("distance")
    )


@query
def safe_watermark(t: SampleTables) -> DataFrame:
    return ranking.safe_marks(t.matched_products(), "timestamp", "2023-12-31 00:00:00")


@query
def active_offers(t: SampleTables) -> DataFrame:
    stored = t.inventory().select(text.doc_key("prod_", F.col("offer_id")).alias("doc_id"))
    return sync.active_offers(t.matched_products(), stored)


@query
def sync_inventory(t: SampleTables) -> DataFrame:
    stored = t.inventory().select(text.doc_key("prod_", F.col("offer_id")).alias("doc_id"))
    active = sync.active_offers(t.matched_products(), stored)
    return sync.inventory_rows(catalog.latest_snapshot(t.product_feed()), active, LISTING_TIES)


@query
def upsert_merge(t: SampleTables) -> DataFrame:
    """Inventory patched with the newest listings; a given NULL overwrites."""
    patch = catalog.pick_listing(
        catalog.latest_snapshot(t.product_feed()), ("channel",), LISTING_TIES
    ).select(
        "offer_id",
        "availability",
        F.when(F.col("channel") == "ONLINE", F.col("title")).alias("title"),
    )
    return merge.upsert(t.inventory(), patch, ["offer_id"], ["availability", "title"])


@query
def upsert_merge_ranges(t: SampleTables) -> DataFrame:
    """The same in a table kept in key ranges, patched twice."""
    patch = catalog.pick_listing(
        catalog.latest_snapshot(t.product_feed()), ("channel",), LISTING_TIES
    ).select(
        "offer_id",
        "availability",
        F.when(F.col("channel") == "ONLINE", F.col("title")).alias("title"),
    )
    rows = t.inventory()
    stored = KeyedTable(new_folder(t.spark), ["offer_id"], rows.schema, parts=16)
    stored.upsert(rows, [c for c in rows.columns if c != "offer_id"])
    for half in (0, 1):
        stored.upsert(patch.where(F.pmod(F.xxhash64("offer_id"), F.lit(2)) == half), ["availability", "title"])
    return stored.read(t.spark)


# --- videos and search ----------------------------------------------------------------------------


@query
def search_keywords(t: SampleTables) -> DataFrame:
    words = t.videos().select("video_uuid", F.explode_outer("search_keywords").alias("keyword"))
    return words.where(F.col("keyword").isNotNull())


@query
def keyword_filter(t: SampleTables) -> DataFrame:
    return reads.matching_term(t.videos(), SEARCH_TERM).select("video_uuid", "source")


@query
def keyword_postings(t: SampleTables) -> DataFrame:
    """Videos per benchmark item, each item a term; half of the videos changed after the first load."""
    videos = t.videos().select("video_uuid", "search_keywords")
    index = Postings(new_folder(t.spark), parts=16, slices=4)
    half = F.pmod(F.xxhash64("video_uuid"), F.lit(2)) == 0
    before = videos.withColumn("search_keywords", F.when(half, F.array(F.lit("stale"), F.lit("the"))).otherwise(F.col("search_keywords")))
    index.update(before)
    index.update(videos.where(half), before.where(half))
    return index.find(t.table("benchmark").select(F.col("item_id").alias("term_id"), F.col("text").alias("term")))


@query
def summary_page_deep(t: SampleTables) -> DataFrame:
    """A page far from the start, found by counts per time range."""
    page = reads.summary_page(t.videos(), limit=25, offset=123, page_rows=10)
    return page.select("video_uuid", "timestamp", "status", "total_count")


@query
def summary_page(t: SampleTables) -> DataFrame:
    page = reads.summary_page(
        t.videos(), limit=25, offset=5, status="Needs Review", term=SEARCH_TERM
    )
    return page.select(
        "video_uuid", "video_id", "source", "timestamp", "stats_identified_count",
        "stats_matched_count", "status", "total_count",
    )


@query
def summary_count(t: SampleTables) -> DataFrame:
    return reads.total_count(
        reads.matching_term(reads.with_status(t.videos(), "Needs Review"), SEARCH_TERM)
    )


@query
def candidates_inventory(t: SampleTables) -> DataFrame:
    return reads.attach_inventory(t.candidates(), t.inventory(), SPLIT).withColumn(
        "distance", _round("distance")
    )


def _detail_inputs(t: SampleTables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    videos = analysis.video_rows(t.video_analysis())
    identified = analysis.identified_rows(t.video_analysis())
    return videos, identified, t.candidates(), t.inventory()


@query
def video_detail(t: SampleTables) -> DataFrame:
    rows = reads.video_detail_rows(*_detail_inputs(t), as_of=SPLIT)
    return rows.select(
        "video_uuid", "source", "video_id", "video_title", "idp_uuid", "title", "video_timestamp",
        "matched_offer_id", "matched_title", "matched_brand", "matched_candidate_status",
        "matched_user", "matched_matched_timestamp", _round("matched_distance").alias("matched_distance"),
    )


@query
def video_detail_nested(t: SampleTables) -> DataFrame:
    """The nested document of each video, counted and summed over its arrays."""
    rows = reads.video_detail(*_detail_inputs(t), as_of=SPLIT)
    return rows.select("video_uuid", F.explode("identified_products").alias("p")).select(
        "video_uuid",
        F.col("p.idp_uuid").alias("idp_uuid"),
        F.size("p.matched_products").cast("long").alias("matches"),
        _round(
            F.aggregate("p.matched_products", F.lit(0.0), lambda a, m: a + m.distance)
        ).alias("distance_sum"),
    )


@query
def hide_no_matches(t: SampleTables) -> DataFrame:
    return reads.with_matches(
        analysis.identified_rows(t.video_analysis()), t.candidates()
    ).select("video_uuid", "idp_uuid", "title")


# --- review -----------------------------------------------------------------------------------------


@query
def last_write_wins(t: SampleTables) -> DataFrame:
    return review.last_decisions(t.decisions()).select(
        "video_uuid", "identified_product_uuid", "offer_id", "candidate_status", "position"
    )


@query
def candidate_deltas(t: SampleTables) -> DataFrame:
    return review.candidate_deltas(t.decisions(), t.candidates())


def _applied(t: SampleTables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return review.apply_candidates(
        t.video_states(), t.candidates(), t.inventory(), t.decisions(), as_of="2024-02-01 00:00:00"
    )


@query
def apply_candidates(t: SampleTables) -> DataFrame:
    return _applied(t)[0].select(
        "video_uuid", "stats_approved_count", "stats_matched_count", "status", "has_successful_push"
    )


@query
def apply_candidates_rows(t: SampleTables) -> DataFrame:
    return _applied(t)[1].withColumn("distance", _round("distance"))


@query
def user_added_product(t: SampleTables) -> DataFrame:
    return _applied(t)[2]


@query
def recount(t: SampleTables) -> DataFrame:
    return review.recount(t.candidates())


@query
def approved_flatten(t: SampleTables) -> DataFrame:
    return review.approved(t.candidates()).select(
        "video_uuid", "identified_product_uuid", "offer_id"
    )


@query
def video_status_rule(t: SampleTables) -> DataFrame:
    states = t.video_states()
    return states.select(
        "video_uuid",
        video_status(
            F.size("active_pushes"), F.col("has_successful_push"), F.col("stats_approved_count")
        ).alias("status"),
    )


# --- publication ---------------------------------------------------------------------------------------


@query
def submission_requests(t: SampleTables) -> DataFrame:
    requests, _, _ = publish.expand_submissions(t.submissions(), AS_OF)
    return requests.select(
        "request_uuid", "video_uuid", "submitting_user", "status", "timestamp",
        text.sorted_ids(F.col("offer_ids")).alias("offer_ids"),
    )


@query
def submission_expand(t: SampleTables) -> DataFrame:
    """Submissions x destinations x offers."""
    _, deployments, _ = publish.expand_submissions(t.submissions(), AS_OF)
    return reads.offer_rows(deployments).drop("strategy", "video_uuid")


@query
def submission_pushes(t: SampleTables) -> DataFrame:
    """Video status after the submissions, and the pushes under way."""
    _, _, patches = publish.expand_submissions(t.submissions(), AS_OF)
    videos = t.table("supplier").select(
        F.concat(F.lit("video-"), F.col("s_suppkey").cast("string")).alias("video_uuid"),
        F.lit("Needs Review").alias("status"),
        F.lit(None).cast(nested.PUSH_MAP).alias("active_pushes"),
    )
    pushes = patches.limit(0).drop("status")
    states, rows = publish.start_pushes(videos, pushes, patches)
    running = rows.groupBy("video_uuid").agg(F.count(F.lit(1)).alias("running"))
    return states.join(running, "video_uuid", "left").select(
        "video_uuid", "status", F.coalesce("running", F.lit(0)).cast("long").alias("running")
    )


@query
def work_batch(t: SampleTables) -> DataFrame:
    return publish.work_batch(t.requests(), AS_OF).select(
        "request_uuid", "status", "timestamp", F.col("stage").cast("long").alias("stage")
    )


@query
def lease_eligible(t: SampleTables) -> DataFrame:
    return publish.lease_eligible(t.requests(), AS_OF).select("request_uuid", "status", "leased_at")


@query
def tree_state(t: SampleTables) -> DataFrame:
    return publish.tree_state(t.listing_groups())


@query
def listing_tree_children(t: SampleTables) -> DataFrame:
    return publish.tree_children(t.listing_groups()).select(
        "ad_group_id", "parent", "resource_name", "product_item_id", "root_type"
    )


@query
def append_existing_check(t: SampleTables) -> DataFrame:
    return publish.flag_existing(t.listing_targets(), t.listing_groups()).select(
        "ad_group_id", "offer_id", "position", "is_present"
    )


@query
def listing_ops(t: SampleTables) -> DataFrame:
    return publish.listing_ops(t.listing_targets(), t.listing_groups()).withColumn(
        "step", F.col("step").cast("long")
    )


@query
def op_count_guard(t: SampleTables) -> DataFrame:
    return publish.guard_ops(
        publish.listing_ops(t.listing_targets(), t.listing_groups()), OP_LIMIT
    )


@query
def offer_outcomes(t: SampleTables) -> DataFrame:
    rows = publish.offer_outcomes(
        t.listing_targets(), t.listing_groups(), t.call_failures(), OP_LIMIT
    )
    return rows.select("ad_group_id", "offer_id", "position", "status")


@query
def unhandled_failed(t: SampleTables) -> DataFrame:
    rows = publish.fail_unhandled(
        t.listing_targets(), publish.existing_items(t.listing_groups())
    )
    return rows.select("ad_group_id", "offer_id", "position", "status")


@query
def deployment_updates(t: SampleTables) -> DataFrame:
    return publish.deployment_patches(t.outcomes())


@query
def offers_map_update(t: SampleTables) -> DataFrame:
    """Stored maps of the submissions after results for some of their offers."""
    _, deployments, _ = publish.expand_submissions(t.submissions(), AS_OF)
    lines = t.table("lineitem").select(
        F.concat_ws(
            "-",
            *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        ).alias("request_uuid"),
        F.col("l_suppkey").alias("ad_group_id"),
        F.col("l_partkey").cast("string").alias("offer_id"),
        F.when(F.col("l_returnflag") == "R", "FAILED").otherwise("SUCCESS").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
    )
    # Repeated lines are one result: of those of an offer the best one is applied.
    patched = publish.apply_outcomes(deployments, publish.deployment_patches(lines))
    return reads.offer_rows(patched).select(
        "request_uuid", "ad_group_id", "offer_id", "status", "cpc_bid_micros", "error_message"
    )


@query
def entity_status_counts(t: SampleTables) -> DataFrame:
    return publish.entity_counts(t.outcomes())


@query
def request_success_counts(t: SampleTables) -> DataFrame:
    return publish.request_counts(t.outcomes())


@query
def request_status_rollup(t: SampleTables) -> DataFrame:
    return publish.finished_requests(t.requests(), t.outcomes())


@query
def finalize_requests(t: SampleTables) -> DataFrame:
    broken = t.requests().where(F.col("status") == "PENDING").select(
        "request_uuid", F.lit("lost").alias("error")
    )
    finished = publish.finished_requests(t.requests(), t.outcomes(), broken)
    return publish.finalize_requests(t.requests(), finished, AS_OF).select(
        "request_uuid", "status", "error_message", "completed_at", "failed_at"
    )


@query
def video_push_finalize(t: SampleTables) -> DataFrame:
    """All requests but the pending ones finish at once."""
    requests = t.requests()
    pushes = requests.select("video_uuid", "request_uuid", F.col("timestamp").alias("active_since"))
    videos = t.table("customer").select(
        F.concat(F.lit("video-"), F.col("c_custkey").cast("string")).alias("video_uuid"),
        F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("stats_approved_count"),
        F.lit(False).alias("has_successful_push"),
        F.lit("Push in Progress").alias("status"),
    )
    finished = publish.finished_requests(
        requests.where(F.col("status") != "PENDING"), t.outcomes()
    )
    states, _ = publish.finish_pushes(videos, pushes, finished)
    return states.select("video_uuid", "has_successful_push", "status")


@query
def request_status_rule(t: SampleTables) -> DataFrame:
    """Rule columns alone, over every line as if it were a request."""
    success, total = F.col("l_linenumber") - 1, F.col("l_linenumber") % 4
    error = F.when(F.col("l_returnflag") == "R", F.lit("e"))
    bounded = F.least(success, total)
    return (
        t.table("lineitem")
        .select(
            request_status(bounded, total, error).alias("status"),
            counts_as_push(bounded, total, error).alias("counts_as_push"),
        )
        .groupBy("status", "counts_as_push")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


@query
def request_page(t: SampleTables) -> DataFrame:
    return reads.request_page(t.requests(), limit=50, offset=10).select(
        "request_uuid", "video_uuid", "submitting_user", "status", "timestamp", "total_count"
    )


@query
def request_page_deep(t: SampleTables) -> DataFrame:
    return reads.request_page(t.requests(), limit=50, offset=1234, page_rows=20).select(
        "request_uuid", "video_uuid", "submitting_user", "status", "timestamp", "total_count"
    )


@query
def user_filter(t: SampleTables) -> DataFrame:
    return reads.by_user(t.requests(), "user-7").select("request_uuid", "submitting_user")


def _deployments(t: SampleTables) -> DataFrame:
    return publish.expand_submissions(t.submissions(), AS_OF)[1]


@query
def requests_deployments(t: SampleTables) -> DataFrame:
    entities = t.entities().withColumn("offers", F.lit(None).cast(nested.OFFERS_MAP))
    return reads.attach_deployments(t.requests(), entities).select(
        "request_uuid", "status", "timestamp", "customer_id", "campaign_id", "ad_group_id"
    )


@query
def requests_nested(t: SampleTables) -> DataFrame:
    entities = t.entities().withColumn("offers", F.lit(None).cast(nested.OFFERS_MAP))
    return reads.nested_requests(t.requests(), entities).select(
        "request_uuid", F.size("ads_entities").cast("long").alias("entities")
    )


@query
def deployments_backfill(t: SampleTables) -> DataFrame:
    """Requests of videos with their entities and video, stored or not."""
    known = publish.expand_submissions(t.submissions().where(F.col("submitting_user") != "R"), AS_OF)[0]
    videos = t.videos().withColumn("video_uuid", F.concat(F.lit("video-"), "video_uuid"))
    rows = reads.requests_of_videos(_deployments(t), known, videos, "2002-01-01 00:00:00", chunk=2)
    entities = F.explode("ads_entities").alias("entity")
    return rows.select("request_uuid", "video_uuid", "status", "submitting_user", "timestamp", "video", entities).select(
        "request_uuid", "video_uuid", "status", "submitting_user", "timestamp",
        F.col("video.video_id").alias("video_id"), F.col("video.source").alias("source"),
        F.col("entity.ad_group_id").alias("ad_group_id"), F.col("entity.customer_id").alias("customer_id"),
        F.size("entity.offers").cast("long").alias("offers"),
    )


@query
def video_request_status(t: SampleTables) -> DataFrame:
    known = publish.expand_submissions(
        t.submissions().where(F.col("submitting_user") != "R"), AS_OF
    )[0]
    return reads.video_request_status(_deployments(t), known, None, "2002-01-01 00:00:00")


@query
def video_for_request(t: SampleTables) -> DataFrame:
    videos = t.videos().withColumn("video_uuid", F.concat(F.lit("video-"), "video_uuid"))
    return reads.attach_video(t.requests(), videos).select(
        "request_uuid", "video_uuid", F.col("video.video_id").alias("video_id"),
        F.col("video.source").alias("source"),
    )


@query
def inserted_offers(t: SampleTables) -> DataFrame:
    lines = t.outcomes().select("request_uuid", "ad_group_id", "offer_id", "status", "error_message")
    maps = lines.select(
        F.concat(F.lit("video-"), "ad_group_id").alias("video_uuid"),
        "request_uuid",
        F.lit(1).cast("long").alias("customer_id"),
        F.lit(1).cast("long").alias("campaign_id"),
        "ad_group_id",
        F.lit(None).cast("string").alias("error_message"),
        F.create_map(
            "offer_id",
            F.struct(
                F.lower("status").alias("status"),
                F.lit(None).cast("long").alias("cpc_bid_micros"),
                F.col("error_message"),
            ),
        ).alias("offers"),
    )
    return reads.inserted_offers(maps)


@query
def ads_entity_enrichment(t: SampleTables) -> DataFrame:
    return accounts.enrich_entities(t.entities(), t.ad_groups()).select(
        "request_uuid", "customer_id", "ad_group_id", "customer_name", "campaign_name", "ad_group_name"
    )


@query
def ad_groups_by_customer(t: SampleTables) -> DataFrame:
    return accounts.ad_groups_by_customer(t.entities())


@query
def previous_destinations(t: SampleTables) -> DataFrame:
    named = accounts.enrich_entities(t.entities(), t.ad_groups())
    failed = t.requests().withColumn(
        "status", F.when(F.col("status") == "PENDING", "FAILED").otherwise(F.col("status"))
    )
    return reads.previous_destinations(failed, named)


# --- accounts and intake --------------------------------------------------------------------------------


@query
def account_fanout(t: SampleTables) -> DataFrame:
    return accounts.target_accounts(t.accounts(), 1)


@query
def account_fanout_all(t: SampleTables) -> DataFrame:
    """The accounts that each account stands for, all at once."""
    return accounts.all_target_accounts(t.accounts())


@query
def sub_accounts(t: SampleTables) -> DataFrame:
    levels = accounts.descendants(t.accounts(), 1)
    return accounts.sub_accounts(levels, exclude_managers=False).withColumn(
        "level", F.col("level").cast("long")
    )


@query
def accessible_accounts(t: SampleTables) -> DataFrame:
    names = t.table("customer").select(
        F.concat(F.lit("customers/"), ((F.col("c_custkey") * 2) + 1000).cast("string")).alias("resource_name")
    )
    details = t.accounts().select("customer_id", "descriptive_name", "manager")
    return accounts.accessible_accounts(names, details, 1004)


@query
def account_search(t: SampleTables) -> DataFrame:
    return accounts.search_named(t.accounts(), "#00000001", "descriptive_name", "customer_id").select(
        "customer_id", "descriptive_name"
    )


@query
def campaigns_active(t: SampleTables) -> DataFrame:
    return accounts.active_campaigns(t.campaigns(), ["DEMAND_GEN"])


@query
def ads_video_scan(t: SampleTables) -> DataFrame:
    targets = accounts.target_accounts(t.accounts(), 1)
    ads = t.video_ads().select("customer_id", "campaign_id", "ad_group_id", "video_id")
    return intake.ads_videos(ads, t.campaigns(), targets)


@query
def account_video_counts(t: SampleTables) -> DataFrame:
    ads = t.video_ads().select("customer_id", "campaign_id", "ad_group_id", "video_id")
    return intake.account_video_counts(ads, t.campaigns(), t.accounts())


@query
def ad_groups_with_video(t: SampleTables) -> DataFrame:
    return accounts.ad_groups_with_video(t.video_ads(), "vid-7").select(
        "customer_id", "campaign_id", "ad_group_id", "video_id"
    )


@query
def destination_discovery(t: SampleTables) -> DataFrame:
    return accounts.discover_destinations(t.video_ads(), "vid-7")


@query
def scan_processed_videos(t: SampleTables) -> DataFrame:
    seen = t.processed().unionByName(t.file_candidates().select("video_id", "gcs_uri"))
    return intake.processed_keys(seen)


@query
def first_seen_dedupe(t: SampleTables) -> DataFrame:
    candidates = intake.union_sources(t.sheet_candidates(), t.file_candidates(), t.ads_candidates())
    return intake.first_seen(candidates).select(
        "source", "video_id", "gcs_uri", F.col("source_rank").cast("long").alias("source_rank"), "position"
    )


@query
def unprocessed_videos(t: SampleTables) -> DataFrame:
    candidates = intake.union_sources(t.sheet_candidates(), t.file_candidates(), t.ads_candidates())
    return intake.unprocessed(candidates, t.processed(), t.privacy_info(), limit=None).select(
        "source", "video_id", "gcs_uri", "title", "description", "position"
    )


@query
def limit_videos(t: SampleTables) -> DataFrame:
    candidates = intake.union_sources(t.sheet_candidates(), t.file_candidates(), t.ads_candidates())
    return intake.unprocessed(candidates, t.processed(), t.privacy_info()).select(
        "source", "video_id", "title", "position"
    )


# --- scalar functions and validation -----------------------------------------------------------------------


@query
def video_uuid(t: SampleTables) -> DataFrame:
    """Name-based keys of the files."""
    files = t.file_candidates()
    return files.select(
        "position", ids.video_uuid(F.col("video_id"), F.col("gcs_uri"), F.col("md5_hash")).alias("uuid")
    )


@query
def split_gcs_uri(t: SampleTables) -> DataFrame:
    parts = text.split_uri(F.col("gcs_uri"))
    return t.file_candidates().select(
        "position", "gcs_uri", parts.bucket.alias("bucket"), parts.path.alias("path")
    )


@query
def md5_base64_to_hex(t: SampleTables) -> DataFrame:
    encoded = F.base64(F.unhex(F.md5(F.encode("html", "UTF-8"))))
    return t.table("pages").select("page_id", ids.md5_hex(encoded).alias("md5"))


@query
def normalize_customer_id(t: SampleTables) -> DataFrame:
    return t.table("customer").select(
        "c_custkey",
        text.normalize_customer_id(F.col("c_custkey")).alias("from_number"),
        text.normalize_customer_id(
            F.concat_ws("-", F.substring("c_name", 10, 3), F.substring("c_name", 13, 6))
        ).alias("from_text"),
    )


@query
def brand_prefix(t: SampleTables) -> DataFrame:
    title = F.when(
        F.col("p_size") > 25, F.concat(F.upper("p_brand"), F.lit(" "), "p_name")
    ).otherwise(F.col("p_name"))
    brand = F.col("p_brand")
    return t.table("part").select(
        "p_partkey",
        text.brand_at_start(title, brand).alias("at_start"),
        text.brand_part(title, brand).alias("brand_part"),
        text.title_rest(title, brand).alias("title_rest"),
    )


@query
def video_title(t: SampleTables) -> DataFrame:
    uri = F.when(F.length("url") > 40, F.col("url"))
    video_id = F.when(F.length("html") > 5000, F.concat(F.lit("vid-"), F.col("page_id").cast("string")))
    title = F.when(F.contains("url", F.lit("/fr/")), F.lit("French page"))
    return t.table("pages").select(
        "page_id",
        text.video_title(title, uri, video_id, F.col("page_id").cast("string")).alias("title"),
    )


@query
def parse_strategy(t: SampleTables) -> DataFrame:
    raw = F.when(F.col("l_returnflag") == "N", "purge").when(F.col("l_returnflag") == "A", "other")
    return (
        t.table("lineitem")
        .select(text.parse_strategy(raw).alias("strategy"), "l_returnflag")
        .groupBy("strategy", "l_returnflag")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


@query
def join_error_messages(t: SampleTables) -> DataFrame:
    messages = F.array("l_returnflag", F.lit(""), "l_linestatus", "l_returnflag")
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        text.join_messages(messages).alias("message"),
    )


@query
def cpc_micros(t: SampleTables) -> DataFrame:
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        numbers.cpc_micros(F.col("l_discount")).alias("cpc_micros"),
    )


@query
def video_ms(t: SampleTables) -> DataFrame:
    stamp = F.format_string("%02d:%02d:%06.3f", F.col("p_size"), F.lit(7), F.col("p_retailprice") / 100)
    return t.table("part").select("p_partkey", numbers.duration_ms(stamp).alias("ms"))


@query
def valid_video(t: SampleTables) -> DataFrame:
    rows = intake.union_sources(t.sheet_candidates(), t.file_candidates(), t.ads_candidates()).withColumn(
        "md5_hash", F.when(F.length("gcs_uri") > 40, F.col("md5_hash"))
    )
    return validate.with_reason(rows, validate.video_rules()).select(
        "video_id", "gcs_uri", "reject_reason"
    )


@query
def typed_rules(t: SampleTables) -> DataFrame:
    rows = t.candidates().select(
        "video_uuid", "identified_product_uuid", "offer_id",
        (F.col("distance") - 0.001).alias("distance"),
        F.when(F.col("is_added_by_user"), "MAYBE")
        .otherwise(F.col("candidate_status"))
        .alias("candidate_status"),
    )
    _, rejected = validate.validate_candidates(rows)
    return rejected.select("video_uuid", "identified_product_uuid", "offer_id", "reject_reason")


@query
def valid_deployment(t: SampleTables) -> DataFrame:
    _, rejected = validate.validate_deployments(_deployments(t))
    return rejected.select("request_uuid", "ad_group_id", "campaign_id", "reject_reason")


@query
def to_json_rows(t: SampleTables) -> DataFrame:
    """Customers as JSON, read back field by field."""
    rows = reads.as_json(t.table("customer").select("c_custkey", "c_name", "c_mktsegment"))
    back = F.from_json("json", "c_custkey bigint, c_name string, c_mktsegment string")
    return rows.select(back.alias("r")).select("r.*")


# --- single operators that the queries above use only inside --------------------------------------------


@query
def filter_success(t: SampleTables) -> DataFrame:
    return matching.successful(t.video_analysis()).select("uuid", "status", "timestamp")


@query
def flatten_metadata(t: SampleTables) -> DataFrame:
    return analysis.flatten_metadata(t.video_analysis()).select(
        "uuid", "title", "description",
        nested.identified_count(F.col("identified_products")).alias("identified"),
    )


@query
def unnest_identified(t: SampleTables) -> DataFrame:
    return matching.explode_identified(t.video_analysis()).select("video_uuid", "uuid", "title")


@query
def drop_stub_videos(t: SampleTables) -> DataFrame:
    videos = t.videos().select(
        "video_uuid",
        F.when(F.col("status") == "Needs Review", F.col("source")).otherwise(F.lit("")).alias("source"),
        F.when(F.col("status") != "Ready to Push", F.col("video_id")).alias("video_id"),
    )
    return reads.presentable_videos(videos)


@query
def summary_status_filter(t: SampleTables) -> DataFrame:
    return reads.with_status(t.videos(), "Push Complete").select("video_uuid", "status")


@query
def affected_videos(t: SampleTables) -> DataFrame:
    log, videos = t.matched_products(), t.video_analysis()
    return sync.touched(sync.match_totals(log, videos), sync.match_delta(log, videos, SPLIT))


@query
def distinct_offers(t: SampleTables) -> DataFrame:
    return sync.matched_offers(t.matched_products())


@query
def offer_in_list(t: SampleTables) -> DataFrame:
    active = sync.matched_offers(t.matched_products())
    return sync.restrict_offers(t.product_feed(), active).select("offer_id", "data_date", *LISTING_TIES)


@query
def candidates_to_identified(t: SampleTables) -> DataFrame:
    rows = reads.attach_candidates(
        analysis.identified_rows(t.video_analysis()), t.candidates().select(
            "video_uuid", "identified_product_uuid", "offer_id", "candidate_status"
        )
    )
    return rows.select(
        "video_uuid", "idp_uuid", "title", "video_timestamp", "matched_offer_id", "matched_candidate_status"
    )


@query
def knn_rank(t: SampleTables) -> DataFrame:
    """The three nearest rows of the log per identified product."""
    rows = t.matched_products().select("uuid", "matched_product_offer_id", "timestamp", "distance")
    best = ranking.top_k(rows, ["uuid"], ["distance", "timestamp"], 3, rank="rank")
    return best.select(
        "uuid", "matched_product_offer_id", "timestamp", _round("distance").alias("distance"),
        F.col("rank").cast("long").alias("rank"),
    )


@query
def request_detail(t: SampleTables) -> DataFrame:
    entities = t.entities().withColumn("offers", F.lit(None).cast(nested.OFFERS_MAP))
    videos = t.videos().withColumn("video_uuid", F.concat(F.lit("video-"), "video_uuid"))
    return reads.request_detail(t.requests(), entities, videos, "7").select(
        "request_uuid", "video_uuid", "status", F.col("video.video_id").alias("video_id"), "ad_group_id"
    )


@query
def entity_defaults(t: SampleTables) -> DataFrame:
    entities = t.entities().withColumn("offers", F.lit(None).cast(nested.OFFERS_MAP)).withColumn(
        "customer_id", F.when(F.col("customer_id") > 10, F.col("customer_id"))
    )
    return reads.entity_defaults(entities).select(
        "request_uuid", "customer_id", "campaign_id", "ad_group_id", F.size("offers").cast("long").alias("offers")
    )


@query
def ad_groups_active(t: SampleTables) -> DataFrame:
    groups = t.table("lineitem").select(
        F.col("l_suppkey").alias("ad_group_id"),
        F.col("l_orderkey").alias("campaign_id"),
        F.when(F.col("l_returnflag") == "R", "REMOVED").otherwise("ENABLED").alias("status"),
    )
    return accounts.active_ad_groups(groups, 7)


@query
def exclude_managers(t: SampleTables) -> DataFrame:
    levels = accounts.descendants(t.accounts(), 1)
    return accounts.sub_accounts(levels, exclude_managers=True).select("customer_id", "manager")


@query
def public_only(t: SampleTables) -> DataFrame:
    rows = t.sheet_candidates().unionByName(t.file_candidates()).unionByName(t.ads_candidates())
    return intake.public_only(rows, t.privacy_info()).select(
        "source", "video_id", "gcs_uri", "title", "description", "position"
    )


@query
def video_sources_union(t: SampleTables) -> DataFrame:
    rows = intake.union_sources(t.sheet_candidates(), t.file_candidates(), t.ads_candidates())
    return rows.groupBy("source", "source_rank").agg(F.count(F.lit(1)).alias("videos")).withColumn(
        "source_rank", F.col("source_rank").cast("long")
    )


@query
def valid_product(t: SampleTables) -> DataFrame:
    feed = catalog.rename_category(t.product_feed()).withColumn(
        "description", F.when(F.col("channel") == "ONLINE", F.col("description"))
    )
    _, rejected = validate.validate_products(feed)
    return rejected.select("offer_id", "reject_reason", *LISTING_TIES)


@query
def valid_numbers(t: SampleTables) -> DataFrame:
    _, rejected = validate.validate(t.table("supplier"), validate.non_negative("s_acctbal"))
    return rejected.select("s_suppkey", "s_acctbal", "reject_reason")


@query
def euclidean_distance(t: SampleTables) -> DataFrame:
    v = F.col("embedding")
    return t.product_embeddings().select(
        "id", _round(vectors.l2_distance(v, F.reverse(v))).alias("distance")
    )


@query
def search_tokens(t: SampleTables) -> DataFrame:
    words = t.table("documents").select(
        "doc_id", F.posexplode_outer(text.search_tokens(F.col("text"))).alias("pos", "token")
    )
    return words.where(F.col("pos").isNotNull()).withColumn("pos", F.col("pos").cast("long"))


@query
def split_offer_ids(t: SampleTables) -> DataFrame:
    ids_text = F.concat_ws(",", F.lit(" x"), "url", F.lit(""), F.lit("\ta "))
    return t.table("pages").select(
        "page_id",
        F.size(text.split_ids(ids_text)).cast("long").alias("with_blank"),
        text.sorted_ids(text.split_ids(ids_text, keep_blank=False)).alias("sorted"),
    )


@query
def key_prefixes(t: SampleTables) -> DataFrame:
    key = text.doc_key("prod_", F.col("p_partkey"))
    return t.table("part").select(
        key.alias("key"), text.strip_key("prod_", key).alias("offer_id"),
        text.strip_key("offer_", key).alias("other"),
    )


# --- functions that other queries use only inside, over whole tables ------------------------------------


@query
def idp_uuid(t: SampleTables) -> DataFrame:
    """Stable keys of the products in the answers."""
    rows = analysis.parse_identified(t.raw_answers())
    return rows.select("video_uuid", F.col("pos").cast("long").alias("pos"), "uuid")


def _order_pushes() -> Column:
    """Pushes under way as a map; urgent orders have none yet."""
    stamp = F.col("o_orderdate").cast("timestamp")
    return F.when(F.col("o_orderpriority") != "1-URGENT", F.create_map("o_orderstatus", stamp))


def _pushes(t: SampleTables, pushes: Column) -> DataFrame:
    return t.table("orders").select("o_orderkey", F.explode(pushes).alias("request", "started"))


@query
def active_push_add(t: SampleTables) -> DataFrame:
    return _pushes(t, nested.add_push(_order_pushes(), F.lit("F"), F.lit(AS_OF).cast("timestamp")))


@query
def active_push_remove(t: SampleTables) -> DataFrame:
    return _pushes(t, nested.drop_push(_order_pushes(), F.lit("F")))


@query
def epoch_default(t: SampleTables) -> DataFrame:
    """As text: the year 1 does not fit every client."""
    mark = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp"))
    return t.table("orders").select("o_orderkey", numbers.mark_or_epoch(mark).cast("string").alias("mark"))


@query
def utc_seconds(t: SampleTables) -> DataFrame:
    """The present in whole seconds, as truth values against a stored time."""
    now = numbers.now_seconds()
    return t.table("orders").select(
        "o_orderkey",
        (now > F.col("o_orderdate").cast("timestamp")).alias("is_later"),
        (now == F.date_trunc("second", now)).alias("is_whole"),
    )


@query
def init_counter(t: SampleTables) -> DataFrame:
    return t.videos().select(
        "video_uuid",
        numbers.init_counter(F.col("stats_matched_count")).alias("matched"),
        numbers.init_counter(F.col("stats_identified_count")).alias("identified"),
    )


@query
def exclude_embedding(t: SampleTables) -> DataFrame:
    """Identified products with all their fields but the vector."""
    product = F.explode("identified_products").alias("p")
    return t.video_analysis().select(F.col("uuid").alias("video_uuid"), product).select(
        "video_uuid", nested.without_embedding(F.col("p")).alias("p")
    ).select("video_uuid", "p.*")


@query
def project_except_rn(t: SampleTables) -> DataFrame:
    rows = t.matched_products().select("uuid", "matched_product_offer_id", "timestamp", "distance")
    best = ranking.top_k(rows, ["uuid"], ["distance", "timestamp"], 1, rank="rn")
    return ranking.drop_rank(best).withColumn("distance", _round("distance"))


@query
def unique_videos(t: SampleTables) -> DataFrame:
    """Different videos over all accounts."""
    return intake.unique_videos(t.video_ads(), t.campaigns(), t.accounts())


# --- what jobs write, read back ---------------------------------------------------------------------------


def _parts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    late = F.col("timestamp") > F.lit(SPLIT).cast("timestamp")
    return df.where(~late), df.where(late)


@query
def append_embedding(t: SampleTables) -> DataFrame:
    path = new_folder(t.spark)
    tables.append_embeddings(t.product_embeddings(), path)
    rows = tables.read_table(t.spark, path, PRODUCT_EMBEDDINGS)
    return rows.select("id", "embedding_model_id", _round(vectors.l2_norm(F.col("embedding"))).alias("norm"))


@query
def append_analysis(t: SampleTables) -> DataFrame:
    path = new_folder(t.spark)
    tables.append_analysis(t.video_analysis(), path)
    rows = t.spark.read.parquet(path)
    return rows.select(
        "uuid", "status", "timestamp", F.size("identified_products").cast("long").alias("identified")
    )


@query
def append_matches(t: SampleTables) -> DataFrame:
    """Two appends; the table holds both."""
    path = new_folder(t.spark)
    for part in _parts(t.matched_products()):
        tables.append_matches(part, path)
    return tables.read_table(t.spark, path, MATCHED_PRODUCTS).select(
        "timestamp", "uuid", "matched_product_offer_id", _round("distance").alias("distance")
    )


def _matches_synced_twice(t: SampleTables) -> jobs.Targets:
    """Up to the split, then the rest."""
    targets, log = jobs.Targets(new_folder(t.spark)), t.matched_products()
    jobs.sync_matches(_parts(log)[0], t.video_analysis(), targets)
    jobs.sync_matches(log, t.video_analysis(), targets)
    return targets


@query
def sync_matches_written(t: SampleTables) -> DataFrame:
    """Candidates after two runs: a pair has the distance of the run that found it."""
    return _matches_synced_twice(t).candidates(t.spark).select(
        "video_uuid", "identified_product_uuid", "offer_id", _round("distance").alias("distance")
    )


def _counted_twice(t: SampleTables) -> tuple[jobs.Targets, MatchCounts]:
    """Up to the split, then the rest, each run reading its own rows alone."""
    targets, log = jobs.Targets(new_folder(t.spark)), t.matched_products()
    counts = MatchCounts(new_folder(t.spark), parts=16)
    jobs.sync_matches_by_delta(_parts(log)[0], t.video_analysis(), targets, counts)
    jobs.sync_matches_by_delta(log, t.video_analysis(), targets, counts)
    return targets, counts


@query
def sync_matches_by_delta(t: SampleTables) -> DataFrame:
    """Candidates after two runs that read the rows after the mark alone."""
    return _counted_twice(t)[0].candidates(t.spark).select(
        "video_uuid", "identified_product_uuid", "offer_id", _round("distance").alias("distance")
    )


@query
def video_match_totals_merged(t: SampleTables) -> DataFrame:
    """Totals from the bitmaps of two runs."""
    return _counted_twice(t)[1].totals(t.video_analysis())


@query
def sync_matches_state(t: SampleTables) -> DataFrame:
    """Totals that the stream with keyed state leaves after three batches of matches."""
    folder, targets = new_folder(t.spark), jobs.Targets(new_folder(t.spark))
    t.video_analysis().write.parquet(f"{folder}/analyses")
    log, checkpoint = t.matched_products(), new_folder(t.spark)
    for third in range(3):
        log.where(F.pmod(F.xxhash64("uuid", "timestamp"), F.lit(3)) == third).write.mode("append").parquet(f"{folder}/matches")
        stream_match_state(
            analysis_stream(t.spark, f"{folder}/analyses"), match_stream(t.spark, f"{folder}/matches"), targets, checkpoint, 2, 8
        ).awaitTermination()
    return match_totals(t.spark, targets, 8)


@query
def watermark_state(t: SampleTables) -> DataFrame:
    """The marks that the two runs leave."""
    state = tables.read_table(t.spark, _matches_synced_twice(t).state, SYNC_STATE)
    return state.select("component", "last_sync_timestamp", "batch_id")


@query
def sync_videos(t: SampleTables) -> DataFrame:
    """Videos after two runs of the job, the second over all analyses."""
    targets, rows = jobs.Targets(new_folder(t.spark)), t.video_analysis()
    jobs.sync_videos(rows.where(F.col("status") == "FAILED"), targets)
    jobs.sync_videos(rows, targets)
    return targets.videos(t.spark).select(
        "video_uuid", "video_id", "title", "stats_identified_count", "stats_matched_count"
    )


@query
def scan_sheet_ids(t: SampleTables) -> DataFrame:
    """Ids written as a sheet export with an empty cell per page, read back."""
    path = new_folder(t.spark)
    ids_of = F.explode(F.array("video_id", F.lit(""))).alias("video_id")
    t.sheet_candidates().select(ids_of, F.col("position").alias("page")).write.option("header", True).csv(path)
    return files.read_id_list(t.spark, path)


@query
def scan_video_files(t: SampleTables) -> DataFrame:
    """Pages as the listing of a bucket: long ones are videos, the others are not."""
    ending = F.when(F.length("html") > 5000, ".MP4").when(F.length("html") > 2000, ".mov").otherwise(".txt")
    listing = t.table("pages").select(
        F.concat(F.regexp_replace("url", "^https?://", "gs://"), ending).alias("path"),
        F.base64(F.unhex(F.md5(F.encode("html", "UTF-8")))).alias("md5_base64"),
    )
    return files.videos_of_manifest(listing).select("source", "gcs_uri", "md5_hash", "title")
