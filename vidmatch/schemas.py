"""Declared schemas of the canonical tables."""

from __future__ import annotations

from pyspark.sql import types as T

STR, BOOL, INT, LONG, DOUBLE = (
    T.StringType(),
    T.BooleanType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
)
DATE, TIME = T.DateType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def array(item: T.DataType) -> T.ArrayType:
    return T.ArrayType(item)


PRODUCT_FEED = struct(
    data_date=DATE,
    offer_id=STR,
    title=STR,
    brand=STR,
    description=STR,
    product_type=STR,
    google_product_category_path=STR,
    age_group=STR,
    color=STR,
    gender=STR,
    material=STR,
    pattern=STR,
    image_link=STR,
    additional_image_links=array(STR),
    channel=STR,
    content_language=STR,
    availability=STR,
    price=struct(value=T.DecimalType(18, 4)),
)

PRODUCT_EMBEDDINGS = struct(
    id=STR, insertion_timestamp=TIME, embedding=array(DOUBLE), embedding_model_id=STR
)

# What the model answers: durations are still text, vectors and keys are missing.
MODEL_ANSWER = array(
    struct(
        title=STR,
        description=STR,
        color_pattern_style_usage=STR,
        category=STR,
        subcategory=STR,
        video_timestamp=STR,
        relevance_reasoning=STR,
    )
)

VIDEO_ANALYSIS = struct(
    uuid=STR,
    timestamp=TIME,
    source=STR,
    video_id=STR,
    metadata=struct(title=STR, description=STR),
    gcs_uri=STR,
    md5_hash=STR,
    status=STR,
    error_message=STR,
    embedding_model_id=STR,
    generative_model_id=STR,
    identified_products=array(
        struct(
            title=STR,
            description=STR,
            color_pattern_style_usage=STR,
            category=STR,
            subcategory=STR,
            video_timestamp=LONG,
            relevance_reasoning=STR,
            embedding=array(DOUBLE),
            uuid=STR,
        )
    ),
)

MATCHED_PRODUCTS = struct(
    timestamp=TIME,
    uuid=STR,
    identified_product_title=STR,
    identified_product_description=STR,
    matched_product_offer_id=STR,
    matched_product_title=STR,
    matched_product_brand=STR,
    distance=DOUBLE,
)

VIDEO_CANDIDATES = struct(
    source=STR,
    video_id=STR,
    gcs_uri=STR,
    md5_hash=STR,
    title=STR,
    description=STR,
    source_rank=INT,
    position=LONG,
)

VIDEOS = struct(
    video_uuid=STR,
    video_id=STR,
    source=STR,
    gcs_uri=STR,
    md5_hash=STR,
    timestamp=TIME,
    title=STR,
    description=STR,
    search_keywords=array(STR),
    stats_identified_count=LONG,
    stats_matched_count=LONG,
    stats_approved_count=LONG,
    status=STR,
    active_pushes=T.MapType(STR, TIME),
    has_successful_push=BOOL,
)

IDENTIFIED_PRODUCTS = struct(
    video_uuid=STR,
    idp_uuid=STR,
    title=STR,
    description=STR,
    relevance_reasoning=STR,
    video_timestamp=LONG,
)

CANDIDATES = struct(
    video_uuid=STR,
    identified_product_uuid=STR,
    offer_id=STR,
    distance=DOUBLE,
    candidate_status=STR,
    user=STR,
    is_added_by_user=BOOL,
    modified_timestamp=TIME,
)

INVENTORY = struct(
    offer_id=STR, title=STR, brand=STR, image_link=STR, availability=STR, price=DOUBLE
)

ADS_INSERTIONS = struct(
    request_uuid=STR,
    video_uuid=STR,
    submitting_user=STR,
    status=STR,
    offer_ids=array(STR),
    timestamp=TIME,
    leased_at=TIME,
    worker_id=STR,
    error_message=STR,
    completed_at=TIME,
    failed_at=TIME,
)

DEPLOYMENTS = struct(
    request_uuid=STR,
    video_uuid=STR,
    customer_id=LONG,
    campaign_id=LONG,
    ad_group_id=LONG,
    strategy=STR,
    error_message=STR,
    offers=T.MapType(STR, struct(status=STR, cpc_bid_micros=LONG, error_message=STR)),
)

LISTING_GROUPS = struct(
    ad_group_id=LONG,
    resource_name=STR,
    type=STR,
    parent=STR,
    case_dimension=STR,
    product_item_id=STR,
    negative=BOOL,
)

SUBMISSIONS = struct(
    request_uuid=STR,
    video_uuid=STR,
    offer_ids=STR,
    destinations=array(struct(customer_id=LONG, campaign_id=LONG, ad_group_id=LONG)),
    submitting_user=STR,
    cpc=DOUBLE,
)

SYNC_STATE = struct(component=STR, last_sync_timestamp=TIME, batch_id=LONG)

# Video sources and the campaign type whose videos are read.
SOURCES = ["google_ads", "gcs", "manual_entry"]
DEFAULT_SOURCE = "youtube"
CHANNEL_TYPE = "DEMAND_GEN"

# File endings of videos.
VIDEO_EXTENSIONS = [".mp4", ".mov", ".avi", ".mkv", ".webm", ".flv", ".wmv"]
