"""Submissions, listing-group changes per ad group, outcomes and roll-ups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmatch.functions.ids import uuid5
from vidmatch.functions.nested import (
    OFFERS_MAP,
    empty_offers,
    empty_pushes,
    offers_map,
)
from vidmatch.functions.numbers import as_column, cpc_micros, cutoff
from vidmatch.functions.status import (
    PUSH_IN_PROGRESS,
    counts_as_push,
    request_status,
    video_status,
)
from vidmatch.functions.text import (
    CORRUPT_DEPLOYMENT,
    DEFAULT_OFFER_ERROR,
    blank_to_null,
    failure_message,
    is_blank,
    parse_strategy,
    split_ids,
)
from vidmatch.operators.joins import skew_join, spread_join
from vidmatch.operators.merge import upsert
from vidmatch.operators.validate import deployment_rules, with_reason
from vidmatch.session import cut_lineage

# Operations allowed per ad group, leases and batch size of a worker.
MAX_OPERATIONS = 10_000
LEASE_HOURS = 2
BATCH = 5

ITEM_DIMENSION = "product_item_id"
# Error codes of groups that are not published.
OVERFLOW = "OPERATION_LIMIT"
NOT_ITEM_TREE = "TREE_NOT_BY_ITEM"

As_of = Column | dt.datetime | str


# --- submissions -----------------------------------------------------------------------


def expand_submissions(
    submissions: DataFrame, as_of: As_of
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests, deployments, video patches) of a batch of submissions.

    A submission without a request id gets a name-based one. Of several
    destinations with one ad group the last stays. Nothing is shuffled.
    """
    stamp = as_column(as_of)
    name = F.to_json(F.struct("video_uuid", "offer_ids", "destinations", "submitting_user", stamp))
    base = submissions.select(
        F.coalesce(blank_to_null(F.col("request_uuid")), uuid5(name)).alias("request_uuid"),
        "video_uuid",
        "submitting_user",
        split_ids(F.col("offer_ids")).alias("offer_ids"),
        "destinations",
        offers_map(split_ids(F.col("offer_ids")), cpc_micros(F.col("cpc"))).alias("offers"),
        stamp.alias("timestamp"),
    )
    requests = base.select(
        "request_uuid",
        "video_uuid",
        "submitting_user",
        F.lit("PENDING").alias("status"),
        "offer_ids",
        "timestamp",
    )
    last = F.filter(
        "destinations",
        lambda d, i: ~F.exists(
            F.slice(F.col("destinations"), i + 2, F.size("destinations")),
            lambda later: later.ad_group_id.eqNullSafe(d.ad_group_id),
        ),
    )
    # Outer, with the test behind it: a plain explode would have the optimizer repeat
    # the whole array expression in a filter before it.
    deployments = (
        base.withColumn("d", F.explode_outer(last))
        .where(F.col("d").isNotNull())
        .select(
            "request_uuid",
            "video_uuid",
            F.col("d.customer_id").alias("customer_id"),
            F.col("d.campaign_id").alias("campaign_id"),
            F.col("d.ad_group_id").alias("ad_group_id"),
            F.lit(None).cast("string").alias("strategy"),
            "offers",
        )
    )
    patches = base.select(
        "video_uuid", "request_uuid", F.col("timestamp").alias("active_since"),
        F.lit(PUSH_IN_PROGRESS).alias("status"),
    )
    return requests, deployments, patches


def push_rows(videos: DataFrame) -> DataFrame:
    """The maps of active pushes as rows (video, request, since)."""
    return videos.select(
        "video_uuid", F.explode("active_pushes").alias("request_uuid", "active_since")
    )


def start_pushes(
    videos: DataFrame, pushes: DataFrame, patches: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(videos, pushes) after new submissions; those of unknown videos are ignored.

    Running pushes are kept as rows: a video may have any number of them.
    """
    known = patches.join(videos.select("video_uuid"), "video_uuid", "left_semi")
    status = known.select("video_uuid", "status").distinct()
    added = known.select("video_uuid", "request_uuid", "active_since")
    keys = ["video_uuid", "request_uuid"]
    return (
        upsert(videos, status, ["video_uuid"], ["status"]),
        upsert(pushes, added, keys, ["active_since"]),
    )


# --- work selection ------------------------------------------------------------------------


def lease_eligible(requests: DataFrame, as_of: As_of, stale_hours: int = LEASE_HOURS) -> DataFrame:
    """Pending requests, and running ones whose lease is older than the cutoff."""
    stale = (F.col("status") == "PROCESSING") & (F.col("leased_at") < cutoff(as_of, stale_hours))
    return requests.where((F.col("status") == "PENDING") | stale)


def work_batch(
    requests: DataFrame, as_of: As_of, stale_hours: int = LEASE_HOURS, n: int = BATCH
) -> DataFrame:
    """Next requests: stale ones first (``stage`` 0), then pending, oldest first."""
    stale = requests.where(
        (F.col("status") == "PROCESSING") & (F.col("leased_at") < cutoff(as_of, stale_hours))
    )
    pending = requests.where(
        (F.col("status") == "PENDING") & F.col("timestamp").isNotNull()
    )
    return (
        stale.orderBy("leased_at", "request_uuid")
        .limit(n)
        .withColumn("stage", F.lit(0))
        .unionByName(
            pending.orderBy("timestamp", "request_uuid").limit(n).withColumn("stage", F.lit(1))
        )
    )


# --- listing groups ---------------------------------------------------------------------


def _is_root() -> Column:
    return is_blank(F.col("parent"))


def tree_roots(listing_groups: DataFrame) -> DataFrame:
    """Every ad group that has nodes, with its root node (NULL if it has none)."""
    root = F.max(F.when(_is_root(), F.struct("resource_name", "type")))
    return (
        listing_groups.groupBy("ad_group_id")
        .agg(root.alias("root"))
        .select(
            "ad_group_id",
            F.col("root.resource_name").alias("root_name"),
            F.col("root.type").alias("root_type"),
        )
    )


def tree_children(listing_groups: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Direct children of each root."""
    roots = (tree_roots(listing_groups) if roots is None else roots).select(
        "ad_group_id", F.col("root_name").alias("parent"), "root_type"
    )
    nodes = listing_groups.where(~_is_root())
    return spread_join(nodes, roots, ["ad_group_id", "parent"], spread=["resource_name"])


def tree_state(listing_groups: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """CLEAN, PARTITIONED or DIRTY per ad group, with its root.

    Children are reduced to one flag per parent before they meet the roots.
    """
    parents = (
        listing_groups.where(~_is_root())
        .groupBy("ad_group_id", F.col("parent").alias("root_name"))
        .agg(F.bool_or(F.col("case_dimension") == ITEM_DIMENSION).alias("by_item"))
    )
    roots = tree_roots(listing_groups) if roots is None else roots
    rooted = roots.join(parents, ["ad_group_id", "root_name"], "left")
    kind = F.col("root_type")
    state = (
        F.when(F.col("root_name").isNull() | (kind == "UNIT"), "CLEAN")
        .when((kind == "SUBDIVISION") & F.col("by_item"), "PARTITIONED")
        .otherwise("DIRTY")
    )
    return rooted.select("ad_group_id", "root_name", state.alias("state"))


def existing_items(listing_groups: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Distinct items that already are children of a root."""
    return (
        tree_children(listing_groups, roots)
        .where((F.col("case_dimension") == ITEM_DIMENSION) & ~is_blank(F.col("product_item_id")))
        .select("ad_group_id", F.col("product_item_id").alias("offer_id"))
        .distinct()
    )


def flag_existing(targets: DataFrame, listing_groups: DataFrame) -> DataFrame:
    """Targets with ``is_present``: already a child of the ad group's root."""
    items = existing_items(listing_groups).withColumn("is_present", F.lit(True))
    return skew_join(
        targets, items, ["ad_group_id", "offer_id"], "left", spread=["position"]
    ).withColumn("is_present", F.coalesce("is_present", F.lit(False)))


def planned(targets: DataFrame, listing_groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``plan_offers`` and ``plan_groups``, each derived once and written.

    Roots, offers and groups are needed in several places; as written tables they are
    read there instead of being derived from targets and nodes again.
    """
    roots = cut_lineage(tree_roots(listing_groups))
    offers = cut_lineage(plan_offers(targets, listing_groups, roots))
    return offers, cut_lineage(plan_groups(offers, listing_groups, roots))


def plan_offers(targets: DataFrame, listing_groups: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Distinct offers per ad group: first position, copies, already there or not.

    An aggregate instead of a window over the targets: reduced before the shuffle,
    however often an offer is repeated.
    """
    firsts = targets.groupBy("ad_group_id", F.coalesce("offer_id", F.lit("")).alias("offer_id")).agg(
        F.min("position").alias("first_position"),
        F.count(F.lit(1)).alias("copies"),
        # A flag, not the text: flags and numbers aggregate by hash, texts by sorting.
        F.bool_or(parse_strategy(F.col("strategy")) == "PURGE").alias("purge"),
    )
    items = existing_items(listing_groups, roots).withColumn("_there", F.lit(True))
    return firsts.join(items, ["ad_group_id", "offer_id"], "left").select(
        "ad_group_id",
        "offer_id",
        "first_position",
        "copies",
        "purge",
        F.coalesce("_there", F.lit(False)).alias("is_present"),
    )


def plan_groups(offers: DataFrame, listing_groups: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """State, ``mode`` and number of operations per ad group with targets.

    REBUILD on purge or where nothing is there yet, APPEND to a tree by item, and
    ERROR where another tree would have to be preserved. A rebuild takes two or
    three operations besides its units: new root, catch-all, removal of the old root.
    """
    given = F.col("offer_id") != ""
    counts = offers.groupBy("ad_group_id").agg(
        F.bool_or("purge").alias("purge"),
        F.count_if(given).alias("_all"),
        F.count_if(given & ~F.col("is_present")).alias("_new"),
    )
    state = F.coalesce("state", F.lit("CLEAN"))
    mode = (
        F.when(F.col("purge") | (state == "CLEAN"), "REBUILD")
        .when(state == "PARTITIONED", "APPEND")
        .otherwise("ERROR")
    )
    extra = F.lit(2) + F.col("root_name").isNotNull().cast("int")
    op_count = (
        F.when(mode == "REBUILD", F.col("_all") + extra)
        .when(mode == "APPEND", F.col("_new"))
        .otherwise(F.lit(0))
    )
    return (
        counts.join(tree_state(listing_groups, roots), "ad_group_id", "left")
        .select(
            "ad_group_id", state.alias("state"), "root_name", mode.alias("mode"),
            op_count.cast("long").alias("op_count"),
        )
    )


def _adds() -> Column:
    """Whether the first copy of an offer becomes an operation."""
    return (
        (F.col("offer_id") != "")
        & (F.col("mode") != "ERROR")
        & ~((F.col("mode") == "APPEND") & F.col("is_present"))
    )


def plan_targets(
    targets: DataFrame, listing_groups: DataFrame, failures: DataFrame | None = None
) -> DataFrame:
    """Targets with everything the change of their ad group depends on.

    ``action`` is SKIP (blank id), PRESENT (repeated or existing id) or ADD;
    ``op_count`` the operations of the whole ad group, ``call_error`` the error of
    its remote call.
    """
    offers, groups = planned(targets, listing_groups)
    if failures is None:
        groups = groups.withColumn("call_error", F.lit(None).cast("string"))
    else:
        calls = failures.groupBy("ad_group_id").agg(F.max("error_message").alias("call_error"))
        groups = groups.join(calls, "ad_group_id", "left")
    rows = targets.drop("strategy").withColumn("offer_id", F.coalesce("offer_id", F.lit("")))
    # How many targets a key has is known from the plan.
    copies = offers.select("ad_group_id", "offer_id", F.col("copies").alias("_rows"))
    in_group = offers.groupBy("ad_group_id").agg(F.sum("copies").alias("_rows"))
    joined = skew_join(
        skew_join(rows, offers.drop("purge"), ["ad_group_id", "offer_id"], spread=["position"], counts=copies),
        groups,
        ["ad_group_id"],
        spread=["offer_id", "position"],
        counts=in_group,
    )
    action = (
        F.when(F.col("offer_id") == "", "SKIP")
        .when((F.col("position") == F.col("first_position")) & _adds(), "ADD")
        .otherwise("PRESENT")
    )
    return joined.withColumn("action", action).drop("first_position", "is_present")


def listing_ops(targets: DataFrame, listing_groups: DataFrame) -> DataFrame:
    """Operations per ad group, in ``step`` order.

    A rebuild removes the old root, creates a root and a negative catch-all, then
    one unit per offer; an append creates the missing units only.
    """
    offers, groups = planned(targets, listing_groups)
    units = skew_join(offers, groups, ["ad_group_id"], spread=["offer_id"]).where(_adds())
    none = F.lit(None).cast("string")
    # Fixed value: the temporary id of a root that is created in the same request.
    temp_root = F.concat(F.col("ad_group_id").cast("string"), F.lit("~-1"))

    def op(step: int, kind: str, name: Column, parent: Column, negative: bool) -> Column:
        return F.struct(
            F.lit(step).alias("step"),
            F.lit(kind).alias("op"),
            name.alias("resource_name"),
            parent.alias("parent"),
            F.lit(negative).alias("negative"),
        )

    heads = F.array(
        op(0, "REMOVE_ROOT", F.col("root_name"), none, False),
        op(1, "CREATE_ROOT", temp_root, none, False),
        op(2, "CREATE_OTHER", none, temp_root, True),
    )
    parent = F.when(F.col("mode") == "REBUILD", temp_root).otherwise(F.col("root_name"))
    unit = op(3, "CREATE_UNIT", none, parent, False)
    columns = ["ad_group_id", "o.step", "o.op", "o.resource_name", "o.parent", "offer_id", "o.negative"]
    return (
        groups.where(F.col("mode") == "REBUILD")
        .withColumn("o", F.explode(heads))
        .where((F.col("o.step") > 0) | F.col("root_name").isNotNull())
        .withColumn("offer_id", none)
        .select(*columns)
        .unionByName(units.withColumn("o", unit).select(*columns))
    )


def guard_ops(ops: DataFrame, limit: int = MAX_OPERATIONS) -> DataFrame:
    """Operations per ad group, and whether they exceed the limit."""
    return ops.groupBy("ad_group_id").agg(
        F.count(F.lit(1)).alias("op_count"), (F.count(F.lit(1)) > limit).alias("overflow")
    )


def offer_outcomes(
    targets: DataFrame,
    listing_groups: DataFrame,
    failures: DataFrame | None = None,
    limit: int = MAX_OPERATIONS,
) -> DataFrame:
    """Result per target: SUCCESS, ALREADY_PRESENT or FAILED.

    ``failures`` are errors of the remote call per ad group. If an ad group fails,
    what was already found present stays so, and a repeated id gets no second
    result; if its tree cannot be preserved, every target fails.
    """
    planned = plan_targets(targets, listing_groups, failures)
    called = F.col("op_count") > 0
    error = (
        F.when(F.col("mode") == "ERROR", F.lit(NOT_ITEM_TREE))
        .when(F.col("op_count") > limit, F.lit(OVERFLOW))
        .when(called, F.col("call_error"))
    )
    rows = planned.withColumn("group_error", error)
    failed = F.col("group_error").isNotNull()
    whole = F.col("mode") == "ERROR"
    # After a failed call: the first copy of a repeated id is covered by the second.
    covered = failed & ~whole & (F.col("action") == "ADD") & (F.col("copies") > 1)
    skipped = ~failed & (F.col("action") == "SKIP")
    status = (
        F.when(whole, "FAILED")
        .when(F.col("action") == "PRESENT", "ALREADY_PRESENT")
        .when(failed, "FAILED")
        .otherwise("SUCCESS")
    )
    return rows.where(~covered & ~skipped).select(
        "ad_group_id",
        "offer_id",
        "position",
        status.alias("status"),
        F.when(status == "FAILED", F.col("group_error")).alias("error_message"),
    )


def fail_unhandled(targets: DataFrame, handled: DataFrame) -> DataFrame:
    """FAILED rows for the targets that have no result yet."""
    done = handled.select("ad_group_id", "offer_id").distinct()
    return targets.join(done, ["ad_group_id", "offer_id"], "left_anti").withColumn(
        "status", F.lit("FAILED")
    )


# --- deployments ----------------------------------------------------------------------------


def corrupt_outcomes(deployments: DataFrame) -> DataFrame:
    """FAILED results for every offer of a deployment that lacks its ids."""
    bad = with_reason(deployments, deployment_rules()).where(
        F.col("reject_reason").isNotNull() & (F.size("offers") > 0)
    )
    return bad.select(
        "request_uuid",
        "ad_group_id",
        F.explode(F.map_keys("offers")).alias("offer_id"),
        F.lit("FAILED").alias("status"),
        F.lit(CORRUPT_DEPLOYMENT).alias("error_message"),
    )


def deployment_patches(outcomes: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """What each result writes: status, and for failures the stored message.

    ``errors`` (request, ad group, offer_id, error_message) are offers of calls
    that gave no results at all; they all fail.
    """
    failed = F.col("status") == "FAILED"
    keys = ["request_uuid", "ad_group_id", "offer_id"]
    text = F.coalesce(blank_to_null(F.col("error_message")), F.lit(DEFAULT_OFFER_ERROR))
    patches = outcomes.select(
        *keys,
        "status",
        F.when(failed, failure_message("offer", text)).alias("error_message"),
        failed.alias("error_given"),
    )
    if errors is None:
        return patches
    lost = errors.join(
        outcomes.select("request_uuid", "ad_group_id").distinct(),
        ["request_uuid", "ad_group_id"],
        "left_anti",
    )
    return patches.unionByName(
        lost.select(
            *keys,
            F.lit("FAILED").alias("status"),
            failure_message("offer", F.col("error_message")).alias("error_message"),
            F.lit(True).alias("error_given"),
        )
    )


def apply_outcomes(
    deployments: DataFrame, patches: DataFrame, gather_limit: int = MAX_OPERATIONS
) -> DataFrame:
    """Set status and error of the given offers; a success keeps the old message.

    The patches of a deployment are gathered into a map, and the two maps are merged by
    key, linear in their sizes. A deployment with up to ``gather_limit`` patches gathers
    them all, after one shuffle by its key. Of one with more only the patches of offers
    that it has are gathered, so that the map is no larger than its own. An offer with
    several results keeps the best one (SUCCESS before ALREADY_PRESENT before FAILED), as
    the last write would. A patch without an offer patches nothing.
    """
    keys = ["request_uuid", "ad_group_id"]
    # By a hash: deployments that share one go the longer way, to the same result.
    hashed = F.xxhash64(*keys)
    given = patches.where(F.col("offer_id").isNotNull()).withColumn("_hash", hashed)
    # Fewer than one for each ``gather_limit`` patches.
    large = F.broadcast(
        given.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > gather_limit).select("_hash")
    )
    few = _best_results(given.join(large, "_hash", "left_anti").drop("_hash").repartition(*keys), keys)
    own = (
        deployments.withColumn("_hash", hashed)
        .join(large, "_hash", "left_semi")
        .select(*keys, F.explode(F.map_keys("offers")).alias("offer_id"))
        .distinct()
    )
    many = _best_results(given.join(large, "_hash", "left_semi").drop("_hash"), keys).join(
        own, [*keys, "offer_id"], "left_semi"
    )

    def gathered(best: DataFrame, name: str) -> DataFrame:
        return best.groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.struct("offer_id", "p"))).alias(name)
        )

    def patched(_: Column, info: Column, p: Column) -> Column:
        return F.when(p.isNull(), info).otherwise(
            F.struct(
                p.status.alias("status"),
                info.cpc_bid_micros.alias("cpc_bid_micros"),
                F.when(p.error_given, p.error_message)
                .otherwise(info.error_message)
                .alias("error_message"),
            )
        )

    # An offer that is not the deployment's own stays out.
    merged = F.map_filter(
        F.map_zip_with("offers", "_patch", lambda k, info, p: F.struct(patched(k, info, p).alias("info"), info.isNotNull().alias("own"))),
        lambda _, v: v["own"],
    )
    new = F.when(F.col("_patch").isNull(), F.col("offers")).otherwise(
        F.transform_values(merged, lambda _, v: v["info"]).cast(OFFERS_MAP)
    )
    return (
        deployments.join(gathered(few, "_few"), keys, "left")
        .join(gathered(many, "_many"), keys, "left")
        .withColumn("_patch", F.coalesce("_few", "_many"))
        .select(*[new.alias(c) if c == "offers" else F.col(c) for c in deployments.columns])
    )


def _best_results(patches: DataFrame, keys: list[str]) -> DataFrame:
    """One patch ``p`` for each offer: of equally good results the one with the greatest message, so that a retry repeats it."""
    weight = F.when(F.col("status") == "SUCCESS", 2).when(F.col("status") != "FAILED", 1).otherwise(0)
    return patches.groupBy(*keys, "offer_id").agg(
        F.max_by(
            F.struct("status", "error_message", "error_given"),
            F.struct(weight, F.col("error_given"), F.col("error_message"), F.col("status")),
        ).alias("p")
    )


# --- roll-ups --------------------------------------------------------------------------------


def entity_counts(outcomes: DataFrame) -> DataFrame:
    """Offers per status for each ad group of a request."""
    status = F.col("status")
    return outcomes.groupBy("request_uuid", "ad_group_id").agg(
        F.count_if(status == "SUCCESS").alias("success_count"),
        F.count_if(status.isin("PENDING", "PROCESSING")).alias("pending_count"),
        F.count_if(status == "ALREADY_PRESENT").alias("already_present_count"),
        F.count_if(status == "FAILED").alias("failed_count"),
    )


def request_counts(outcomes: DataFrame) -> DataFrame:
    """Items and successes per request; an item already present is a success."""
    return outcomes.groupBy("request_uuid").agg(
        F.count_if(F.col("status") != "FAILED").alias("success_count"),
        F.count(F.lit(1)).alias("total_count"),
    )


def finished_requests(
    requests: DataFrame, outcomes: DataFrame, errors: DataFrame | None = None
) -> DataFrame:
    """Final status of each request; one without any item succeeds.

    ``errors`` (request_uuid, error) are requests whose processing broke off.
    """
    counted = requests.select("request_uuid", "video_uuid").join(
        request_counts(outcomes), "request_uuid", "left"
    )
    if errors is None:
        counted = counted.withColumn("error", F.lit(None).cast("string"))
    else:
        counted = counted.join(errors.select("request_uuid", "error"), "request_uuid", "left")
    success = F.coalesce("success_count", F.lit(0)).cast("long")
    total = F.coalesce("total_count", F.lit(0)).cast("long")
    error = F.col("error")
    return counted.select(
        "request_uuid",
        "video_uuid",
        success.alias("success_count"),
        total.alias("total_count"),
        request_status(success, total, error).alias("status"),
        F.when(error.isNotNull(), failure_message("request", error)).alias("error_message"),
        counts_as_push(success, total, error).alias("counts_as_push"),
    )


def finish_pushes(
    videos: DataFrame, pushes: DataFrame, finished: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(videos, pushes) after requests finished.

    Their pushes end, a successful one stays noted at the video for good, and the
    video status is derived again. Requests of unknown videos change no video.
    """
    ended = finished.select("video_uuid", "request_uuid")
    left = pushes.join(ended, ["video_uuid", "request_uuid"], "left_anti")
    running = left.groupBy("video_uuid").agg(F.count(F.lit(1)).alias("_active"))
    return _with_final_status(videos, finished, running), left


def finalize_videos(videos: DataFrame, finished: DataFrame) -> DataFrame:
    """``finish_pushes`` for videos that hold their pushes in a map."""
    ended = finished.select("video_uuid", "request_uuid")
    gone = (
        push_rows(videos)
        .join(ended, ["video_uuid", "request_uuid"], "left_semi")
        .groupBy("video_uuid")
        # No longer than the map it is taken from.
        .agg(F.collect_list("request_uuid").alias("_gone"))
    )
    kept = F.when(F.col("_gone").isNull(), F.col("active_pushes")).otherwise(
        F.map_filter("active_pushes", lambda k, _: ~F.array_contains("_gone", k))
    )
    cleaned = videos.join(gone, "video_uuid", "left").select(
        *[kept.alias(c) if c == "active_pushes" else F.col(c) for c in videos.columns]
    )
    running = cleaned.select(
        "video_uuid",
        F.size(F.coalesce("active_pushes", empty_pushes())).alias("_active"),
    )
    return _with_final_status(cleaned, finished, running)


def _with_final_status(videos: DataFrame, finished: DataFrame, running: DataFrame) -> DataFrame:
    success = finished.groupBy("video_uuid").agg(F.bool_or("counts_as_push").alias("_success"))
    joined = videos.join(success, "video_uuid", "left").join(running, "video_uuid", "left")
    pushed = F.coalesce("has_successful_push", F.lit(False)) | F.col("_success")
    status = video_status(
        F.coalesce("_active", F.lit(0)), pushed, F.coalesce("stats_approved_count", F.lit(0))
    )
    new = {"has_successful_push": pushed, "status": status}
    return joined.select(
        *[
            F.when(F.col("_success").isNotNull(), new[c]).otherwise(F.col(c)).alias(c)
            if c in new
            else F.col(c)
            for c in videos.columns
        ]
    )


def finalize_requests(requests: DataFrame, finished: DataFrame, as_of: As_of) -> DataFrame:
    """Requests with final status, message and time of completion or failure."""
    stamp = as_column(as_of)
    broke = F.col("error_message").isNotNull()
    patch = finished.select(
        "request_uuid",
        "status",
        "error_message",
        F.when(~broke, stamp).alias("completed_at"),
        F.when(broke, stamp).alias("failed_at"),
    )
    return upsert(
        requests, patch, ["request_uuid"], ["status", "error_message", "completed_at", "failed_at"]
    )
