"""Ad accounts, campaigns and ad groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmatch.operators.joins import skew_join
from vidmatch.schemas import CHANNEL_TYPE
from vidmatch.session import cut_lineage


def descendants(accounts: DataFrame, customer_id: int) -> DataFrame:
    """Accounts below ``customer_id`` with their ``level``, one join per level.

    Each level is written down, so the plan does not grow with the depth and every
    level is computed once. Accounts met before are not followed again, which also
    ends a loop: the number of levels has no limit.
    """
    links = accounts.select("customer_id", "parent_id", "manager")
    seen = frontier = cut_lineage(
        links.where(F.col("customer_id") == customer_id)
        .select("customer_id", "manager", F.lit(0).alias("level"))
        .dropDuplicates(["customer_id"])
    )
    level = 0
    while not frontier.isEmpty():
        level += 1
        parents = frontier.select(F.col("customer_id").alias("parent_id"))
        frontier = cut_lineage(
            links.join(parents, "parent_id", "left_semi")
            .select("customer_id", "manager", F.lit(level).alias("level"))
            .dropDuplicates(["customer_id"])
            .join(seen.select("customer_id"), "customer_id", "left_anti")
        )
        seen = seen.unionByName(frontier)
    return seen.where(F.col("level") > 0)


def target_accounts(accounts: DataFrame, customer_id: int) -> DataFrame:
    """A manager stands for its non-manager descendants, any other for itself."""
    leaf = ~F.coalesce("manager", F.lit(False))
    own = accounts.where(F.col("customer_id") == customer_id)
    itself = own.where(leaf).select("customer_id").distinct()
    if own.where("manager").isEmpty():
        return itself
    below = descendants(accounts, customer_id).where(leaf)
    return itself.unionByName(below.select("customer_id")).distinct()


def all_descendants(accounts: DataFrame) -> DataFrame:
    """manager_id, customer_id, level of every account and everything above it, for all tops at once.

    Paths double: those of exactly k links are continued by those of up to k, so a tree
    of depth d takes log d rounds, not d. ``level`` is the least number of links; an
    account is not below itself, so a loop ends when no path is new.
    """
    links = accounts.where(F.col("parent_id").isNotNull() & (F.col("parent_id") != F.col("customer_id")))
    paths = cut_lineage(
        links.select(F.col("parent_id").alias("manager_id"), "customer_id", F.lit(1).alias("level")).distinct()
    )
    reach = 1
    while True:
        longest = paths.where(F.col("level") == reach).select(
            F.col("manager_id").alias("middle"), F.col("customer_id").alias("below"), F.col("level").alias("low")
        )
        above = paths.select(F.col("customer_id").alias("middle"), "manager_id", F.col("level").alias("high"))
        # Many accounts hang below one: the longer paths are the side that is split.
        joined = skew_join(longest, above, ["middle"], spread=["below"]).where(F.col("manager_id") != F.col("below"))
        found = joined.select("manager_id", F.col("below").alias("customer_id"), (F.col("low") + F.col("high")).alias("level"))
        both = paths.unionByName(found).groupBy("manager_id", "customer_id").agg(F.min("level").alias("level"))
        paths, reach = cut_lineage(both), 2 * reach
        if paths.where(F.col("level") == reach).isEmpty():
            return paths


def all_target_accounts(accounts: DataFrame) -> DataFrame:
    """top_id and customer_id: ``target_accounts`` of every account at once."""
    leaf = ~F.coalesce("manager", F.lit(False))
    leaves = accounts.where(leaf).select("customer_id").distinct()
    tops = accounts.where(F.coalesce("manager", F.lit(False))).select(F.col("customer_id").alias("manager_id")).distinct()
    below = all_descendants(accounts).join(tops, "manager_id", "left_semi").join(leaves, "customer_id", "left_semi")
    itself = leaves.select(F.col("customer_id").alias("top_id"), "customer_id")
    return itself.unionByName(below.select(F.col("manager_id").alias("top_id"), "customer_id")).distinct()


def sub_accounts(accounts: DataFrame, exclude_managers: bool = False) -> DataFrame:
    """Rows of the flattened account list below the top (``level > 0``)."""
    rows = accounts.where(F.col("level") > 0)
    return rows.where(~F.col("manager")) if exclude_managers else rows


def active_campaigns(campaigns: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    rows = campaigns.where(F.col("status") != "REMOVED")
    if types:
        rows = rows.where(F.col("advertising_channel_type").isin(list(types)))
    return rows.orderBy(F.col("campaign_id").desc())


def active_ad_groups(ad_groups: DataFrame, campaign_id: int) -> DataFrame:
    return ad_groups.where(
        (F.col("campaign_id") == campaign_id) & (F.col("status") != "REMOVED")
    )


def accessible_accounts(
    names: DataFrame, accounts: DataFrame, platform_id: int
) -> DataFrame:
    """Accounts behind resource names ``customers/<id>`` that have details."""
    ident = F.element_at(F.split("resource_name", "/"), -1).try_cast("bigint")
    return (
        names.select(ident.alias("customer_id"))
        .join(accounts, "customer_id")
        .withColumn("is_platform_customer_id", F.col("customer_id") == platform_id)
    )


def search_named(df: DataFrame, term: str, name: str, ident: str) -> DataFrame:
    """Case-insensitive part of the name, or part of the id; '' keeps all rows."""
    if not term:
        return df
    needle = F.lit(term.lower())
    return df.where(
        F.contains(F.lower(name), needle) | F.contains(F.col(ident).cast("string"), needle)
    )


def ad_groups_with_video(
    video_ads: DataFrame, video_id: str, customer_id: int | None = None
) -> DataFrame:
    """Where a video is used, in campaigns of the wanted type only."""
    rows = video_ads.where(
        (F.col("video_id") == video_id)
        & (F.col("advertising_channel_type") == CHANNEL_TYPE)
    )
    return rows if customer_id is None else rows.where(F.col("customer_id") == customer_id)


def discover_destinations(
    video_ads: DataFrame, video_id: str, customer_id: int | None = None
) -> DataFrame:
    """Linked ad groups as destinations; incomplete ones are dropped."""
    triple = ["customer_id", "campaign_id", "ad_group_id"]
    return (
        ad_groups_with_video(video_ads, video_id, customer_id)
        .dropna(subset=triple)
        .select(*triple, "campaign_name", "ad_group_name")
        .dropDuplicates(triple)
    )


def enrich_entities(entities: DataFrame, ad_groups: DataFrame) -> DataFrame:
    """Add customer, campaign and ad group names; ids that are 0 are not looked up."""
    names = ad_groups.where(
        (F.col("customer_id") != 0) & (F.col("ad_group_id") != 0)
    ).select("customer_id", "ad_group_id", "customer_name", "campaign_name", "ad_group_name")
    return entities.join(
        names.dropDuplicates(["customer_id", "ad_group_id"]),
        ["customer_id", "ad_group_id"],
        "left",
    )


def ad_groups_by_customer(entities: DataFrame) -> DataFrame:
    """Distinct (customer, ad group) pairs to look up.

    Pairs as rows rather than one set per customer, which could grow without bound.
    """
    return (
        entities.where((F.col("customer_id") != 0) & (F.col("ad_group_id") != 0))
        .select("customer_id", "ad_group_id")
        .distinct()
    )
