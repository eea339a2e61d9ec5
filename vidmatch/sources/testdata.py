"""The supplied sample tables seen as the canonical tables.

The adapters only decide which rows exist; every one of them takes its table whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidmatch.functions.text import search_keywords
from vidmatch.operators.ranking import last_per_key

# Order among listings of one offer, beyond the preferences.
LISTING_TIES = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity"]
# Events before this moment are what is stored, the later ones the update.
SPLIT = "2024-01-16 00:00:00"
AS_OF = "2001-08-01 00:00:00"


def _text(c: str):
    return F.col(c).cast("string")


class SampleTables:
    """Canonical tables over one folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- catalog and vectors

    def product_feed(self) -> DataFrame:
        none = F.lit(None).cast("string")
        return (
            self.table("lineitem")
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.trunc("l_shipdate", "year").alias("data_date"),
                _text("l_partkey").alias("offer_id"),
                F.col("p_name").alias("title"),
                F.col("p_brand").alias("brand"),
                F.concat_ws(" ", "p_name", "p_type").alias("description"),
                F.col("p_type").alias("product_type"),
                F.concat_ws(" > ", "p_brand", "p_type").alias("google_product_category_path"),
                *[none.alias(c) for c in ("age_group", "color", "gender", "material", "pattern")],
                F.concat(
                    F.lit("https://img.example/"), F.replace("p_name", F.lit(" "), F.lit("_"))
                ).alias("image_link"),
                F.array().cast("array<string>").alias("additional_image_links"),
                F.when(F.col("l_linestatus") == "O", "ONLINE").otherwise("LOCAL").alias("channel"),
                F.when(F.col("l_returnflag") == "N", "en")
                .when(F.col("l_returnflag") == "A", "de")
                .otherwise("fr")
                .alias("content_language"),
                F.when(F.col("l_quantity") > 25, "in stock")
                .otherwise("out of stock")
                .alias("availability"),
                F.struct(F.col("l_extendedprice").cast("decimal(18,4)").alias("value")).alias("price"),
                *LISTING_TIES,
            )
        )

    def product_embeddings(self) -> DataFrame:
        return self.table("embeddings").select(
            _text("vec_id").alias("id"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("insertion_timestamp"),
            F.col("embedding").cast("array<double>").alias("embedding"),
            F.lit("sample").alias("embedding_model_id"),
        )

    def video_analysis(self) -> DataFrame:
        """Ten neighbouring vectors are the products identified in one video."""
        none = F.lit(None).cast("string")
        product = F.struct(
            F.concat(F.lit("item "), _text("vec_id")).alias("title"),
            F.concat(F.lit("label "), _text("label")).alias("description"),
            none.alias("color_pattern_style_usage"),
            none.alias("category"),
            none.alias("subcategory"),
            (F.col("vec_id") * 1000).alias("video_timestamp"),
            none.alias("relevance_reasoning"),
            F.col("embedding").cast("array<double>").alias("embedding"),
            F.concat(F.lit("idp-"), _text("vec_id")).alias("uuid"),
        )
        # Exactly ten rows per group: vec_id is a running number.
        return (
            self.table("embeddings")
            .groupBy(F.floor(F.col("vec_id") / 10).alias("n"))
            .agg(
                F.collect_list(product).alias("identified_products"),
                F.sum("label").alias("labels"),
            )
            .select(
                F.concat(F.lit("video-"), _text("n")).alias("uuid"),
                F.timestamp_seconds(F.lit(1704067200) + F.col("n") * 3600).alias("timestamp"),
                F.lit("google_ads").alias("source"),
                F.concat(F.lit("yt-"), _text("n")).alias("video_id"),
                F.struct(
                    F.concat(F.lit("Video "), _text("n")).alias("title"),
                    none.alias("description"),
                ).alias("metadata"),
                none.alias("gcs_uri"),
                none.alias("md5_hash"),
                F.when(F.col("labels") > 55, "FAILED").otherwise("SUCCESS").alias("status"),
                none.alias("error_message"),
                F.lit("sample").alias("embedding_model_id"),
                F.lit("sample").alias("generative_model_id"),
                "identified_products",
            )
        )

    def raw_answers(self) -> DataFrame:
        """One model answer per conversation turn."""
        item = F.struct(
            F.col("role").alias("title"),
            F.col("text").alias("description"),
            F.format_string("%02d:%02d:%06.3f", F.lit(0), F.col("turn"), F.lit(16.016)).alias(
                "video_timestamp"
            ),
        )
        return self.table("conversations").select(
            F.concat_ws("-", _text("conv_id"), _text("turn")).alias("uuid"),
            F.to_json(F.array(item)).alias("answer"),
        )

    # --- matches and review

    def _events(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            "ts",
            "event_type",
            (F.col("value") / 1000).alias("distance"),
            F.concat(F.lit("idp-"), _text("user_id")).alias("idp"),
            F.concat(
                F.lit("video-"), F.floor(F.col("user_id") / 10).cast("string")
            ).alias("video"),
            F.get_json_object("props", "$.k").alias("offer"),
        )

    def matched_products(self) -> DataFrame:
        return self._events().select(
            F.col("ts").alias("timestamp"),
            F.col("idp").alias("uuid"),
            F.lit("product").alias("identified_product_title"),
            F.lit("text").alias("identified_product_description"),
            F.col("offer").alias("matched_product_offer_id"),
            F.lit("title").alias("matched_product_title"),
            F.lit("brand").alias("matched_product_brand"),
            "distance",
        )

    def _reviews(self) -> DataFrame:
        return self._events().select(
            F.col("video").alias("video_uuid"),
            F.col("idp").alias("identified_product_uuid"),
            F.col("offer").alias("offer_id"),
            "distance",
            F.when(F.col("event_type") == "purchase", "APPROVED")
            .when(F.col("event_type") == "error", "DISAPPROVED")
            .otherwise("UNREVIEWED")
            .alias("candidate_status"),
            F.concat(F.lit("by-"), "event_type").alias("user"),
            (F.col("event_type") == "signup").alias("is_added_by_user"),
            F.col("ts").alias("modified_timestamp"),
            F.col("event_id").alias("position"),
        )

    def candidates(self) -> DataFrame:
        """What is stored: the last review per candidate before the split."""
        return last_per_key(
            self._reviews().where(F.col("modified_timestamp") < F.lit(SPLIT).cast("timestamp")),
            ["video_uuid", "identified_product_uuid", "offer_id"],
            "position",
        ).drop("position")

    def decisions(self) -> DataFrame:
        return self._reviews().where(
            F.col("modified_timestamp") >= F.lit(SPLIT).cast("timestamp")
        )

    def video_states(self) -> DataFrame:
        """Counters of the stored candidates, with some pushes under way or done."""
        approved = F.count_if(F.col("candidate_status") == "APPROVED")
        return (
            self.candidates()
            .groupBy("video_uuid")
            .agg(
                approved.alias("stats_approved_count"),
                F.count(F.lit(1)).alias("stats_matched_count"),
            )
            .withColumn("has_successful_push", F.col("stats_approved_count") % 2 == 0)
            .withColumn(
                "active_pushes",
                F.when(
                    F.col("stats_matched_count") % 3 == 0,
                    F.create_map(
                        F.concat(F.lit("req-"), "video_uuid"), F.lit(SPLIT).cast("timestamp")
                    ),
                ).otherwise(F.create_map().cast("map<string,timestamp>")),
            )
            .withColumn("status", F.lit("Needs Review"))
        )

    def inventory(self) -> DataFrame:
        """Offers of the parts table with a low price class only have no entry."""
        return (
            self.table("part")
            .where(F.col("p_size") > 10)
            .select(
                _text("p_partkey").alias("offer_id"),
                F.col("p_name").alias("title"),
                F.col("p_brand").alias("brand"),
                F.concat(
                    F.lit("https://img.example/"), F.replace("p_name", F.lit(" "), F.lit("_"))
                ).alias("image_link"),
                F.lit("in stock").alias("availability"),
                F.col("p_retailprice").alias("price"),
            )
        )

    # --- videos

    def videos(self) -> DataFrame:
        docs = self.table("documents").select(
            _text("doc_id").alias("video_uuid"),
            F.concat(F.lit("vid-"), _text("doc_id")).alias("video_id"),
            "source",
            F.lit(None).cast("string").alias("gcs_uri"),
            F.lit(None).cast("string").alias("md5_hash"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("timestamp"),
            F.col("text").alias("title"),
            F.lit("").alias("description"),
            F.col("n_chars").alias("stats_identified_count"),
            F.lit(None).cast("long").alias("stats_matched_count"),
            F.lit(None).cast("long").alias("stats_approved_count"),
            F.when(F.col("lang") == "en", "Needs Review")
            .when(F.col("lang") == "de", "Ready to Push")
            .when(F.col("lang") == "fr", "Push Complete")
            .otherwise("Push in Progress")
            .alias("status"),
            F.lit(None).cast("map<string,timestamp>").alias("active_pushes"),
            F.lit(None).cast("boolean").alias("has_successful_push"),
        )
        return docs.withColumn(
            "search_keywords", search_keywords(F.col("title"), F.col("video_id"))
        )

    def sheet_candidates(self) -> DataFrame:
        none = F.lit(None).cast("string")
        return self.table("pages").select(
            F.lit("manual_entry").alias("source"),
            F.concat(F.lit("vid-"), _text("page_id")).alias("video_id"),
            none.alias("gcs_uri"),
            none.alias("md5_hash"),
            none.alias("title"),
            none.alias("description"),
            F.col("page_id").alias("position"),
        )

    def file_candidates(self) -> DataFrame:
        return self.table("pages").select(
            F.lit("manual_entry").alias("source"),
            F.lit(None).cast("string").alias("video_id"),
            F.regexp_replace("url", "^https?://", "gs://").alias("gcs_uri"),
            F.md5(F.encode("html", "UTF-8")).alias("md5_hash"),
            F.element_at(F.split("url", "/"), -1).alias("title"),
            F.lit(None).cast("string").alias("description"),
            F.col("page_id").alias("position"),
        )

    def ads_candidates(self) -> DataFrame:
        none = F.lit(None).cast("string")
        return self.table("events").select(
            F.lit("google_ads").alias("source"),
            F.concat(F.lit("vid-"), _text("user_id")).alias("video_id"),
            none.alias("gcs_uri"),
            none.alias("md5_hash"),
            none.alias("title"),
            none.alias("description"),
            F.col("event_id").alias("position"),
        )

    def processed(self) -> DataFrame:
        """Videos of the labelled documents count as analysed."""
        return self.table("labels").select(
            F.concat(F.lit("vid-"), _text("doc_id")).alias("video_id"),
            F.lit(None).cast("string").alias("gcs_uri"),
        )

    def privacy_info(self) -> DataFrame:
        return self.table("documents").select(
            F.concat(F.lit("vid-"), _text("doc_id")).alias("video_id"),
            F.when(F.col("lang") == "en", "public").otherwise("unlisted").alias("privacy_status"),
            F.col("source").alias("title"),
            F.col("lang").alias("description"),
        )

    # --- accounts and ads

    def accounts(self) -> DataFrame:
        """One top account, regions and nations as managers, customers as leaves."""
        top = self.table("region").select(
            (F.col("r_regionkey") + 10).cast("long").alias("customer_id"),
            F.lit(1).cast("long").alias("parent_id"),
            F.lit(True).alias("manager"),
            F.col("r_name").alias("descriptive_name"),
        )
        nations = self.table("nation").select(
            (F.col("n_nationkey") + 100).cast("long").alias("customer_id"),
            (F.col("n_regionkey") + 10).cast("long").alias("parent_id"),
            F.lit(True).alias("manager"),
            F.col("n_name").alias("descriptive_name"),
        )
        customers = self.table("customer").select(
            (F.col("c_custkey") + 1000).cast("long").alias("customer_id"),
            (F.col("c_nationkey") + 100).cast("long").alias("parent_id"),
            F.lit(False).alias("manager"),
            F.col("c_name").alias("descriptive_name"),
        )
        root = self.table("region").agg(
            F.lit(1).cast("long").alias("customer_id"),
            F.lit(None).cast("long").alias("parent_id"),
            F.lit(True).alias("manager"),
            F.concat(F.lit("top of "), F.count(F.lit(1)).cast("string")).alias("descriptive_name"),
        )
        return root.unionByName(top).unionByName(nations).unionByName(customers)

    def campaigns(self) -> DataFrame:
        return self.table("orders").select(
            (F.col("o_custkey") + 1000).cast("long").alias("customer_id"),
            F.col("o_orderkey").alias("campaign_id"),
            F.concat(F.lit("campaign "), _text("o_orderkey")).alias("campaign_name"),
            F.when(F.col("o_orderstatus") == "F", "REMOVED").otherwise("ENABLED").alias("status"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "DEMAND_GEN")
            .otherwise("SEARCH")
            .alias("advertising_channel_type"),
        )

    def video_ads(self) -> DataFrame:
        return (
            self.table("lineitem")
            .join(self.campaigns(), F.col("l_orderkey") == F.col("campaign_id"))
            .select(
                "customer_id",
                "campaign_id",
                "campaign_name",
                "advertising_channel_type",
                F.col("l_suppkey").alias("ad_group_id"),
                F.concat(F.lit("ad group "), _text("l_suppkey")).alias("ad_group_name"),
                F.concat(F.lit("vid-"), _text("l_partkey")).alias("video_id"),
            )
        )

    def ad_groups(self) -> DataFrame:
        return self.table("supplier").join(
            self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")
        ).select(
            F.col("s_nationkey").cast("long").alias("customer_id"),
            F.col("s_suppkey").alias("ad_group_id"),
            F.col("n_name").alias("customer_name"),
            F.lit(None).cast("string").alias("campaign_name"),
            F.col("s_name").alias("ad_group_name"),
        )

    # --- publication

    def requests(self) -> DataFrame:
        running = F.col("o_orderstatus") == "P"
        return self.table("orders").select(
            _text("o_orderkey").alias("request_uuid"),
            F.concat(F.lit("video-"), _text("o_custkey")).alias("video_uuid"),
            F.concat(F.lit("user-"), _text("o_custkey")).alias("submitting_user"),
            F.when(F.col("o_orderstatus") == "O", "PENDING")
            .when(running, "PROCESSING")
            .otherwise("SUCCESS")
            .alias("status"),
            F.col("o_orderdate").cast("timestamp").alias("timestamp"),
            F.when(running, F.col("o_orderdate").cast("timestamp")).alias("leased_at"),
            F.lit(None).cast("string").alias("error_message"),
        )

    def outcomes(self) -> DataFrame:
        """One result per line: request, ad group, offer and status."""
        return self.table("lineitem").select(
            _text("l_orderkey").alias("request_uuid"),
            F.col("l_suppkey").alias("ad_group_id"),
            _text("l_partkey").alias("offer_id"),
            F.when(F.col("l_returnflag") == "N", "SUCCESS")
            .when(F.col("l_returnflag") == "A", "ALREADY_PRESENT")
            .otherwise("FAILED")
            .alias("status"),
            F.when(F.col("l_linestatus") == "O", "refused").alias("error_message"),
        )

    def entities(self) -> DataFrame:
        """Distinct (request, customer, ad group) of the lines."""
        return (
            self.table("lineitem")
            .select("l_orderkey", "l_suppkey")
            .distinct()
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                _text("l_orderkey").alias("request_uuid"),
                F.col("s_nationkey").cast("long").alias("customer_id"),
                F.col("l_orderkey").alias("campaign_id"),
                F.col("l_suppkey").alias("ad_group_id"),
                F.lit(None).cast("string").alias("error_message"),
            )
        )

    def submissions(self) -> DataFrame:
        """One submission per line: three offer ids, one of them twice."""
        def destination(customer, group):
            return F.struct(
                customer.cast("long").alias("customer_id"),
                F.col("l_orderkey").alias("campaign_id"),
                group.cast("long").alias("ad_group_id"),
            )

        line = F.col("l_linenumber")
        return self.table("lineitem").select(
            F.concat_ws(
                "-", *[_text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
            ).alias("request_uuid"),
            F.concat(F.lit("video-"), _text("l_suppkey")).alias("video_uuid"),
            F.concat(
                _text("l_partkey"), F.lit(", "), _text("l_orderkey"), F.lit(","), _text("l_partkey")
            ).alias("offer_ids"),
            F.array(
                destination(line, F.col("l_suppkey")), destination(line + 1, line)
            ).alias("destinations"),
            F.col("l_returnflag").alias("submitting_user"),
            F.col("l_discount").alias("cpc"),
        )

    def listing_groups(self) -> DataFrame:
        """A root per supplier; returned lines are its children.

        Suppliers in debt have no tree, poor ones a single unit, those in the
        middle a tree by item, the rich ones a tree by brand.
        """
        none = F.lit(None).cast("string")
        suppliers = self.table("supplier").where(F.col("s_acctbal") >= 0)
        root = F.concat(F.lit("ag-"), _text("s_suppkey"))
        dimension = F.when(F.col("s_acctbal") < 6000, "product_item_id").otherwise("product_brand")
        roots = suppliers.select(
            F.col("s_suppkey").alias("ad_group_id"),
            root.alias("resource_name"),
            F.when(F.col("s_acctbal") < 2000, "UNIT").otherwise("SUBDIVISION").alias("type"),
            none.alias("parent"),
            none.alias("case_dimension"),
            none.alias("product_item_id"),
            F.lit(False).alias("negative"),
        )
        children = (
            self.table("lineitem")
            .where(F.col("l_returnflag") == "A")
            .select("l_suppkey", "l_partkey")
            .distinct()
            .join(
                suppliers.where(F.col("s_acctbal") >= 2000), F.col("l_suppkey") == F.col("s_suppkey")
            )
            .select(
                F.col("s_suppkey").alias("ad_group_id"),
                F.concat_ws("~", root, _text("l_partkey")).alias("resource_name"),
                F.lit("UNIT").alias("type"),
                root.alias("parent"),
                dimension.alias("case_dimension"),
                F.when(dimension == "product_item_id", _text("l_partkey")).alias("product_item_id"),
                F.lit(False).alias("negative"),
            )
        )
        return roots.unionByName(children)

    def listing_targets(self) -> DataFrame:
        return (
            self.table("lineitem")
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                F.col("l_suppkey").alias("ad_group_id"),
                _text("l_partkey").alias("offer_id"),
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"),
                F.when(F.col("s_nationkey") < 5, "purge").alias("strategy"),
            )
        )

    def call_failures(self) -> DataFrame:
        return (
            self.table("supplier")
            .where(F.col("s_acctbal") > 5000)
            .select(F.col("s_suppkey").alias("ad_group_id"), F.lit("quota").alias("error_message"))
        )
