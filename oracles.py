"""SQL counterparts of the registered queries, over the same Parquet tables."""

from __future__ import annotations

SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"
AS_OF = "TIMESTAMP '2001-08-01 00:00:00'"
LATER = "TIMESTAMP '2024-02-01 00:00:00'"
OP_LIMIT = 560
K = 10

# --- the sample tables as canonical tables -------------------------------------------

FEED = """
feed AS (
  SELECT CAST(date_trunc('year', l_shipdate) AS DATE) AS data_date,
         CAST(l_partkey AS VARCHAR) AS offer_id, p_name AS title, p_brand AS brand,
         p_name || ' ' || p_type AS description, p_type AS product_type,
         p_brand || ' > ' || p_type AS category,
         'https://img.example/' || replace(p_name, ' ', '_') AS image_link,
         CASE WHEN l_linestatus = 'O' THEN 'ONLINE' ELSE 'LOCAL' END AS channel,
         CASE l_returnflag WHEN 'N' THEN 'en' WHEN 'A' THEN 'de' ELSE 'fr' END AS content_language,
         CASE WHEN l_quantity > 25 THEN 'in stock' ELSE 'out of stock' END AS availability,
         CAST(CAST(l_extendedprice AS DECIMAL(18,4)) AS DOUBLE) AS price,
         l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey),
latest AS (SELECT * FROM feed WHERE data_date = (SELECT max(data_date) FROM feed))"""

TIES = "l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity"


def pick(source: str, language: bool = False) -> str:
    lang = "(content_language = 'en') DESC, " if language else ""
    return (
        f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY offer_id"
        f" ORDER BY (upper(channel) = 'ONLINE') DESC, {lang}{TIES}) = 1"
    )


BASE = """
base AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS embedding
         FROM embeddings)"""

PRODUCTS = """
products AS (
  SELECT 'video-' || n AS video_uuid, 'idp-' || vec_id AS uuid, 'item ' || vec_id AS title,
         'label ' || label AS description, vec_id * 1000 AS video_timestamp,
         CAST(embedding AS DOUBLE[]) AS embedding, n,
         TIMESTAMP '2024-01-01 00:00:00' + n * INTERVAL 1 HOUR AS timestamp,
         CASE WHEN sum(label) OVER (PARTITION BY n) > 55 THEN 'FAILED' ELSE 'SUCCESS' END AS status
  FROM (SELECT *, CAST(floor(vec_id / 10) AS BIGINT) AS n FROM embeddings))"""

MATCHED = """
matched AS (
  SELECT ts AS timestamp, 'idp-' || user_id AS uuid,
         json_extract_string(props, '$.k') AS offer, value / 1000 AS distance
  FROM events)"""

REVIEWS = f"""
reviews AS (
  SELECT 'video-' || CAST(floor(user_id / 10) AS BIGINT) AS video_uuid,
         'idp-' || user_id AS identified_product_uuid,
         json_extract_string(props, '$.k') AS offer_id, value / 1000 AS distance,
         CASE event_type WHEN 'purchase' THEN 'APPROVED' WHEN 'error' THEN 'DISAPPROVED'
              ELSE 'UNREVIEWED' END AS candidate_status,
         'by-' || event_type AS "user", event_type = 'signup' AS is_added_by_user,
         ts AS modified_timestamp, event_id AS position
  FROM events),
candidates AS (
  SELECT * FROM reviews WHERE modified_timestamp < {SPLIT}
  QUALIFY row_number() OVER (PARTITION BY video_uuid, identified_product_uuid, offer_id
                             ORDER BY position DESC) = 1),
decisions AS (
  SELECT * FROM reviews WHERE modified_timestamp >= {SPLIT}
  QUALIFY row_number() OVER (PARTITION BY video_uuid, identified_product_uuid, offer_id
                             ORDER BY position DESC) = 1),
states AS (
  SELECT video_uuid, count(*) FILTER (WHERE candidate_status = 'APPROVED') AS approved,
         count(*) AS matched FROM candidates GROUP BY 1),
state_flags AS (
  SELECT *, approved % 2 = 0 AS pushed, matched % 3 = 0 AS active FROM states)"""

INVENTORY = """
inventory AS (
  SELECT CAST(p_partkey AS VARCHAR) AS offer_id, p_name AS title, p_brand AS brand,
         'https://img.example/' || replace(p_name, ' ', '_') AS image_link,
         'in stock' AS availability, p_retailprice AS price
  FROM part WHERE p_size > 10)"""

DELTAS = """
deltas AS (
  SELECT d.video_uuid,
         CAST(sum(CASE WHEN c.offer_id IS NULL THEN CAST(d.candidate_status = 'APPROVED' AS INT)
                  WHEN c.candidate_status = d.candidate_status THEN 0
                  ELSE CAST(d.candidate_status = 'APPROVED' AS INT)
                       - CAST(c.candidate_status = 'APPROVED' AS INT) END) AS BIGINT) AS delta_approved,
         CAST(sum(CASE WHEN c.offer_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS delta_matched
  FROM decisions d LEFT JOIN candidates c USING (video_uuid, identified_product_uuid, offer_id)
  GROUP BY 1)"""

VIDEOS = r"""
videos AS (
  SELECT CAST(doc_id AS VARCHAR) AS video_uuid, 'vid-' || doc_id AS video_id, source,
         TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR AS timestamp, text AS title,
         n_chars AS stats_identified_count,
         CASE lang WHEN 'en' THEN 'Needs Review' WHEN 'de' THEN 'Ready to Push'
              WHEN 'fr' THEN 'Push Complete' ELSE 'Push in Progress' END AS status,
         list_distinct(regexp_extract_all(lower(text || ' vid-' || doc_id),
                       '[\p{L}\p{N}_-]+')) AS keywords
  FROM documents)"""

FOUND = """list_has_any(keywords, ['the', 'est', 'shoes'])"""

CANDIDATE_VIDEOS = """
sheet AS (SELECT 'manual_entry' AS source, 'vid-' || page_id AS video_id,
                 CAST(NULL AS VARCHAR) AS gcs_uri, CAST(NULL AS VARCHAR) AS title,
                 page_id AS position FROM pages),
files AS (SELECT 'manual_entry' AS source, CAST(NULL AS VARCHAR) AS video_id,
                 regexp_replace(url, '^https?://', 'gs://') AS gcs_uri,
                 split_part(url, '/', -1) AS title, page_id AS position, md5(html) AS md5_hash
          FROM pages),
ads AS (SELECT 'google_ads' AS source, 'vid-' || user_id AS video_id,
               CAST(NULL AS VARCHAR) AS gcs_uri, CAST(NULL AS VARCHAR) AS title,
               event_id AS position FROM events),
processed AS (SELECT DISTINCT 'vid-' || doc_id AS video_id FROM labels),
info AS (SELECT 'vid-' || doc_id AS video_id,
                CASE WHEN lang = 'en' THEN 'public' ELSE 'unlisted' END AS privacy,
                source AS title, lang AS description FROM documents),
united AS (
  SELECT source, video_id, gcs_uri, title, position, 0 AS source_rank FROM sheet
  UNION ALL SELECT source, video_id, gcs_uri, title, position, 1 FROM files
  UNION ALL SELECT source, video_id, gcs_uri, title, position, 2 FROM ads),
first_seen AS (
  SELECT * FROM united QUALIFY row_number() OVER (
    PARTITION BY coalesce('id:' || video_id, 'uri:' || gcs_uri)
    ORDER BY source_rank, position) = 1)"""

ACCOUNTS = """
accounts AS (
  SELECT CAST(1 AS BIGINT) AS customer_id, CAST(NULL AS BIGINT) AS parent_id, true AS manager,
         'top of ' || count(*) AS descriptive_name FROM region
  UNION ALL SELECT r_regionkey + 10, 1, true, r_name FROM region
  UNION ALL SELECT n_nationkey + 100, n_regionkey + 10, true, n_name FROM nation
  UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, false, c_name FROM customer)"""

CAMPAIGNS = """
campaigns AS (
  SELECT o_custkey + 1000 AS customer_id, o_orderkey AS campaign_id,
         'campaign ' || o_orderkey AS campaign_name,
         CASE WHEN o_orderstatus = 'F' THEN 'REMOVED' ELSE 'ENABLED' END AS status,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'DEMAND_GEN'
              ELSE 'SEARCH' END AS advertising_channel_type FROM orders),
video_ads AS (
  SELECT customer_id, campaign_id, campaign_name, advertising_channel_type,
         l_suppkey AS ad_group_id, 'ad group ' || l_suppkey AS ad_group_name,
         'vid-' || l_partkey AS video_id
  FROM lineitem JOIN campaigns ON l_orderkey = campaign_id)"""

REQUESTS = """
requests AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS request_uuid, 'video-' || o_custkey AS video_uuid,
         'user-' || o_custkey AS submitting_user,
         CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'PROCESSING'
              ELSE 'SUCCESS' END AS status,
         CAST(o_orderdate AS TIMESTAMP) AS timestamp,
         CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS TIMESTAMP) END AS leased_at
  FROM orders)"""

OUTCOMES = """
outcomes AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS request_uuid, l_suppkey AS ad_group_id,
         CAST(l_partkey AS VARCHAR) AS offer_id,
         CASE l_returnflag WHEN 'N' THEN 'SUCCESS' WHEN 'A' THEN 'ALREADY_PRESENT'
              ELSE 'FAILED' END AS status,
         CASE WHEN l_linestatus = 'O' THEN 'refused' END AS error_message
  FROM lineitem),
rollup AS (
  SELECT request_uuid, count(*) FILTER (WHERE status <> 'FAILED') AS success_count,
         count(*) AS total_count FROM outcomes GROUP BY 1)"""

ENTITIES = """
entities AS (
  SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS request_uuid,
         CAST(s_nationkey AS BIGINT) AS customer_id, l_orderkey AS campaign_id,
         l_suppkey AS ad_group_id
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
ad_groups AS (
  SELECT CAST(s_nationkey AS BIGINT) AS customer_id, s_suppkey AS ad_group_id,
         n_name AS customer_name, CAST(NULL AS VARCHAR) AS campaign_name,
         s_name AS ad_group_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

SUBMISSIONS = f"""
subs AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS request_uuid,
         'video-' || l_suppkey AS video_uuid, l_returnflag AS submitting_user,
         [CAST(l_partkey AS VARCHAR), CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR)] AS ids,
         CASE WHEN l_discount <> 0 THEN CAST(trunc(l_discount * 1e6) AS BIGINT) END AS cpc_bid_micros,
         l_orderkey, l_linenumber, l_suppkey FROM lineitem),
deployments AS (
  SELECT request_uuid, video_uuid, CAST(l_linenumber AS BIGINT) AS customer_id,
         l_orderkey AS campaign_id, l_suppkey AS ad_group_id, ids, cpc_bid_micros
  FROM subs WHERE l_suppkey <> l_linenumber
  UNION ALL
  SELECT request_uuid, video_uuid, CAST(l_linenumber + 1 AS BIGINT), l_orderkey,
         CAST(l_linenumber AS BIGINT), ids, cpc_bid_micros FROM subs),
offer_rows AS (
  SELECT request_uuid, video_uuid, customer_id, campaign_id, ad_group_id, offer_id, cpc_bid_micros
  FROM (SELECT *, unnest(list_distinct(ids)) AS offer_id FROM deployments))"""

LISTING = f"""
shops AS (
  SELECT s_suppkey AS ad_group_id, 'ag-' || s_suppkey AS root_name,
         CASE WHEN s_acctbal < 2000 THEN 'UNIT' ELSE 'SUBDIVISION' END AS root_type,
         CASE WHEN s_acctbal < 6000 THEN 'product_item_id' ELSE 'product_brand' END AS dimension,
         s_acctbal FROM supplier WHERE s_acctbal >= 0),
children AS (
  SELECT DISTINCT ad_group_id, root_name || '~' || l_partkey AS resource_name,
         root_name AS parent, root_type,
         CASE WHEN dimension = 'product_item_id' THEN CAST(l_partkey AS VARCHAR) END AS product_item_id
  FROM shops JOIN lineitem ON l_suppkey = ad_group_id
  WHERE l_returnflag = 'A' AND s_acctbal >= 2000),
tree AS (
  SELECT ad_group_id, root_name,
         CASE WHEN root_type = 'UNIT' THEN 'CLEAN'
              WHEN dimension = 'product_item_id' AND EXISTS (
                SELECT 1 FROM children c WHERE c.ad_group_id = s.ad_group_id) THEN 'PARTITIONED'
              ELSE 'DIRTY' END AS state FROM shops s),
targets AS (
  SELECT l_suppkey AS ad_group_id, CAST(l_partkey AS VARCHAR) AS offer_id,
         l_orderkey * 10 + l_linenumber AS position, s_nationkey
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
planned AS (
  SELECT t.ad_group_id, t.offer_id, t.position, tree.root_name,
         CASE WHEN s_nationkey < 5 OR coalesce(state, 'CLEAN') = 'CLEAN' THEN 'REBUILD'
              WHEN state = 'PARTITIONED' THEN 'APPEND' ELSE 'ERROR' END AS mode,
         c.product_item_id IS NOT NULL AS present,
         min(position) OVER (PARTITION BY t.ad_group_id, t.offer_id) = position AS first,
         count(*) OVER (PARTITION BY t.ad_group_id, t.offer_id) AS copies
  FROM targets t LEFT JOIN tree ON t.ad_group_id = tree.ad_group_id
  LEFT JOIN children c ON c.ad_group_id = t.ad_group_id AND c.product_item_id = t.offer_id),
acted AS (
  SELECT *, first AND mode <> 'ERROR' AND NOT (mode = 'APPEND' AND present) AS adds FROM planned),
groups AS (
  SELECT DISTINCT ad_group_id, root_name FROM acted WHERE mode = 'REBUILD'),
ops AS (
  SELECT ad_group_id, 0 AS step, 'REMOVE_ROOT' AS op, root_name AS resource_name,
         CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS offer_id, false AS negative
  FROM groups WHERE root_name IS NOT NULL
  UNION ALL SELECT ad_group_id, 1, 'CREATE_ROOT', ad_group_id || '~-1', NULL, NULL, false FROM groups
  UNION ALL SELECT ad_group_id, 2, 'CREATE_OTHER', NULL, ad_group_id || '~-1', NULL, true FROM groups
  UNION ALL SELECT ad_group_id, 3, 'CREATE_UNIT', NULL,
         CASE WHEN mode = 'REBUILD' THEN ad_group_id || '~-1' ELSE root_name END, offer_id, false
  FROM acted WHERE adds),
guard AS (SELECT ad_group_id, count(*) AS op_count, count(*) > {OP_LIMIT} AS overflow
          FROM ops GROUP BY 1)"""


def sql(body: str, *ctes: str) -> str:
    return f"WITH {','.join(c.strip() for c in ctes)}\n{body.strip()}" if ctes else body.strip()


def knn_ctes(queries: str = "products") -> str:
    return f"""
pairs AS (
  SELECT q.uuid, b.id, list_distance(q.embedding, b.embedding) AS d FROM {queries} q, base b),
hits AS (
  SELECT uuid, id, d, row_number() OVER (PARTITION BY uuid ORDER BY d, id) AS rank FROM pairs
  QUALIFY rank <= {K})"""


KNN = sql("SELECT uuid, id, round(d, 6) AS distance, rank FROM hits", PRODUCTS, BASE, knn_ctes())

PAIRS = f"""
idp AS (SELECT DISTINCT video_uuid, uuid AS idp_uuid FROM products),
fresh AS (
  SELECT max(timestamp) AS timestamp, uuid AS idp_uuid, offer AS offer_id, min(distance) AS distance
  FROM matched m WHERE timestamp > {SPLIT} AND NOT EXISTS (
    SELECT 1 FROM matched e WHERE e.uuid = m.uuid AND e.offer = m.offer AND e.timestamp <= {SPLIT})
  GROUP BY uuid, offer),
totals AS (
  SELECT video_uuid, count(DISTINCT concat(uuid, '|', offer)) AS total_count
  FROM matched JOIN idp ON idp_uuid = uuid GROUP BY 1)"""

PICTURES = """
nearest AS (
  SELECT uuid AS identified_product_uuid, offer AS offer_id, min(distance) AS distance
  FROM matched GROUP BY 1, 2),
pictures AS (
  SELECT n.*, title, brand, image_link FROM nearest n LEFT JOIN inventory USING (offer_id)),
grouped AS (
  SELECT *, CASE WHEN image_link IS NULL THEN offer_id ELSE first_value(offer_id) OVER w END AS hero_offer_id,
         CASE WHEN image_link IS NULL THEN distance ELSE first_value(distance) OVER w END AS hero_distance,
         CASE WHEN image_link IS NULL THEN title ELSE first_value(title) OVER w END AS hero_title,
         CASE WHEN image_link IS NULL THEN brand ELSE first_value(brand) OVER w END AS hero_brand
  FROM pictures
  WINDOW w AS (PARTITION BY identified_product_uuid, image_link ORDER BY distance, offer_id))"""

REQUEST_STATUS = """
CASE WHEN total_count = 0 THEN 'SUCCESS' WHEN success_count = 0 THEN 'FAILED'
     WHEN success_count < total_count THEN 'PARTIAL_SUCCESS' ELSE 'SUCCESS' END"""

FINISHED = f"""
finished AS (
  SELECT request_uuid, video_uuid, stored, success_count, total_count, {REQUEST_STATUS} AS status,
         total_count > 0 AND success_count > 0 AS counts_as_push
  FROM (SELECT r.request_uuid, video_uuid, r.status AS stored,
               coalesce(success_count, 0) AS success_count, coalesce(total_count, 0) AS total_count
        FROM requests r LEFT JOIN rollup USING (request_uuid)))"""

APPLIED = """
applied AS (
  SELECT video_uuid, d.video_uuid IS NOT NULL AS decided, s.video_uuid IS NOT NULL AS stored, pushed,
         coalesce(active, false) AS active,
         greatest(0, coalesce(approved, 0) + coalesce(delta_approved, 0)) AS approved,
         greatest(0, coalesce(matched, 0) + coalesce(delta_matched, 0)) AS matched
  FROM state_flags s FULL JOIN deltas d USING (video_uuid))"""


def waterfall(active: str, pushed: str, approved: str) -> str:
    return (
        f"CASE WHEN {active} THEN 'Push in Progress' WHEN {pushed} THEN 'Push Complete'"
        f" WHEN {approved} > 0 THEN 'Ready to Push' ELSE 'Needs Review' END"
    )


ORACLES: dict[str, str] = {
    # --- catalog
    "latest_partition": sql("SELECT max(data_date) AS data_date FROM feed", FEED),
    "latest_snapshot": sql(
        f"SELECT data_date, offer_id, title, channel, content_language, {TIES} FROM latest", FEED
    ),
    "snapshot_is_stale": sql(
        """
SELECT 'no table' AS "case", true AS stale
UNION ALL SELECT 'current', NOT (any_value(data_date) IS NOT DISTINCT FROM (SELECT max(data_date) FROM feed)) FROM latest
UNION ALL SELECT 'older', NOT (max(data_date) IS NOT DISTINCT FROM (SELECT max(data_date) FROM feed))
  FROM feed WHERE data_date < DATE '2000-01-01'
UNION ALL SELECT 'empty', NOT (any_value(data_date) IS NOT DISTINCT FROM (SELECT max(data_date) FROM feed))
  FROM feed WHERE offer_id = ''""",
        FEED,
    ),
    "new_products": sql(
        f"""
SELECT offer_id, title, brand, description, product_type, category AS google_product_category,
       CAST(NULL AS VARCHAR) AS age_group, CAST(NULL AS VARCHAR) AS color,
       CAST(NULL AS VARCHAR) AS gender, CAST(NULL AS VARCHAR) AS material,
       CAST(NULL AS VARCHAR) AS pattern, image_link
FROM ({pick("latest", True)}) WHERE NOT EXISTS (SELECT 1 FROM base WHERE id = offer_id)
ORDER BY offer_id LIMIT 1000""",
        FEED,
        BASE,
    ),
    "listing_pick_embed": sql(
        f"SELECT offer_id, channel, content_language, {TIES} FROM ({pick('feed', True)})", FEED
    ),
    "listing_pick_match": sql(
        f"SELECT offer_id, channel, content_language, {TIES} FROM ({pick('feed')})", FEED
    ),
    "product_text": sql(
        r"""
SELECT offer_id, 'Title: ' || title || chr(10) || 'Brand: ' || brand || chr(10)
       || 'Product Category: ' || category || chr(10) || 'Product Type: ' || product_type
       || chr(10) || 'Description: ' || description AS text FROM latest""",
        FEED,
    ),
    "image_links": sql(
        """
SELECT pos, link, count(*) AS listings FROM (
  SELECT 0 AS pos, image_link AS link FROM feed UNION ALL SELECT 1, image_link || '?a' FROM feed
  UNION ALL SELECT 2, image_link || '?b' FROM feed) GROUP BY 1, 2""",
        FEED,
    ),
    # --- vectors and matching
    "l2_normalize": sql(
        """
SELECT id, CAST(pos - 1 AS BIGINT) AS pos, round(embedding[pos] * 3 / (3 * norm), 6) AS x FROM (
  SELECT id, embedding, sqrt(list_inner_product(embedding, embedding)) AS norm,
         unnest(range(1, len(embedding) + 1)) AS pos FROM base)""",
        BASE,
    ),
    "unmatched_identified": sql(
        """SELECT video_uuid, uuid, title FROM products
           WHERE status = 'SUCCESS' AND uuid NOT IN (SELECT uuid FROM matched)""",
        PRODUCTS,
        MATCHED,
    ),
    "knn_match": KNN,
    "knn_match_cells": KNN,
    "ann_match_all_cells": KNN,
    "knn_match_blocks": KNN,
    "knn_match_dirty": sql(
        """
SELECT uuid, id, round(d, 6) AS distance, rank FROM hits""",
        PRODUCTS,
        """
clean AS (SELECT * FROM products WHERE description NOT IN ('label 0', 'label 1', 'label 2'))""",
        """
base AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS embedding
         FROM embeddings WHERE label > 2)""",
        knn_ctes("clean"),
    ),
    "ann_recall": sql(
        "SELECT uuid, round(max(d), 6) AS kth_distance, true AS recall_ok FROM hits GROUP BY uuid", PRODUCTS, BASE, knn_ctes()
    ),
    "vector_index_cells": """
SELECT count(*) AS stored, count(DISTINCT vec_id) AS ids, count(*) AS counted FROM embeddings""",
    "match_catalog_join": sql(
        f"""
SELECT m.uuid, m.offer AS matched_product_offer_id, m.timestamp, round(m.distance, 6) AS distance,
       p.title AS matched_product_title, p.brand AS matched_product_brand
FROM matched m JOIN ({pick("latest")}) p ON p.offer_id = m.offer""",
        FEED,
        MATCHED,
    ),
    "match_not_existing": sql(
        f"""
SELECT uuid, offer AS matched_product_offer_id, timestamp, round(distance, 6) AS distance
FROM matched m WHERE timestamp >= {SPLIT} AND NOT EXISTS (
  SELECT 1 FROM matched e WHERE e.uuid = m.uuid AND e.offer = m.offer AND e.timestamp < {SPLIT})""",
        MATCHED,
    ),
    "match_new_products_flow": sql(
        f"""
SELECT {LATER} AS timestamp, h.uuid, q.title AS identified_product_title,
       q.description AS identified_product_description, h.id AS matched_product_offer_id,
       p.title AS matched_product_title, p.brand AS matched_product_brand, round(d, 6) AS distance
FROM hits h JOIN open q ON q.uuid = h.uuid JOIN ({pick("latest")}) p ON p.offer_id = h.id
WHERE NOT EXISTS (SELECT 1 FROM matched e WHERE e.uuid = h.uuid AND e.offer = h.id)""",
        FEED,
        PRODUCTS,
        BASE,
        MATCHED,
        "open AS (SELECT * FROM products WHERE status = 'SUCCESS' AND uuid NOT IN (SELECT uuid FROM matched))",
        knn_ctes("open"),
    ),
    "variant_heroes": sql(
        """
SELECT identified_product_uuid, image_link, hero_offer_id, hero_title, hero_brand,
       round(hero_distance, 6) AS hero_distance, count(*) AS variant_count
FROM grouped WHERE image_link IS NOT NULL GROUP BY ALL""",
        MATCHED,
        INVENTORY,
        PICTURES,
    ),
    "variant_groups": sql(
        """
SELECT identified_product_uuid, image_link, hero_offer_id, round(hero_distance, 6) AS hero_distance,
       offer_id AS variant_offer_id, title AS variant_title, brand AS variant_brand FROM grouped""",
        MATCHED,
        INVENTORY,
        PICTURES,
    ),
    "match_dedupe": sql(
        """SELECT uuid AS identified_product_uuid, offer AS offer_id, round(min(distance), 6) AS distance
           FROM matched GROUP BY 1, 2""",
        MATCHED,
    ),
    # --- analysis
    "json_ingest_identified": """
SELECT conv_id || '-' || turn AS video_uuid, CAST(0 AS BIGINT) AS pos, role AS title,
       text AS description, CAST(turn * 60000 + 16016 AS BIGINT) AS video_timestamp
FROM conversations""",
    "build_video_analysis": """
SELECT conv_id || '-' || turn AS uuid, 'google_ads' AS source, 'SUCCESS' AS status, 't' AS title,
       CAST(1 AS BIGINT) AS products, role AS first_title, CAST(32 AS BIGINT) AS dim,
       CAST(turn * 60000 + 16016 AS BIGINT) AS video_timestamp
FROM conversations""",
    "identified_text": """
SELECT doc_id, 'Title: ' || source || chr(10) || CASE WHEN text = '' THEN '' ELSE
       'Description: ' || text || chr(10) END || 'Category: ' || lang AS text FROM documents""",
    "identified_rows": sql(
        """SELECT video_uuid, uuid AS idp_uuid, title, description, '' AS relevance_reasoning,
                  video_timestamp, timestamp FROM products""",
        PRODUCTS,
    ),
    "video_rows": sql(
        """
SELECT video_uuid, 'yt-' || n AS video_id, 'google_ads' AS source, timestamp, 'Video ' || n AS title,
       '' AS description, stats_identified_count, unnest(['video', CAST(n AS VARCHAR), 'yt-' || n]) AS keyword
FROM (SELECT video_uuid, n, timestamp, count(*) AS stats_identified_count FROM products GROUP BY ALL)""",
        PRODUCTS,
    ),
    # --- sync
    "incremental_filter": sql(
        f"""SELECT timestamp, uuid, offer AS matched_product_offer_id FROM matched
            WHERE timestamp > {SPLIT} ORDER BY timestamp""",
        MATCHED,
    ),
    "match_video_join": sql(
        """SELECT m.uuid AS idp_uuid, video_uuid, offer AS matched_product_offer_id, m.timestamp,
                  round(distance, 6) AS distance FROM matched m JOIN products p ON p.uuid = m.uuid""",
        MATCHED,
        PRODUCTS,
    ),
    "first_seen_matches": sql(
        "SELECT timestamp, idp_uuid, offer_id, round(distance, 6) AS distance FROM fresh",
        MATCHED,
        PRODUCTS,
        PAIRS,
    ),
    "delta_matches": sql(
        """SELECT timestamp, idp_uuid, offer_id, round(distance, 6) AS distance, video_uuid
           FROM fresh JOIN idp USING (idp_uuid)""",
        MATCHED,
        PRODUCTS,
        PAIRS,
    ),
    "video_match_totals": sql("SELECT * FROM totals", MATCHED, PRODUCTS, PAIRS),
    "sync_matches": sql(
        """SELECT timestamp, idp_uuid, offer_id, round(distance, 6) AS distance, video_uuid, total_count
           FROM fresh JOIN idp USING (idp_uuid) JOIN totals USING (video_uuid)""",
        MATCHED,
        PRODUCTS,
        PAIRS,
    ),
    "safe_watermark": sql(
        """SELECT timestamp, coalesce(lag(timestamp) OVER (ORDER BY timestamp),
                  TIMESTAMP '2023-12-31 00:00:00') AS safe_mark
           FROM (SELECT DISTINCT timestamp FROM matched)""",
        MATCHED,
    ),
    "active_offers": sql(
        "SELECT offer AS offer_id FROM matched WHERE offer IS NOT NULL UNION SELECT offer_id FROM inventory",
        MATCHED,
        INVENTORY,
    ),
    "sync_inventory": sql(
        f"""SELECT offer_id, title, brand, image_link, availability, price FROM ({pick("latest")})
            WHERE offer_id IN (SELECT offer FROM matched UNION SELECT offer_id FROM inventory)""",
        FEED,
        MATCHED,
        INVENTORY,
    ),
    "upsert_merge": sql(
        f"""
SELECT offer_id, CASE WHEN p.offer_id IS NULL THEN i.title
                      WHEN p.channel = 'ONLINE' THEN p.title END AS title,
       i.brand, i.image_link, coalesce(p.availability, i.availability) AS availability, i.price
FROM inventory i FULL JOIN ({pick("latest")}) p USING (offer_id)""",
        FEED,
        INVENTORY,
    ),
    # --- videos and search
    "search_keywords": sql("SELECT video_uuid, unnest(keywords) AS keyword FROM videos", VIDEOS),
    "keyword_filter": sql(f"SELECT video_uuid, source FROM videos WHERE {FOUND}", VIDEOS),
    "summary_page": sql(
        f"""
SELECT video_uuid, video_id, source, timestamp, stats_identified_count,
       CAST(0 AS BIGINT) AS stats_matched_count, status,
       (SELECT count(*) FROM videos WHERE status = 'Needs Review' AND {FOUND}) AS total_count
FROM videos WHERE status = 'Needs Review' AND {FOUND}
ORDER BY timestamp DESC, video_uuid LIMIT 25 OFFSET 5""",
        VIDEOS,
    ),
    "summary_count": sql(
        f"SELECT count(*) AS total_count FROM videos WHERE status = 'Needs Review' AND {FOUND}", VIDEOS
    ),
    "candidates_inventory": sql(
        """
SELECT video_uuid, identified_product_uuid, offer_id,
       CASE WHEN i.offer_id IS NULL THEN 'Unknown' ELSE title END AS title,
       CASE WHEN i.offer_id IS NULL THEN '' ELSE brand END AS brand, image_link, availability,
       modified_timestamp AS matched_timestamp, round(distance, 6) AS distance, candidate_status,
       is_added_by_user, "user"
FROM candidates c LEFT JOIN inventory i USING (offer_id)""",
        REVIEWS,
        INVENTORY,
    ),
    "video_detail": sql(
        """
SELECT p.video_uuid, 'google_ads' AS source, 'yt-' || n AS video_id, 'Video ' || n AS video_title,
       p.uuid AS idp_uuid, p.title, video_timestamp, c.offer_id AS matched_offer_id,
       CASE WHEN c.offer_id IS NULL THEN NULL WHEN i.offer_id IS NULL THEN 'Unknown' ELSE i.title END AS matched_title,
       CASE WHEN c.offer_id IS NULL THEN NULL WHEN i.offer_id IS NULL THEN '' ELSE i.brand END AS matched_brand,
       candidate_status AS matched_candidate_status, "user" AS matched_user,
       modified_timestamp AS matched_matched_timestamp, round(distance, 6) AS matched_distance
FROM products p LEFT JOIN candidates c ON c.identified_product_uuid = p.uuid AND c.video_uuid = p.video_uuid
LEFT JOIN inventory i ON i.offer_id = c.offer_id""",
        PRODUCTS,
        REVIEWS,
        INVENTORY,
    ),
    "video_detail_nested": sql(
        """
SELECT p.video_uuid, p.uuid AS idp_uuid, count(c.offer_id) AS matches,
       round(coalesce(sum(distance), 0), 6) AS distance_sum
FROM products p LEFT JOIN candidates c ON c.identified_product_uuid = p.uuid AND c.video_uuid = p.video_uuid
GROUP BY 1, 2""",
        PRODUCTS,
        REVIEWS,
    ),
    "hide_no_matches": sql(
        """SELECT video_uuid, uuid AS idp_uuid, title FROM products p WHERE EXISTS (
             SELECT 1 FROM candidates c WHERE c.identified_product_uuid = p.uuid AND c.video_uuid = p.video_uuid)""",
        PRODUCTS,
        REVIEWS,
    ),
    # --- review
    "last_write_wins": sql(
        "SELECT video_uuid, identified_product_uuid, offer_id, candidate_status, position FROM decisions",
        REVIEWS,
    ),
    "candidate_deltas": sql("SELECT * FROM deltas", REVIEWS, DELTAS),
    "apply_candidates": sql(
        f"""
SELECT video_uuid, approved AS stats_approved_count, matched AS stats_matched_count,
       CASE WHEN decided THEN {waterfall("active", "coalesce(pushed, false)", "approved")}
            ELSE 'Needs Review' END AS status, pushed AS has_successful_push
FROM applied""",
        REVIEWS,
        DELTAS,
        APPLIED,
    ),
    "apply_candidates_rows": sql(
        f"""
SELECT video_uuid, identified_product_uuid, offer_id, round(c.distance, 6) AS distance,
       coalesce(d.candidate_status, c.candidate_status) AS candidate_status,
       coalesce(d."user", c."user") AS "user",
       coalesce(d.is_added_by_user, c.is_added_by_user) AS is_added_by_user,
       CASE WHEN d.offer_id IS NULL THEN c.modified_timestamp ELSE {LATER} END AS modified_timestamp
FROM candidates c FULL JOIN decisions d USING (video_uuid, identified_product_uuid, offer_id)""",
        REVIEWS,
    ),
    "user_added_product": sql(
        """
SELECT offer_id, CASE WHEN u.offer_id IS NULL THEN i.title ELSE 'User Product ' || u.offer_id END AS title,
       brand, image_link, CASE WHEN u.offer_id IS NULL THEN i.availability ELSE 'in stock' END AS availability, price
FROM inventory i FULL JOIN (SELECT DISTINCT offer_id FROM decisions WHERE is_added_by_user) u USING (offer_id)""",
        REVIEWS,
        INVENTORY,
    ),
    "recount": sql(
        "SELECT video_uuid, approved AS stats_approved_count, matched AS stats_matched_count FROM states",
        REVIEWS,
    ),
    "approved_flatten": sql(
        """SELECT video_uuid, identified_product_uuid, offer_id FROM candidates
           WHERE candidate_status = 'APPROVED'""",
        REVIEWS,
    ),
    "video_status_rule": sql(
        f"SELECT video_uuid, {waterfall('active', 'pushed', 'approved')} AS status FROM state_flags",
        REVIEWS,
    ),
    # --- publication
    "submission_requests": sql(
        f"""SELECT request_uuid, video_uuid, submitting_user, 'PENDING' AS status, {AS_OF} AS timestamp,
                   array_to_string(list_sort(ids), ',') AS offer_ids FROM subs""",
        SUBMISSIONS,
    ),
    "submission_expand": sql(
        """SELECT request_uuid, customer_id, campaign_id, ad_group_id, offer_id, 'PENDING' AS status,
                  cpc_bid_micros, CAST(NULL AS VARCHAR) AS error_message FROM offer_rows""",
        SUBMISSIONS,
    ),
    "submission_pushes": sql(
        """SELECT 'video-' || s_suppkey AS video_uuid,
                  CASE WHEN count(request_uuid) > 0 THEN 'Push in Progress' ELSE 'Needs Review' END AS status,
                  count(request_uuid) AS running
           FROM supplier LEFT JOIN subs ON video_uuid = 'video-' || s_suppkey GROUP BY s_suppkey""",
        SUBMISSIONS,
    ),
    "work_batch": sql(
        f"""
SELECT request_uuid, status, timestamp, CAST(0 AS BIGINT) AS stage FROM (
  SELECT * FROM requests WHERE status = 'PROCESSING' AND leased_at < {AS_OF} - INTERVAL 2 HOUR
  ORDER BY leased_at, request_uuid LIMIT 5)
UNION ALL SELECT request_uuid, status, timestamp, 1 FROM (
  SELECT * FROM requests WHERE status = 'PENDING' ORDER BY timestamp, request_uuid LIMIT 5)""",
        REQUESTS,
    ),
    "lease_eligible": sql(
        f"""SELECT request_uuid, status, leased_at FROM requests WHERE status = 'PENDING'
            OR (status = 'PROCESSING' AND leased_at < {AS_OF} - INTERVAL 2 HOUR)""",
        REQUESTS,
    ),
    "tree_state": sql("SELECT * FROM tree", LISTING),
    "listing_tree_children": sql(
        "SELECT ad_group_id, parent, resource_name, product_item_id, root_type FROM children", LISTING
    ),
    "append_existing_check": sql(
        "SELECT ad_group_id, offer_id, position, present AS is_present FROM planned", LISTING
    ),
    "listing_ops": sql("SELECT * REPLACE (CAST(step AS BIGINT) AS step) FROM ops", LISTING),
    "op_count_guard": sql("SELECT * FROM guard", LISTING),
    "offer_outcomes": sql(
        f"""
SELECT ad_group_id, offer_id, position,
       CASE WHEN mode = 'ERROR' THEN 'FAILED' WHEN NOT adds THEN 'ALREADY_PRESENT'
            WHEN failed THEN 'FAILED' ELSE 'SUCCESS' END AS status
FROM (SELECT a.*, mode = 'ERROR' OR coalesce(overflow, false)
             OR (g.ad_group_id IS NOT NULL AND s_acctbal > 5000) AS failed
      FROM acted a LEFT JOIN guard g USING (ad_group_id)
      JOIN supplier ON s_suppkey = a.ad_group_id)
WHERE NOT (failed AND mode <> 'ERROR' AND adds AND copies > 1)""",
        LISTING,
    ),
    "unhandled_failed": sql(
        "SELECT ad_group_id, offer_id, position, 'FAILED' AS status FROM planned WHERE NOT present",
        LISTING,
    ),
    "deployment_updates": sql(
        """
SELECT request_uuid, ad_group_id, offer_id, status,
       CASE WHEN status = 'FAILED' THEN 'Fatal: ' || coalesce(error_message, 'Mutate operation failed')
       END AS error_message, status = 'FAILED' AS error_given FROM outcomes""",
        OUTCOMES,
    ),
    "offers_map_update": sql(
        """
SELECT o.request_uuid, o.ad_group_id, o.offer_id, coalesce(r.status, 'PENDING') AS status, o.cpc_bid_micros,
       CASE WHEN r.status = 'FAILED' THEN 'Fatal: Mutate operation failed' END AS error_message
FROM offer_rows o LEFT JOIN (
  SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS request_uuid,
         l_suppkey AS ad_group_id, CAST(l_partkey AS VARCHAR) AS offer_id,
         CASE WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM lineitem) r
USING (request_uuid, ad_group_id, offer_id)""",
        SUBMISSIONS,
    ),
    "entity_status_counts": sql(
        """
SELECT request_uuid, ad_group_id, count(*) FILTER (WHERE status = 'SUCCESS') AS success_count,
       CAST(0 AS BIGINT) AS pending_count,
       count(*) FILTER (WHERE status = 'ALREADY_PRESENT') AS already_present_count,
       count(*) FILTER (WHERE status = 'FAILED') AS failed_count FROM outcomes GROUP BY 1, 2""",
        OUTCOMES,
    ),
    "request_success_counts": sql("SELECT * FROM rollup", OUTCOMES),
    "request_status_rollup": sql(
        """SELECT request_uuid, video_uuid, success_count, total_count, status,
                  CAST(NULL AS VARCHAR) AS error_message, counts_as_push FROM finished""",
        REQUESTS,
        OUTCOMES,
        FINISHED,
    ),
    "finalize_requests": sql(
        f"""
SELECT request_uuid, CASE WHEN stored = 'PENDING' THEN 'FAILED' ELSE status END AS status,
       CASE WHEN stored = 'PENDING' THEN 'Critical Worker Fail: lost' END AS error_message,
       CASE WHEN stored <> 'PENDING' THEN {AS_OF} END AS completed_at,
       CASE WHEN stored = 'PENDING' THEN {AS_OF} END AS failed_at FROM finished""",
        REQUESTS,
        OUTCOMES,
        FINISHED,
    ),
    "video_push_finalize": sql(
        f"""
SELECT video_uuid, coalesce(success, false) AS has_successful_push,
       CASE WHEN success IS NULL THEN 'Push in Progress' ELSE
       {waterfall("running > 0", "success", "approved")} END AS status
FROM (SELECT 'video-' || c_custkey AS video_uuid, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS approved
      FROM customer)
LEFT JOIN (SELECT video_uuid, bool_or(counts_as_push) FILTER (WHERE stored <> 'PENDING') AS success,
                  count(*) FILTER (WHERE stored = 'PENDING') AS running
           FROM finished GROUP BY 1) USING (video_uuid)""",
        REQUESTS,
        OUTCOMES,
        FINISHED,
    ),
    "request_status_rule": """
SELECT status, counts_as_push, count(*) AS lines FROM (
  SELECT CASE WHEN error THEN 'FAILED' WHEN total = 0 THEN 'SUCCESS' WHEN success = 0 THEN 'FAILED'
              WHEN success < total THEN 'PARTIAL_SUCCESS' ELSE 'SUCCESS' END AS status,
         NOT error AND total > 0 AND success > 0 AS counts_as_push
  FROM (SELECT least(l_linenumber - 1, l_linenumber % 4) AS success, l_linenumber % 4 AS total,
               l_returnflag = 'R' AS error FROM lineitem)) GROUP BY 1, 2""",
    "request_page": sql(
        """SELECT request_uuid, video_uuid, submitting_user, status, timestamp,
                  (SELECT count(*) FROM requests) AS total_count
           FROM requests ORDER BY timestamp DESC, request_uuid LIMIT 50 OFFSET 10""",
        REQUESTS,
    ),
    "user_filter": sql(
        "SELECT request_uuid, submitting_user FROM requests WHERE submitting_user = 'user-7'", REQUESTS
    ),
    "requests_deployments": sql(
        """SELECT request_uuid, status, timestamp, customer_id, campaign_id, ad_group_id
           FROM requests LEFT JOIN entities USING (request_uuid)""",
        REQUESTS,
        ENTITIES,
    ),
    "requests_nested": sql(
        """SELECT request_uuid, count(ad_group_id) AS entities
           FROM requests LEFT JOIN entities USING (request_uuid) GROUP BY 1""",
        REQUESTS,
        ENTITIES,
    ),
    "video_request_status": sql(
        f"""
SELECT d.request_uuid, d.video_uuid, CASE WHEN s.submitting_user <> 'R' THEN s.submitting_user END AS submitting_user,
       CASE WHEN s.submitting_user <> 'R' THEN 'PENDING' ELSE 'PROCESSING' END AS status,
       CASE WHEN s.submitting_user <> 'R' THEN {AS_OF} ELSE TIMESTAMP '2002-01-01 00:00:00' END AS timestamp,
       d.entities, d.offers
FROM (SELECT request_uuid, video_uuid, count(*) AS entities,
             CAST(sum(len(list_distinct(ids))) AS BIGINT) AS offers FROM deployments GROUP BY 1, 2) d
JOIN subs s USING (request_uuid)""",
        SUBMISSIONS,
    ),
    "video_for_request": sql(
        """SELECT request_uuid, r.video_uuid, v.video_id, v.source FROM requests r
           LEFT JOIN (SELECT 'video-' || doc_id AS video_uuid, 'vid-' || doc_id AS video_id, source
                      FROM documents) v USING (video_uuid)""",
        REQUESTS,
    ),
    "inserted_offers": sql(
        """SELECT DISTINCT 'video-' || ad_group_id AS video_uuid, offer_id FROM outcomes
           WHERE status = 'SUCCESS'""",
        OUTCOMES,
    ),
    "ads_entity_enrichment": sql(
        """
SELECT request_uuid, customer_id, ad_group_id, g.customer_name, g.campaign_name, g.ad_group_name
FROM entities LEFT JOIN (SELECT * FROM ad_groups WHERE customer_id <> 0 AND ad_group_id <> 0) g
USING (customer_id, ad_group_id)""",
        ENTITIES,
    ),
    "ad_groups_by_customer": sql(
        """SELECT DISTINCT customer_id, ad_group_id FROM entities
           WHERE customer_id <> 0 AND ad_group_id <> 0""",
        ENTITIES,
    ),
    "previous_destinations": sql(
        """
SELECT video_uuid,
       CASE WHEN g.ad_group_id IS NULL THEN CAST(customer_id AS VARCHAR)
            ELSE g.customer_name || ' (' || customer_id || ')' END AS account,
       CAST(campaign_id AS VARCHAR) AS campaign,
       CASE WHEN g.ad_group_id IS NULL THEN CAST(ad_group_id AS VARCHAR)
            ELSE g.ad_group_name || ' (' || ad_group_id || ')' END AS ad_group
FROM (SELECT r.video_uuid, e.* FROM entities e JOIN requests r USING (request_uuid)
      WHERE r.status <> 'PENDING'
      QUALIFY row_number() OVER (PARTITION BY video_uuid, customer_id, ad_group_id
                                 ORDER BY timestamp DESC, request_uuid, campaign_id) = 1) f
LEFT JOIN (SELECT * FROM ad_groups WHERE customer_id <> 0 AND ad_group_id <> 0) g
USING (customer_id, ad_group_id)""",
        REQUESTS,
        ENTITIES,
    ),
    # --- accounts and intake
    "account_fanout": "SELECT c_custkey + 1000 AS customer_id FROM customer",
    "sub_accounts": sql(
        """
SELECT customer_id, manager, CAST(CASE WHEN parent_id = 1 THEN 1 WHEN manager THEN 2 ELSE 3 END AS BIGINT) AS level
FROM accounts WHERE parent_id IS NOT NULL""",
        ACCOUNTS,
    ),
    "accessible_accounts": sql(
        """SELECT customer_id, descriptive_name, manager, customer_id = 1004 AS is_platform_customer_id
           FROM accounts WHERE customer_id IN (SELECT c_custkey * 2 + 1000 FROM customer)""",
        ACCOUNTS,
    ),
    "account_search": sql(
        """SELECT customer_id, descriptive_name FROM accounts
           WHERE lower(descriptive_name) LIKE '%#00000001%'
              OR CAST(customer_id AS VARCHAR) LIKE '%#00000001%'""",
        ACCOUNTS,
    ),
    "campaigns_active": sql(
        """SELECT * FROM campaigns WHERE status <> 'REMOVED' AND advertising_channel_type = 'DEMAND_GEN'
           ORDER BY campaign_id DESC""",
        CAMPAIGNS,
    ),
    "ads_video_scan": sql(
        """SELECT DISTINCT 'google_ads' AS source, video_id FROM video_ads
           WHERE advertising_channel_type = 'DEMAND_GEN'
             AND customer_id IN (SELECT c_custkey + 1000 FROM customer)""",
        CAMPAIGNS,
    ),
    "account_video_counts": sql(
        """SELECT customer_id, count(DISTINCT video_id) AS videos FROM video_ads
           WHERE advertising_channel_type = 'DEMAND_GEN'
             AND customer_id IN (SELECT customer_id FROM accounts) GROUP BY 1""",
        CAMPAIGNS,
        ACCOUNTS,
    ),
    "ad_groups_with_video": sql(
        """SELECT customer_id, campaign_id, ad_group_id, video_id FROM video_ads
           WHERE video_id = 'vid-7' AND advertising_channel_type = 'DEMAND_GEN'""",
        CAMPAIGNS,
    ),
    "destination_discovery": sql(
        """SELECT DISTINCT customer_id, campaign_id, ad_group_id, campaign_name, ad_group_name
           FROM video_ads WHERE video_id = 'vid-7' AND advertising_channel_type = 'DEMAND_GEN'""",
        CAMPAIGNS,
    ),
    "scan_processed_videos": sql(
        """SELECT video_id, CAST(NULL AS VARCHAR) AS gcs_uri FROM processed
           UNION SELECT NULL, gcs_uri FROM files""",
        CANDIDATE_VIDEOS,
    ),
    "first_seen_dedupe": sql(
        """SELECT source, video_id, gcs_uri, CAST(source_rank AS BIGINT) AS source_rank, position
           FROM first_seen""",
        CANDIDATE_VIDEOS,
    ),
    "unprocessed_videos": sql(
        """
SELECT f.source, video_id, gcs_uri, coalesce(i.title, f.title) AS title, i.description, position
FROM first_seen f LEFT JOIN info i USING (video_id)
WHERE (video_id IS NULL OR video_id NOT IN (SELECT video_id FROM processed))
  AND coalesce(privacy, 'public') = 'public'""",
        CANDIDATE_VIDEOS,
    ),
    "limit_videos": sql(
        """
SELECT f.source, video_id, coalesce(i.title, f.title) AS title, position
FROM first_seen f LEFT JOIN info i USING (video_id)
WHERE (video_id IS NULL OR video_id NOT IN (SELECT video_id FROM processed)) AND coalesce(privacy, 'public') = 'public'
ORDER BY source_rank, position LIMIT 10""",
        CANDIDATE_VIDEOS,
    ),
    # --- scalar functions and validation
    "video_uuid": sql(
        """
SELECT position, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
       || format('{:x}', (CAST('0x' || substr(h, 17, 2) AS INTEGER) & 63) | 128) || substr(h, 19, 2)
       || '-' || substr(h, 21, 12) AS uuid
FROM (SELECT position, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8')
                            || encode(gcs_uri || md5_hash)) AS h FROM files)""",
        CANDIDATE_VIDEOS,
    ),
    "video_ms": """
SELECT p_partkey, CAST(p_size * 3600000 + 7 * 60000
       + CAST(p_retailprice / 100 AS DECIMAL(16,3)) * 1000 AS BIGINT) AS ms FROM part""",
    "split_gcs_uri": sql(
        r"""
SELECT position, gcs_uri, CASE WHEN ok THEN regexp_extract(gcs_uri, '^(?:gs://)?([a-z0-9._-]+)/(.+)$', 1) END AS bucket,
       CASE WHEN ok THEN regexp_extract(gcs_uri, '^(?:gs://)?([a-z0-9._-]+)/(.+)$', 2) END AS path
FROM (SELECT *, regexp_matches(gcs_uri, '^(?:gs://)?([a-z0-9._-]+)/(.+)$') AS ok FROM files)""",
        CANDIDATE_VIDEOS,
    ),
    "md5_base64_to_hex": "SELECT page_id, md5(html) AS md5 FROM pages",
    "normalize_customer_id": """
SELECT c_custkey, CASE WHEN c_custkey = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS from_number,
       substr(c_name, 10, 3) || substr(c_name, 13, 6) AS from_text FROM customer""",
    "brand_prefix": """
SELECT p_partkey, at_start, CASE WHEN at_start THEN substr(title, 1, length(p_brand)) ELSE '' END AS brand_part,
       CASE WHEN at_start THEN substr(title, length(p_brand) + 1) ELSE title END AS title_rest
FROM (SELECT *, starts_with(lower(title), lower(p_brand)) AS at_start
      FROM (SELECT *, CASE WHEN p_size > 25 THEN upper(p_brand) || ' ' || p_name ELSE p_name END AS title FROM part))""",
    "video_title": """
SELECT page_id, CASE WHEN contains(url, '/fr/') THEN 'French page'
                     WHEN length(url) > 40 THEN split_part(url, '/', -1)
                     WHEN length(html) > 5000 THEN 'vid-' || page_id
                     ELSE CAST(page_id AS VARCHAR) END AS title FROM pages""",
    "parse_strategy": """
SELECT CASE WHEN l_returnflag = 'N' THEN 'PURGE' ELSE 'PRESERVE' END AS strategy, l_returnflag,
       count(*) AS lines FROM lineitem GROUP BY 1, 2""",
    "join_error_messages": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_returnflag = l_linestatus THEN l_returnflag
            ELSE l_returnflag || '; ' || l_linestatus END AS message FROM lineitem""",
    "cpc_micros": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_discount <> 0 THEN CAST(trunc(l_discount * 1e6) AS BIGINT) END AS cpc_micros
FROM lineitem""",
    "valid_video": sql(
        """
SELECT video_id, gcs_uri, CASE WHEN gcs_uri IS NOT NULL AND length(gcs_uri) <= 40
       THEN 'NO_VIDEO_ID_OR_FILE' END AS reject_reason
FROM united""",
        CANDIDATE_VIDEOS,
    ),
    "typed_rules": sql(
        """
SELECT video_uuid, identified_product_uuid, offer_id,
       CASE WHEN is_added_by_user THEN 'unknown candidate_status' ELSE 'distance must be >= 0' END AS reject_reason
FROM candidates WHERE is_added_by_user OR distance - 0.001 < 0""",
        REVIEWS,
    ),
    "valid_deployment": sql(
        """
SELECT request_uuid, ad_group_id, campaign_id,
       CASE WHEN ad_group_id = 0 THEN 'missing ad group' ELSE 'missing campaign' END AS reject_reason
FROM deployments WHERE ad_group_id = 0 OR campaign_id = 0""",
        SUBMISSIONS,
    ),
    "to_json_rows": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
    # --- single operators
    "filter_success": sql(
        "SELECT DISTINCT video_uuid AS uuid, status, timestamp FROM products WHERE status = 'SUCCESS'",
        PRODUCTS,
    ),
    "flatten_metadata": sql(
        """SELECT video_uuid AS uuid, 'Video ' || n AS title, CAST(NULL AS VARCHAR) AS description,
                  count(*) AS identified FROM products GROUP BY video_uuid, n""",
        PRODUCTS,
    ),
    "unnest_identified": sql("SELECT video_uuid, uuid, title FROM products", PRODUCTS),
    "drop_stub_videos": """
SELECT CAST(doc_id AS VARCHAR) AS video_uuid, CASE WHEN lang = 'en' THEN source ELSE 'youtube' END AS source,
       'vid-' || doc_id AS video_id FROM documents WHERE lang <> 'de'""",
    "summary_status_filter": """
SELECT CAST(doc_id AS VARCHAR) AS video_uuid, 'Push Complete' AS status FROM documents WHERE lang = 'fr'""",
    "affected_videos": sql(
        """SELECT * FROM totals WHERE video_uuid IN (
             SELECT video_uuid FROM fresh JOIN idp USING (idp_uuid))""",
        MATCHED,
        PRODUCTS,
        PAIRS,
    ),
    "distinct_offers": sql(
        "SELECT DISTINCT offer AS offer_id FROM matched WHERE offer IS NOT NULL", MATCHED
    ),
    "offer_in_list": sql(
        f"SELECT offer_id, data_date, {TIES} FROM feed WHERE offer_id IN (SELECT offer FROM matched)",
        FEED,
        MATCHED,
    ),
    "candidates_to_identified": sql(
        """
SELECT p.video_uuid, p.uuid AS idp_uuid, p.title, p.video_timestamp, c.offer_id AS matched_offer_id,
       c.candidate_status AS matched_candidate_status
FROM products p LEFT JOIN candidates c ON c.identified_product_uuid = p.uuid AND c.video_uuid = p.video_uuid""",
        PRODUCTS,
        REVIEWS,
    ),
    "knn_rank": sql(
        """
SELECT uuid, offer AS matched_product_offer_id, timestamp, round(distance, 6) AS distance,
       row_number() OVER (PARTITION BY uuid ORDER BY distance, timestamp) AS rank
FROM matched QUALIFY rank <= 3""",
        MATCHED,
    ),
    "request_detail": sql(
        """
SELECT r.request_uuid, r.video_uuid, r.status, v.video_id, e.ad_group_id
FROM requests r LEFT JOIN entities e USING (request_uuid)
LEFT JOIN (SELECT 'video-' || doc_id AS video_uuid, 'vid-' || doc_id AS video_id FROM documents) v
USING (video_uuid) WHERE r.request_uuid = '7'""",
        REQUESTS,
        ENTITIES,
    ),
    "entity_defaults": sql(
        """SELECT request_uuid, CASE WHEN customer_id > 10 THEN customer_id ELSE 0 END AS customer_id,
                  campaign_id, ad_group_id, CAST(0 AS BIGINT) AS offers FROM entities""",
        ENTITIES,
    ),
    "ad_groups_active": """
SELECT l_suppkey AS ad_group_id, l_orderkey AS campaign_id, 'ENABLED' AS status FROM lineitem
WHERE l_orderkey = 7 AND l_returnflag <> 'R'""",
    "exclude_managers": sql(
        "SELECT customer_id, manager FROM accounts WHERE NOT manager", ACCOUNTS
    ),
    "public_only": sql(
        """
SELECT u.source, video_id, gcs_uri, CASE WHEN privacy IS NULL THEN u.title ELSE i.title END AS title,
       i.description, position
FROM united u LEFT JOIN info i USING (video_id) WHERE coalesce(privacy, 'public') = 'public'""",
        CANDIDATE_VIDEOS,
    ),
    "video_sources_union": sql(
        """SELECT source, CAST(source_rank AS BIGINT) AS source_rank, count(*) AS videos
           FROM united GROUP BY ALL""",
        CANDIDATE_VIDEOS,
    ),
    "valid_product": sql(
        f"SELECT offer_id, 'description is required' AS reject_reason, {TIES} FROM feed WHERE channel <> 'ONLINE'",
        FEED,
    ),
    "valid_numbers": """
SELECT s_suppkey, s_acctbal, 's_acctbal must be >= 0' AS reject_reason FROM supplier WHERE s_acctbal < 0""",
    "euclidean_distance": sql(
        "SELECT id, round(list_distance(embedding, list_reverse(embedding)), 6) AS distance FROM base",
        BASE,
    ),
    "search_tokens": r"""
SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, tokens[pos] AS token FROM (
  SELECT doc_id, tokens, unnest(range(1, len(tokens) + 1)) AS pos FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}]+'), lambda x: x <> '') AS tokens
    FROM documents))""",
    "split_offer_ids": """
SELECT page_id, len(string_split(' x,' || url || ',,a', ',')) AS with_blank,
       array_to_string(list_sort(list_filter(string_split('x,' || url || ',,a', ','), lambda x: x <> '')), ',') AS sorted
FROM pages""",
    "key_prefixes": """
SELECT 'prod_' || p_partkey AS key, CAST(p_partkey AS VARCHAR) AS offer_id, 'prod_' || p_partkey AS other
FROM part""",
    # --- functions over whole tables
    "idp_uuid": """
SELECT video_uuid, CAST(0 AS BIGINT) AS pos, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
       || format('{:x}', (CAST('0x' || substr(h, 17, 2) AS INTEGER) & 63) | 128) || substr(h, 19, 2)
       || '-' || substr(h, 21, 12) AS uuid
FROM (SELECT conv_id || '-' || turn AS video_uuid,
             sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(conv_id || '-' || turn || '#0')) AS h
      FROM conversations)""",
    "active_push_add": f"""
SELECT o_orderkey, 'F' AS request, {AS_OF} AS started FROM orders
UNION ALL SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS TIMESTAMP) FROM orders
WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'F'""",
    "active_push_remove": """
SELECT o_orderkey, o_orderstatus AS request, CAST(o_orderdate AS TIMESTAMP) AS started FROM orders
WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'F'""",
    "epoch_default": """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')
       ELSE '0001-01-01 00:00:00' END AS mark FROM orders""",
    "utc_seconds": """
SELECT o_orderkey, CAST(now() AS TIMESTAMP) > CAST(o_orderdate AS TIMESTAMP) AS is_later, true AS is_whole FROM orders""",
    "init_counter": """
SELECT CAST(doc_id AS VARCHAR) AS video_uuid, CAST(0 AS BIGINT) AS matched, CAST(n_chars AS BIGINT) AS identified
FROM documents""",
    "exclude_embedding": sql(
        """
SELECT video_uuid, title, description, CAST(NULL AS VARCHAR) AS color_pattern_style_usage,
       CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS subcategory, video_timestamp,
       CAST(NULL AS VARCHAR) AS relevance_reasoning, uuid FROM products""",
        PRODUCTS,
    ),
    "project_except_rn": sql(
        """
SELECT uuid, offer AS matched_product_offer_id, timestamp, round(distance, 6) AS distance FROM matched
QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY distance, timestamp) = 1""",
        MATCHED,
    ),
    "unique_videos": sql(
        """SELECT count(DISTINCT video_id) AS videos FROM video_ads
           WHERE advertising_channel_type = 'DEMAND_GEN'
             AND customer_id IN (SELECT customer_id FROM accounts)""",
        CAMPAIGNS,
        ACCOUNTS,
    ),
    # --- what jobs write, read back
    "append_embedding": sql(
        """SELECT id, 'sample' AS embedding_model_id,
                  round(sqrt(list_inner_product(embedding, embedding)), 6) AS norm FROM base""",
        BASE,
    ),
    "append_analysis": sql(
        """SELECT video_uuid AS uuid, status, timestamp, count(*) AS identified FROM products GROUP BY ALL""",
        PRODUCTS,
    ),
    "append_matches": sql(
        """SELECT timestamp, uuid, offer AS matched_product_offer_id, round(distance, 6) AS distance FROM matched""",
        MATCHED,
    ),
    "sync_matches_written": sql(
        f"""
SELECT p.video_uuid, p.uuid AS identified_product_uuid, offer AS offer_id,
       round(coalesce(min(distance) FILTER (WHERE m.timestamp <= {SPLIT}), min(distance)), 6) AS distance
FROM matched m JOIN products p ON p.uuid = m.uuid GROUP BY ALL""",
        MATCHED,
        PRODUCTS,
    ),
    "watermark_state": sql(
        f"""
SELECT 'matches' AS component, max(timestamp) AS last_sync_timestamp, CAST(0 AS BIGINT) AS batch_id FROM matched
WHERE timestamp <= {SPLIT}
UNION ALL SELECT 'matches', max(timestamp), 1 FROM matched""",
        MATCHED,
    ),
    "sync_videos": sql(
        """
SELECT video_uuid, 'yt-' || n AS video_id, 'Video ' || n AS title, count(*) AS stats_identified_count,
       CAST(0 AS BIGINT) AS stats_matched_count
FROM products
WHERE status = 'FAILED' OR timestamp > coalesce((SELECT max(timestamp) FROM products WHERE status = 'FAILED'),
                                                TIMESTAMP '0001-01-01 00:00:00')
GROUP BY video_uuid, n""",
        PRODUCTS,
    ),
    "scan_sheet_ids": "SELECT 'vid-' || page_id AS video_id FROM pages",
    "scan_video_files": """
SELECT 'manual_entry' AS source, path AS gcs_uri, md5_hash, split_part(path, '/', -1) AS title
FROM (SELECT regexp_replace(url, '^https?://', 'gs://') || CASE WHEN length(html) > 5000 THEN '.MP4' ELSE '.mov' END AS path,
             md5(html) AS md5_hash FROM pages WHERE length(html) > 2000)""",
}

# The same rows by another way.
ORACLES["upsert_merge_ranges"] = ORACLES["upsert_merge"]
ORACLES["sync_matches_by_delta"] = ORACLES["sync_matches_written"]
ORACLES["video_match_totals_merged"] = ORACLES["video_match_totals"]
ORACLES["sync_matches_state"] = ORACLES["video_match_totals"]
ORACLES["embed_products"] = f"""
SELECT offer_id AS id, CAST(64 AS INTEGER) AS dim, CAST(1.0 AS DOUBLE) AS norm FROM ({ORACLES["new_products"].replace("LIMIT 1000", "")})"""
ORACLES["account_fanout_all"] = sql(
    """
below AS (SELECT customer_id AS top_id, customer_id FROM accounts WHERE manager
          UNION SELECT b.top_id, a.customer_id FROM below b JOIN accounts a ON a.parent_id = b.customer_id)
SELECT top_id, customer_id FROM below JOIN accounts USING (customer_id) WHERE NOT manager
UNION SELECT customer_id, customer_id FROM accounts WHERE NOT manager""",
    ACCOUNTS,
).replace("WITH", "WITH RECURSIVE", 1).replace("\nbelow AS", ",\nbelow AS", 1)
ORACLES["keyword_postings"] = sql(
    r"""
SELECT item_id AS term_id, video_uuid FROM videos, (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')[:30] AS words FROM benchmark)
WHERE list_has_any(keywords, words)""",
    VIDEOS,
)
ORACLES["summary_page_deep"] = sql(
    """
SELECT video_uuid, timestamp, status, (SELECT count(*) FROM videos) AS total_count
FROM videos ORDER BY timestamp DESC, video_uuid LIMIT 25 OFFSET 123""",
    VIDEOS,
)
ORACLES["request_page_deep"] = ORACLES["request_page"].replace("LIMIT 50 OFFSET 10", "LIMIT 50 OFFSET 1234")
ORACLES["deployments_backfill"] = sql(
    f"""
SELECT d.request_uuid, d.video_uuid, CASE WHEN s.submitting_user <> 'R' THEN 'PENDING' ELSE 'PROCESSING' END AS status,
       CASE WHEN s.submitting_user <> 'R' THEN s.submitting_user END AS submitting_user,
       CASE WHEN s.submitting_user <> 'R' THEN {AS_OF} ELSE TIMESTAMP '2002-01-01 00:00:00' END AS timestamp,
       v.video_id, v.source, d.ad_group_id, d.customer_id, CAST(len(list_distinct(d.ids)) AS BIGINT) AS offers
FROM deployments d JOIN subs s USING (request_uuid)
LEFT JOIN (SELECT 'video-' || doc_id AS video_uuid, 'vid-' || doc_id AS video_id, source FROM documents) v
  ON v.video_uuid = d.video_uuid""",
    SUBMISSIONS,
)
