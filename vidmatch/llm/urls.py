"""URL rules, and trust that spreads over links for the hosts without a rule.

A rule is a host and a path; it fits the host, its subdomains and all paths that begin
with its own, and the longest fitting rule decides. Pages without a rule get their
host's verdict: pages that rules allow are a source of trust that follows the links
(personalised PageRank), pages that rules block are a source of distrust that goes
against them. Both are kept in pages, not in shares, so no total is needed; a host
whose distrust exceeds its trust by ``threshold`` of its own pages is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidmatch.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of each absolute address that a page links to.
LINK = r"""(?i)\bhref\s*=\s*["']?[a-z][a-z0-9+.-]*://([^/?#"'\s>]*)"""
DAMPING, STEPS, THRESHOLD = 0.85, 20, 0.5
#: The rules of the registered query: (verdict, host with path).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")), F.lit(""))


def addresses(pages: DataFrame) -> DataFrame:
    """page_id, host, path of the columns page_id, url; html is kept if it is there."""
    html = [F.col("html")] if "html" in pages.columns else []
    rest = F.regexp_extract(F.col("rest"), "^[^/?#]*", 0)
    return (
        pages.select("page_id", F.col("url").cast("string").alias("url"), *html)
        .select("page_id", _rest(F.col("url")).alias("rest"), *html)
        .select(
            "page_id",
            F.translate(rest, UPPER, LOWER).alias("host"),
            F.regexp_extract(F.col("rest"), "^[^/?#]*([^?#]*)", 1).alias("path"),
            *html,
        )
    )


def host_rules(hosts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Each host with the rules of its own name and of its parents, longest first.

    ``hosts`` holds every host once. Of equal rules, ``block`` comes first.
    """
    spark = hosts.sparkSession
    rows = [(*r.partition("/")[::2], v, r) for v, r in rules]
    listed = spark.createDataFrame(
        [(h.lower(), f"/{p}", v, r) for h, p, v, r in rows], "parent string, start string, verdict string, rule string"
    )
    labels = F.split("host", r"\.")
    # No rule fits more labels than the longest has, whatever the length of the host.
    most = max((h.count(".") + 1 for h, *_ in rows), default=1)
    lengths = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most)))
    parents = F.transform(lengths, lambda i: F.array_join(F.slice(labels, -i, i), "."))
    order = F.struct((-F.length("rule")).alias("order"), F.expr("verdict = 'allow'").alias("allow"), "rule", "start", "verdict")
    return (
        hosts.select("host", F.explode(parents).alias("parent"))
        .join(listed, "parent")
        .groupBy("host")
        .agg(F.array_sort(F.collect_set(order)).alias("rules"))  # no more than there are rules
    )


def with_rule(addressed: DataFrame, ruled: DataFrame, *more: str) -> DataFrame:
    """The deciding rule of each page (``found``: rule and verdict, or null)."""
    fits = F.filter("rules", lambda r: F.col("path").startswith(r["start"]))
    return addressed.join(ruled, "host", "left").withColumn("found", F.get(fits, F.lit(0))).drop("rules", *more)


def link_edges(addressed: DataFrame) -> DataFrame:
    """Links between different hosts: src, dst, links (each page counts a host once)."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda h: F.translate(h, UPPER, LOWER)))
    return (
        addressed.where("host <> '' and html is not null")
        .select(F.col("host").alias("src"), F.explode(found).alias("dst"))
        .where("dst <> '' and dst <> src")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("links"))
    )


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """Trust along the links and distrust against them: host, trust, distrust.

    ``seeds`` holds host, allowed, blocked (pages), each host once. What a host passes
    on is shared by its links; where there are none, it goes nowhere. A hub's links are
    the large side of a join that adaptive execution splits, and sums are combined
    before the shuffle. The ranks are written every few steps.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "links").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    )
    out = both.groupBy("kind", "src").agg(F.sum("links").alias("total"))
    shares = cut_lineage(
        both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.lit(damping) * F.col("links") / F.col("total")).alias("share"))
    )
    start = cut_lineage(
        seeds.select("host", F.expr("stack(2, 'trust', allowed, 'distrust', blocked) as (kind, mass)"))
        .where("mass > 0")
        .select("kind", "host", (F.col("mass") * F.lit(1 - damping)).alias("mass"))
    )
    ranks = start
    for step in range(steps):
        passed = shares.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (F.col("mass") * F.col("share")).alias("mass")
        )
        ranks = start.unionByName(passed).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if step % 5 == 4:
            ranks = cut_lineage(ranks)
    return ranks.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("mass")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(0.0)).alias("distrust"),
    )


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    damping: float = DAMPING,
    steps: int = STEPS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url, html).

    A null url or one without ``://`` has an empty host and path, fits no rule and is
    allowed; such rows pass on nothing. A null html has no links. Repeated rows are
    judged alike and each counts as a page. Other columns are ignored.
    """
    at = addresses(pages)
    urls = addresses(pages.select("page_id", "url"))
    ruled = cut_lineage(host_rules(urls.select("host").distinct(), rules))
    verdict = F.col("found.verdict")
    count = lambda v: F.sum(F.when(verdict == v, 1).otherwise(0))
    counts = cut_lineage(
        with_rule(urls, ruled).groupBy("host").agg(F.count("*").alias("pages"), count("allow").alias("allowed"), count("block").alias("blocked"))
    )
    ranks = propagate(cut_lineage(link_edges(at)), counts.where("host <> ''"), damping, steps)
    excess = F.coalesce(F.col("distrust"), F.lit(0.0)) - F.coalesce(F.col("trust"), F.lit(0.0))
    bad = (F.round(excess - F.lit(threshold * (1 - damping)) * F.col("pages"), 9) >= 0) & (F.col("host") != "")
    hosts = counts.join(ranks, "host", "left").join(ruled, "host", "left").select("host", "rules", bad.alias("bad"))
    return with_rule(urls, hosts).select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(verdict, F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"),
    )


def judge_sql(
    rules: list[tuple[str, str]], damping: float = DAMPING, steps: int = STEPS, threshold: float = THRESHOLD
) -> str:
    """The same in DuckDB's SQL."""
    values = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}', '{r}')" for v, r in rules)
    lower = f"'{UPPER}', '{LOWER}'"
    link = LINK.replace("'", "''")
    ranks = "".join(
        f""", r{k + 1} AS MATERIALIZED (SELECT kind, host, sum(mass) AS mass FROM (SELECT kind, host, mass FROM r0 UNION ALL
 SELECT s.kind, s.dst, r.mass * s.share FROM shares s JOIN r{k} r ON r.kind = s.kind AND r.host = s.src) GROUP BY kind, host)"""
        for k in range(steps)
    )
    return rf"""
WITH rules(parent, start, verdict, rule) AS (VALUES {values}),
cut AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS MATERIALIZED (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), {lower}) AS host,
 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
paths AS (SELECT DISTINCT host, path FROM parsed),
fits AS (SELECT p.host, p.path, r.rule, r.verdict,
 row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(r.rule) DESC, r.verdict DESC, r.rule) AS k
 FROM paths p JOIN rules r ON (p.host = r.parent OR ends_with(p.host, '.' || r.parent)) AND starts_with(p.path, r.start)),
judged AS MATERIALIZED (SELECT a.page_id, a.host, a.path, f.rule, f.verdict
 FROM parsed a LEFT JOIN fits f ON f.host = a.host AND f.path = a.path AND f.k = 1),
counts AS MATERIALIZED (SELECT host, count(*) AS pages, count(*) FILTER (verdict = 'allow') AS allowed,
 count(*) FILTER (verdict = 'block') AS blocked FROM judged GROUP BY host),
targets AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1),
 lambda h: translate(h, {lower})))) AS dst FROM parsed WHERE host <> '' AND html IS NOT NULL),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS links FROM targets WHERE dst <> '' AND dst <> src GROUP BY src, dst),
both_ways AS (SELECT 'trust' AS kind, src, dst, links FROM edges UNION ALL SELECT 'distrust', dst, src, links FROM edges),
shares AS MATERIALIZED (SELECT kind, src, dst, {damping}::DOUBLE * links / sum(links) OVER (PARTITION BY kind, src) AS share FROM both_ways),
r0 AS MATERIALIZED (SELECT kind, host, mass * {1 - damping}::DOUBLE AS mass FROM (SELECT 'trust' AS kind, host, allowed AS mass FROM counts
 UNION ALL SELECT 'distrust', host, blocked FROM counts) WHERE mass > 0 AND host <> ''){ranks},
hosts AS (SELECT c.host, c.host <> '' AND round(coalesce(d.mass, 0) - coalesce(t.mass, 0)
 - {threshold * (1 - damping)}::DOUBLE * c.pages, 9) >= 0 AS bad
 FROM counts c LEFT JOIN r{steps} t ON t.host = c.host AND t.kind = 'trust' LEFT JOIN r{steps} d ON d.host = c.host AND d.kind = 'distrust')
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.verdict, CASE WHEN h.bad THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j JOIN hosts h ON h.host = j.host"""
