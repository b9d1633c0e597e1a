"""URL filters: host and path rules, and for the rest trust spread over the link graph of hosts."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.shared import save, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute and scheme-relative targets of links; group 1 is the host with its port.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def after_scheme(url: Column) -> Column:
    """What follows the first '://'; empty for null and where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(hosts: Column, paths: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); of equally long ones a block. Null if none does.

    One expression a rule: meant for lists of some hundreds.
    """
    chosen = [
        F.when(
            ((hosts == r.host) | hosts.endswith(f".{r.host}")) & paths.startswith(r.path),
            F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict != "block", r))
    ]
    nothing = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*chosen, nothing)


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct links between different hosts (src, dst, n), counted before the shuffle."""
    target = F.explode(F.regexp_extract_all(F.col(f"`{html_col}`"), F.lit(LINK), F.lit(1)))
    found = pages.select(host(F.col(f"`{url_col}`")).alias("src"), target.alias("dst"))
    found = found.select("src", F.regexp_replace(F.translate("dst", UPPER, LOWER), r"^[^@]*@|:\d*$", "").alias("dst"))
    return found.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, total: float, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """Personalised PageRank: edges (src, dst, n), seeds (host, mass) -> (host, rank), masses being divided by `total`.
    The share of hosts without links goes back to no one.

    Ends when a round moves less than `tolerance` of the mass; as each round moves `damping` of what the one before did at
    most, that takes log(tolerance) / log(damping) rounds at the longest, 57 by default. Each round is a join of edges
    with ranks, unique by host, and a pre-aggregated sum; its table is saved, so that the plan does not grow.
    """
    start = save(seeds.where("mass > 0").select("host", (F.col("mass") / F.lit(total or 1.0)).alias("seed")), "seeds")
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    share = save(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share")), "shares")
    rank, moved = start.select("host", (F.col("seed") * (1 - damping)).alias("rank")), 1.0
    if not share.head(1):
        return rank
    while moved >= tolerance:
        sent = share.join(small(rank), F.col("src") == F.col("host")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        after = start.join(sent, F.col("host") == F.col("dst"), "full").select(
            F.coalesce("host", "dst").alias("host"),
            (F.coalesce("seed", F.lit(0.0)) * (1 - damping) + F.coalesce("got", F.lit(0.0)) * damping).alias("rank"),
        )
        after = save(after, "ranks")
        gap = after.join(rank.select(F.col("host").alias("h"), F.col("rank").alias("r")), F.col("host") == F.col("h"), "full")
        moved = gap.agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("r", F.lit(0.0))))).first()[0] or 0.0
        rank = after
    return rank


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    threshold: float = 0.0,
    default: str = "allow",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A rule's verdict holds for the pages it fits. Pages without a rule follow their host: trust spreads along links
    from hosts with allowed pages, distrust against them from hosts with blocked pages (who links there is suspect),
    seeds weighing as many pages as the rules judge, both as a share of all pages that they judge; the host is blocked if
    distrust exceeds trust by more than `threshold`. Hosts that neither reaches, and pages whose url is null or has no '://', get `default`.
    Repeated rows are judged one by one and add to their host's seeds; null html has no links.
    """
    url = F.col(f"`{url_col}`")
    judged = pages.select(F.col(f"`{id_col}`").alias("page_id"), host(url).alias("host"), path(url).alias("path")).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    judged = save(judged.select("page_id", "host", "path", "found.rule", F.col("found.verdict").alias("ruled")), "judged")
    seeds = judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").cast("double").alias("good"), F.count_if(F.col("ruled") == "block").cast("double").alias("bad"))
    seeds = save(seeds, "host-seeds")
    edges = save(link_edges(pages, url_col, html_col), "host-edges")
    total = seeds.agg(F.sum(F.col("good") + F.col("bad"))).first()[0] or 0.0
    trust = spread(edges, seeds.select("host", F.col("good").alias("mass")), total)
    against = spread(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), seeds.select("host", F.col("bad").alias("mass")), total)
    scores = trust.select(F.col("host").alias("th"), F.col("rank").alias("trust")).join(against.select(F.col("host").alias("dh"), F.col("rank").alias("distrust")), F.col("th") == F.col("dh"), "full")
    scores = save(scores.select(F.coalesce("th", "dh").alias("scored"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "host-scores")
    by_host = F.when(F.col("scored").isNull(), F.lit(default)).when(F.col("distrust") - F.col("trust") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(small(scores), F.col("host") == F.col("scored"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
