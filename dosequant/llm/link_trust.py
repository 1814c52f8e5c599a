"""URL filter: rules first, then trust and distrust spread over links between hosts.

Rules name a host and the beginning of a path. Hosts whose pages the rules allow are
seeds of trust, which follows links; hosts whose pages they block are seeds of
distrust, which follows links backwards, to those that link there. Both spread by
personalised PageRank, one join per round, until nothing changes any more. Pages
without a rule get the verdict of their host. Only built-in functions are used.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dosequant.llm.storage import written
from dosequant.operators.links import ANCHOR, COMMENT, HREF, NO_TEXT, NOT_CONTENT, decoded
from dosequant.operators.skew import join_apart

DAMPING, TOLERANCE = 0.85, 1e-6
#: Rounds between two looks at what has changed, each of which writes the ranks.
ROUNDS_AT_ONCE = 4
#: What has not settled by then never will: the sum of all changes shrinks by the
#: damping each round, to less than the tolerance for any number of hosts.
MOST_ROUNDS = 400
#: A host is blocked from this share of a wholly blocked host's own distrust on.
BLOCK_FROM = 0.5

#: The host in an address that has one: after an optional scheme and two slashes.
_HOST = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\s]+)"


class Rule(NamedTuple):
    """`verdict` is allow or block; `path` begins with a slash."""

    verdict: str
    host: str
    path: str


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL; both empty without `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return _lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules) with the rules that fit each of the distinct hosts or a domain
    above it, the longest first."""
    labels = F.split("host", r"\.")
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))),
    )
    found = join_apart(hosts.withColumn("above", F.explode(above)), rules.withColumnRenamed("host", "above"), "above", "rules")
    longest = F.sort_array(
        F.collect_set(F.struct((-F.length("rule")).alias("order"), "rule", "path", "verdict"))
    )
    return found.groupBy("host").agg(longest.alias("rules"))


def _table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [F.struct(*[F.lit(x).alias(n) for n, x in (*r._asdict().items(), ("rule", r.host + r.path))]) for r in rules]
    none = "array<struct<verdict:string,host:string,path:string,rule:string>>"
    return spark.range(1).select(F.inline(F.array(*rows) if rows else F.array().cast(none)))


def linked_hosts(html: Column) -> Column:
    """The hosts that the links of a page name, as a parser finds them: not in comments,
    scripts or styles, and only in the attribute href of a link."""
    content = F.regexp_replace(F.regexp_replace(html, COMMENT, NO_TEXT), NOT_CONTENT, "")
    attributes = F.regexp_extract_all(content, F.lit(ANCHOR), F.lit(1))
    href = lambda a: decoded(F.concat(*[F.regexp_extract(a, HREF, i) for i in (1, 2, 3)]))
    hosts = F.transform(attributes, lambda a: _lower(F.regexp_extract(href(a), _HOST, 1)))
    return F.filter(hosts, lambda h: h != "")


def host_links(pages: DataFrame, page: str = "html") -> DataFrame:
    """(source, target, n) of links from a page of one host to another host.

    Besides links in pages, a host and the one a label above it link to each other,
    if both have pages: www.a.org and a.org are one site.
    """
    in_pages = (
        pages.select(F.col("host").alias("source"), F.explode(linked_hosts(F.col(f"`{page}`"))).alias("target"))
        .where("source <> '' AND source <> target")
        .groupBy("source", "target")
        .agg(F.count("*").alias("n"))
    )
    hosts = pages.where("host <> ''").select("host").distinct()
    parents = hosts.select("host", F.substring_index("host", ".", -1).alias("last"), F.expr("substr(host, instr(host, '.') + 1)").alias("above")).where("above <> last")
    sites = join_apart(parents, hosts.withColumnRenamed("host", "above"), "above", "site").select("host", "above")
    both = sites.selectExpr("host AS source", "above AS target", "1L AS n").unionByName(
        sites.selectExpr("above AS source", "host AS target", "1L AS n")
    )
    return in_pages.unionByName(both).groupBy("source", "target").agg(F.sum("n").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of every host reached from the seeds.

    `seeds` has `host` and the shares `trust` and `distrust`. A share of 1 - damping
    of each rank comes from the host's own seed, the rest over links, each host
    passing on its rank in proportion to their number. Rank of hosts that pass
    nothing on is lost. Ends when no rank changes by `tolerance` in ROUNDS_AT_ONCE
    rounds, and fails if that takes more than MOST_ROUNDS.
    """
    way = lambda kind, a, b: links.select(
        F.lit(kind).alias("kind"), F.col(a).alias("from"), F.col(b).alias("to"), "n"
    )
    edges = way("trust", "source", "target").unionByName(way("distrust", "target", "source"))
    out = edges.groupBy("kind", "from").agg(F.sum("n").alias("out"))
    key = F.struct("kind", "from").alias("key")
    edges = join_apart(edges.withColumn("key", key), out.select(key, "out"), "key", "out").select(
        "key", F.struct("kind", F.col("to").alias("from")).alias("next"), (F.col("n") / F.col("out")).alias("share")
    )
    edges = written(edges, "host-links")
    stacked = F.expr("stack(2, 'trust', trust, 'distrust', distrust) AS (kind, seed)")
    own = seeds.select(F.col("host").alias("from"), stacked).where("seed > 0")
    own = written(own.select(key, (F.col("seed") * (1 - damping)).alias("own")), "host-seeds")

    def passed_on(ranks: DataFrame) -> DataFrame:
        passed = join_apart(edges, ranks, "key", "rank").select(F.col("next").alias("key"), (F.col("share") * F.col("rank") * damping).alias("part"))
        parts = passed.unionByName(own.select("key", F.col("own").alias("part")))
        return parts.groupBy("key").agg(F.round(F.sum("part"), 12).alias("rank"))

    ranks = own.withColumnRenamed("own", "rank")
    for _ in range(0, MOST_ROUNDS, ROUNDS_AT_ONCE):
        after = ranks
        for _ in range(ROUNDS_AT_ONCE):
            after = passed_on(after)
        both = after.withColumn("old", F.lit(0.0)).unionByName(ranks.select("key", F.lit(0.0).alias("rank"), F.col("rank").alias("old")))
        ranks = written(both.groupBy("key").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old")), "host-ranks")
        change = ranks.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = ranks.drop("old")
        if not change or change < tolerance:
            break
    else:
        raise RuntimeError(f"ranks still change by {change} after {MOST_ROUNDS} rounds")
    of = lambda kind: F.sum(F.when(F.col("key.kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    return ranks.groupBy(F.col("key.from").alias("host")).agg(of("trust"), of("distrust"))


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", page: str = "html",
    block_from: float = BLOCK_FROM, damping: float = DAMPING,
) -> DataFrame:
    """One row per page: id, `host`, `path`, `rule` (host and path of the longest
    that fits, or null), `verdict`, and the host's `trust` and `distrust`.

    Without a rule a page is blocked if its host has at least `block_from` of the
    distrust that blocked pages give a host of nothing else, rank that comes back over
    links not counted in, and more distrust than trust; with as much of both it is
    allowed. Pages without a host are allowed then. Null and empty pages link nowhere;
    repeated rows count as often and are returned as often. Other columns of `pages`
    are not returned. Without rules nothing is blocked.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(f"`{url}`"))
    pages = pages.select(
        F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"),
        F.col(f"`{page}`").alias("html"),
    )
    fitting = rules_by_host(pages.select("host").distinct(), _table(spark, rules))
    judged = join_apart(pages.select("page_id", "host", "path"), fitting, "host", "fitting", "left")
    judged = judged.withColumn(
        "found", F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    )
    judged = written(judged.select("page_id", "host", "path", "found.rule", "found.verdict"), "judged-pages")
    share = lambda verdict: F.avg((F.coalesce("verdict", F.lit("")) == verdict).cast("double"))
    seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    ranks = spread(host_links(pages), seeds, damping)
    blocked = (F.col("distrust") >= block_from * (1 - damping)) & (F.col("distrust") > F.col("trust"))
    ranked = join_apart(judged, ranks, "host", "ranks", "left")
    verdict = F.coalesce("verdict", F.when(blocked, "block").otherwise("allow"))
    return ranked.select(
        F.col("page_id").alias(page_id), "host", "path", "rule", verdict.alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
