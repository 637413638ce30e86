"""URL filter by link-graph propagation, on DataFrame functions only.

Pages give host edges: the hosts of absolute links, and a host's parent domains, each to the next and back (a site's
hosts vouch for each other). Trust is personalised PageRank along the edges from hosts with allowed pages; distrust runs
on the reversed edges from hosts with blocked pages. Each sums to 1. A host whose distrust exceeds ``ratio`` times its
trust is blocked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import ascii_lower, discard, materialize


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host and its subdomains where the url's path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url_col: str, html_col: str, host: str = "host") -> DataFrame:
    """(src, dst, w): links between hosts, counted, and links between a host, the host above it, and so on up to two labels, both ways."""
    href = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""
    links = pages.select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(href), F.lit(1))).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    linked = links.select("src", host_of(to).alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    hosts = pages.select(F.col(host).alias("src")).distinct().filter("src <> ''")
    chain = F.expr("transform(sequence(0, size(split(src, '[.]')) - 2), i -> array_join(slice(split(src, '[.]'), i + 1, size(split(src, '[.]')) - i), '.'))")
    chain = F.when(F.size(F.split("src", "[.]")) > 2, chain)
    up = hosts.select(F.posexplode(F.slice(chain, 2, F.greatest(F.size(chain) - 1, F.lit(0)))).alias("i", "dst"), chain.alias("c"))
    up = up.select(F.element_at("c", F.col("i") + 1).alias("src"), "dst").filter("src <> '' and dst <> ''").distinct()
    family = up.union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("src", "dst", F.lit(1.0).alias("w"))
    return linked.union(family).filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-3, every: int = 4, task_edges: int = 100_000) -> DataFrame:
    """(kind, host, rank): PageRank that restarts at the seeds, for all kinds at once; each kind's ranks sum to 1.

    ``edges`` are (kind, src, dst, w), ``seeds`` (kind, host, weight), both of one row per key. What leaves at hosts
    without links goes back to the seeds, which is the same as scaling the result to 1 at the end. A round sends on only
    what the round before has moved: one join on the edges, which stay partitioned by their source, and one
    pre-aggregated sum, written as a table and added to the running ranks every few rounds. A source of more than
    ``task_edges`` links is dealt to as many parts as that makes, and what it sends goes to each of them. Each round moves
    at most ``damping`` of the one before, so that it ends: when what has not been sent on is at most ``tolerance`` of all.
    """
    spark = edges.sparkSession
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("total"), F.ceil(F.count(F.lit(1)) / task_edges).cast("int").alias("parts"))
    out = materialize(out, "pagerank-sources")
    part = F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part")
    share = materialize(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", part, (F.col("w") / F.col("total")).alias("p")), "pagerank-edges")
    heavy = materialize(out.filter("parts > 1").select("kind", "src", "parts"), "pagerank-heavy")
    divided = bool(heavy.take(1))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = share.repartition(tasks, "kind", "src", "part").persist()  # lost partitions come again from the table
    last = rank = materialize(seeds.select("kind", "host", (F.col("weight") * (1 - damping)).alias("rank")), "pagerank-moved")
    waiting: list[DataFrame] = []
    k, left = 0, 1.0
    while left > tolerance:
        each = last.select("kind", F.col("host").alias("src"), "rank", F.lit(0).alias("part"))
        if divided:
            each = each.join(heavy, ["kind", "src"], "left").select("kind", "src", "rank", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        each = each.repartition(tasks, "kind", "src", "part")
        sent = share.join(each, ["kind", "src", "part"]).groupBy("kind", F.col("dst").alias("host")).agg((F.sum(F.col("p") * F.col("rank")) * damping).alias("rank"))
        last = materialize(sent, "pagerank-moved")
        waiting.append(last)
        k += 1
        if k % every == 0:
            # a row per kind; what these moved is still to be sent on damping times, damping squared times, and so on
            now = {r["kind"]: r["rank"] for r in last.groupBy("kind").agg(F.sum("rank").alias("rank")).collect()}
            left = max(now.values(), default=0.0) * damping / (1 - damping)
            every_rank = rank
            for m in waiting:
                every_rank = every_rank.union(m)
            done, rank = rank, materialize(every_rank.groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "pagerank-ranks")
            discard(done, *waiting[:-1])
            waiting = []
    share.unpersist()
    totals = {r["kind"]: r["rank"] for r in rank.groupBy("kind").agg(F.sum("rank").alias("rank")).collect()}
    discard(out, heavy, last)
    scale = F.lit(1.0)
    for kind, total in totals.items():
        scale = F.when(F.col("kind") == kind, F.lit(total)).otherwise(scale)
    return rank.select("kind", "host", (F.col("rank") / scale).alias("rank"))


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = 1.0) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) for every row of ``pages``.

    A fitting rule decides; elsewhere the host's propagated trust and distrust do, and hosts that neither reaches are
    allowed. Null urls and urls without "://" have empty host and path. Null html has no links. Repeated rows stay, each
    with its links; columns of the input that are named like those of the result don't matter.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    name, verdict = matched(F.col("host"), F.col("path"), rules)
    keyed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("__html"))
    judged = keyed.select("id", "host", "path", name.alias("rule"), verdict.alias("ruled"))
    edges = materialize(host_edges(keyed, url_col, "__html"), "host-edges")

    kind = F.when(F.col("ruled") == "allow", "trust").otherwise("distrust")
    seeds = judged.filter(F.col("ruled").isNotNull() & (F.col("host") != "")).groupBy(kind.alias("kind"), "host").agg(F.count(F.lit(1)).alias("n"))
    seeds = materialize(seeds, "seeds")
    total = {r["kind"]: r["n"] for r in seeds.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # two rows
    weight = F.col("n") / F.when(F.col("kind") == "trust", total.get("trust", 1)).otherwise(total.get("distrust", 1))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "w").union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), F.col("w")))
    rank = personalised_pagerank(both, seeds.select("kind", "host", weight.alias("weight")))
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k)
    scores = rank.groupBy("host").agg(of("trust"), of("distrust"))
    out = judged.join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    method = F.when(F.col("distrust") > F.col("trust") * ratio, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")
