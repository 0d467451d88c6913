"""URL filters: rules by host and path, then trust and distrust over the link graph.

Everything is DataFrame functions. Pages are never collected or broadcast; the
rules are a short parameter and become one expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.common import lower_ascii, written


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Propagation:
    """Walks: share that goes back to the seeds, rounds, and the verdict's thresholds.

    A host is blocked where its distrust is over ``threshold`` times its trust
    and at least ``least``: both count ruled pages, its own or those that the
    walk brings, for each of its pages.
    """

    restart: float = 0.15
    rounds: int = 10
    threshold: float = 1.0
    least: float = 0.2
    cut_every: int = 5


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """``host`` and ``path`` of ``url``; both empty for a null or one without ``://``."""
    url = F.coalesce("url", F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": lower_ascii(host), "path": path})


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (ties: the first given); null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links with a host of their own in the pages' html, counted by pair of different hosts."""
    target = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""), F.lit(1))
    links = with_host_and_path(pages).where(F.col("html").contains("//")).select(F.col("host").alias("src"), F.explode(target).alias("dst"))
    return links.select("src", lower_ascii(F.col("dst")).alias("dst")).where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def parent_links(hosts: DataFrame) -> DataFrame:
    """``src, dst, n``: a link from each of ``hosts`` (host) to the nearest host above it, by its name, that is one of them too."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda k: F.struct(F.concat_ws(".", F.slice(labels, k, F.size(labels) - k + 1)).alias("dst"), k.alias("k")))
    each = hosts.where(F.size(labels) > 1).select(F.col("host").alias("src"), F.explode(above).alias("a")).select("src", "a.dst", "a.k")
    known = each.join(hosts.select(F.col("host").alias("dst")), "dst")
    return known.groupBy("src").agg(F.min_by("dst", "k").alias("dst")).select("src", "dst", F.lit(1).cast("long").alias("n"))


def walk(seeds: DataFrame, edges: DataFrame, how: Propagation) -> DataFrame:
    """``host, mass``: personalised PageRank from ``seeds`` (host, mass) over ``edges`` (src, dst, share).

    What reaches a host without links goes no further. Lineage is cut every few
    rounds by a written table.
    """
    start = seeds.select("host", (F.col("mass") * how.restart).alias("mass"))
    mass = seeds
    for k in range(how.rounds):
        moved = mass.join(edges, mass["host"] == edges["src"]).select(F.col("dst").alias("host"), (F.col("mass") * F.col("share") * (1 - how.restart)).alias("mass"))
        mass = start.unionByName(moved).groupBy("host").agg(F.sum("mass").alias("mass"))
        if (k + 1) % how.cut_every == 0:
            mass = written(mass)
    return mass


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...], how: Propagation = Propagation()) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every row of ``pages``.

    The longest rule that fits decides. Other pages are judged by their host.
    Every host with pages that a rule allows or blocks is a trusted or a
    distrusted seed, or both, by how many such pages it has. Trust walks along
    links, distrust against them: links in pages, and one from each host to the
    nearest host above it that has pages (blog.a.com to a.com). ``trust`` and
    ``distrust`` are a host's mass as pages for each page of its own, so that of
    a host without links is the share of its pages that rules allow or block.
    A host is blocked where distrust is over the thresholds (see
    ``Propagation``), allowed otherwise; so are urls without a host. Null html
    has no links; repeated rows count as pages of their own; an empty table gives
    no rows; columns not named here are ignored.
    """
    judged = with_host_and_path(pages.select("page_id", "url"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "host", "path", name.alias("rule"), verdict.alias("by_rule"))
    hosts = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked"))
    hosts = written(hosts)
    links = host_links(pages.select("url", "html")).unionByName(parent_links(hosts.select("host")))
    links = written(links.groupBy("src", "dst").agg(F.sum("n").alias("n")))
    masses = []
    for kind, (src, dst) in {"allowed": ("src", "dst"), "blocked": ("dst", "src")}.items():
        seeds = hosts.where(F.col(kind) > 0).select("host", F.col(kind).cast("double").alias("mass"))
        total = seeds.agg(F.sum("mass")).first()[0] or 1.0
        seeds = seeds.select("host", (F.col("mass") / total).alias("mass"))
        out = links.groupBy(F.col(src).alias("_src")).agg(F.sum("n").alias("_all"))
        edges = links.join(out, links[src] == out["_src"]).select(F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col("n") / F.col("_all")).alias("share"))
        name = "trust" if kind == "allowed" else "distrust"
        masses.append(walk(seeds, edges, how).select("host", (F.col("mass") * total / how.restart).alias(name)))
    scores = reduce(lambda a, b: a.join(b, "host", "left"), masses, hosts.select("host", "pages"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    scores = scores.select("host", *[(zero(c) / F.col("pages")).alias(c) for c in ("trust", "distrust")])
    bad = (F.col("distrust") >= how.least) & (F.col("distrust") > how.threshold * F.col("trust"))
    scores = scores.withColumn("_bad", bad)
    by_host = F.when(F.coalesce("_bad", F.lit(False)), "block").otherwise("allow")
    return judged.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), zero("trust").alias("trust"), zero("distrust").alias("distrust"))
