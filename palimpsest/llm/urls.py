"""URL filter: rules by host and path, and for the rest trust propagated over the graph of hosts.

Every host seeds trust with the share of its pages that no rule blocks, and distrust with the share that
rules block. Personalised PageRank carries trust along links, and distrust against them: who links to a
blocked host is suspect. A host whose distrust exceeds its trust and a threshold is blocked where no
rule speaks. Without links the seeds decide, so a host most of whose pages are blocked is blocked.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + path)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _fits(r: Rule, host: Column, path: Column) -> Column:
    own = (host == r.host) | host.endswith("." + r.host)
    return own & path.startswith(r.path) if r.path else own


def decide(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Of equally long rules, the more
    specific host, then ``block``, wins. Rules are a bounded list (2,000 at most): they become part
    of the plan."""
    if len(rules) > 2000:
        raise ValueError("more rules than an expression should hold")
    order = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block", r.text))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return reduce(lambda rest, r: F.when(_fits(r, host, path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(rest), reversed(order), none)


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and the number of links, from the links in html; links within a host are left out. A link without a
    host leads to that of the page's ``<base>``, if it has one, else to the page's own."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    quoted = r"""\s[^>]{0,2000}?href\s*=\s*["']?([^"'\s>]+)"""
    src, _ = host_path(F.col("url"))
    base = F.regexp_extract(html, "(?i)<base" + quoted, 1)
    got = pages.select(src.alias("src"), base.alias("base"), F.explode(F.regexp_extract_all(html, F.lit("(?i)<a" + quoted), F.lit(1))).alias("link"))

    def absolute(link: Column) -> Column:
        return F.when(link.startswith("//"), F.concat(F.lit("http:"), link)).when(link.rlike("(?i)^https?://"), link)

    of_base, _ = host_path(absolute(F.col("base")))
    other = F.col("link").rlike("^([A-Za-z][A-Za-z0-9+.-]*:|#)")  # another scheme, or a place in the page itself
    at, _ = host_path(absolute(F.col("link")))
    dst = F.when(absolute(F.col("link")).isNotNull(), at).when(~other, of_base).otherwise("")
    return got.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """Personalised PageRank: node and rank, from seeds(node, weight) along edges(src, dst, links).

    Seed weights are normalised to one. What reaches a node without outgoing edges returns to the seeds.
    Without seeds there is no rank at all; without edges every seed keeps its weight. Contributions
    are partial sums, and each round is written to the shared folder.
    """
    total = seeds.agg(F.sum("weight").alias("all")).first()["all"] or 0.0
    seeds = seeds.where("weight > 0").groupBy("node").agg((F.sum("weight") / F.lit(total or 1.0)).alias("seed"))
    rank = materialize(seeds.select("node", F.col("seed").alias("rank")), "rank")
    if not total or edges.isEmpty():
        return rank
    out = edges.groupBy("src").agg(F.sum("links").alias("out"))
    share = materialize(edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("out")).alias("share")), "share")
    sources = share.select("src").distinct()
    for _ in range(rounds):
        given = share.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        lost = rank.join(sources, rank["node"] == sources["src"], "left_anti").agg(F.sum("rank").alias("x")).first()["x"] or 0.0
        back = 1 - damping + damping * lost
        new = materialize(given.join(seeds, "node", "full").select("node", (damping * F.coalesce("got", F.lit(0.0)) + back * F.coalesce("seed", F.lit(0.0))).alias("rank")), "rank")
        moved = new.join(rank.withColumnRenamed("rank", "old"), "node", "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("x")).first()["x"]
        rank = new
        if moved is None or moved < tolerance:
            break
    return rank


def judge(pages: DataFrame, rules: list[Rule], threshold: float = 0.0, **rank) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages(page_id, url, html)``.

    Seeds come from the rules: a host of n pages of which rules block b seeds distrust with b / n and trust with
    (n - b) / n. Ranks are multiplied by the sum of their seeds, so what the two hold compares however many hosts
    seed either. Hosts whose distrust is above ``threshold`` and above their trust are blocked where no rule fits; all
    others are allowed. A null url, or one without ``://``, has an empty host and path and is allowed.
    Repeated rows, and rows without a page_id, are judged one by one and count as pages of their host; null html has no
    links; an empty table gives an empty result; further columns are ignored, whatever their names. A very long page
    is one row, of which the links are exploded. A host of very many pages is summed up before the shuffle.
    """
    host, path = host_path(F.col("url").cast("string"))
    judged = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("by", decide(F.col("host"), F.col("path"), rules))
    ranks = host_ranks(pages.select("url", "html"), judged, **rank)
    bad = ranks.where(F.col("bad") > F.greatest("good", F.lit(threshold))).select("host", F.lit("block").alias("by_rank"))
    return judged.join(bad, "host", "left").select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", "by_rank", F.lit("allow")).alias("verdict"))


def host_ranks(pages: DataFrame, judged: DataFrame, **rank) -> DataFrame:
    """host, good and bad: trust and distrust of every host that has any, from judged(host, by)."""
    blocked = F.count(F.when(F.col("by.verdict") == "block", 1)) / F.count("*")
    hosts = materialize(judged.where("host <> ''").groupBy(F.col("host").alias("node")).agg(blocked.alias("share")), "hosts")
    edges = materialize(host_edges(pages), "edges")

    def scaled(links: DataFrame, seeds: DataFrame, name: str) -> DataFrame:
        total = seeds.agg(F.sum("weight").alias("all")).first()["all"] or 0.0
        return pagerank(links, seeds, **rank).select(F.col("node").alias("host"), (F.col("rank") * F.lit(total)).alias(name))

    good = scaled(edges, hosts.select("node", (1 - F.col("share")).alias("weight")), "good")
    bad = scaled(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links"), hosts.select("node", F.col("share").alias("weight")), "bad")
    return good.join(bad, "host", "full").select("host", F.coalesce("good", F.lit(0.0)).alias("good"), F.coalesce("bad", F.lit(0.0)).alias("bad"))
