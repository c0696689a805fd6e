"""URL filter: rules on hosts and paths, and trust propagated over the host graph.

Pages that a rule fits get its verdict. For all others their host is judged:
personalised PageRank from hosts with allowed pages along links, the same from
hosts with blocked pages against links, and a threshold on the two.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table

#: Hosts up to which their verdicts are broadcast; beyond, they are joined.
BROADCAST_HOSTS = 100_000
#: Targets of anchors and areas; what isn't text for readers; and links that name a host of their own.
LINK = r"""(?i)<a(?:rea)?\s[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
ABSOLUTE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z as a-z; else empty."""
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; without ``://`` empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fitting rule as ``struct(name, verdict)``; null where none fits."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<name:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: links of ``pages(host, html)`` between different hosts, counted before they are shuffled on.

    Links in comments, scripts and styles don't count, and a link has a host only
    where it begins with ``//`` or a scheme and ``://``: a URL within another
    one's query is none. Null html, and an empty table, have no links.
    """
    shown = F.regexp_replace("html", HIDDEN, " ")
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(shown, F.lit(LINK), 1)).alias("to"))
    links = links.where(F.col("to").rlike(ABSOLUTE))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    links = links.select("src", host_of(to).alias("dst"))
    return links.where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int, tolerance: float) -> DataFrame:
    """Personalised PageRank ``(host, score)`` over ``edges(src, dst, p)``, p summing to 1 by src.

    ``seeds(host, seed)``: where walks begin, summing to 1; what ends at a host
    without edges begins anew. Hosts that no walk reaches have no row; without
    edges, or without seeds, the seeds are the result. Each round is an aggregation by host, written to the shared folder. Eager.
    """
    now = materialize(seeds.select("host", F.col("seed").alias("score")), "rank")
    if not edges.head(1):
        return now
    for _ in range(rounds):
        moved = edges.join(now, edges["src"] == now["host"]).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("p") * F.col("score"))).alias("score"))
        flown = moved.agg(F.sum("score")).first()[0] or 0.0
        again = seeds.select("host", (F.lit(1.0 - flown) * F.col("seed")).alias("score"))
        step = materialize(moved.union(again).groupBy("host").agg(F.sum("score").alias("score")), "rank")
        both = step.join(now.withColumnRenamed("score", "was"), "host", "full")
        change = both.agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0] or 0.0
        discard(now)
        now = step
        if change < tolerance:
            break
    return now


def _normal(edges: DataFrame, by: str, to: str) -> DataFrame:
    out = edges.groupBy(F.col(by).alias("src")).agg(F.sum("n").alias("all"))
    e = edges.select(F.col(by).alias("src"), F.col(to).alias("dst"), "n")
    return e.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("p"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = 0.85, rounds: int = 60, tolerance: float = 1e-4, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, distrust.

    ``distrust`` is the share of the host's distrust in its distrust, trust and
    pages without a rule, all counted in pages; without a rule, a page is blocked
    where its host's is over ``threshold``, and else allowed. A null url, or one without ``://``,
    has an empty host and path, fits no rule and is allowed. Null html has no
    links. Repeated rows are judged alike and their links count each; an empty
    table gives an empty result; other columns of ``pages`` are ignored. Eager
    up to the hosts' scores.
    """
    url = F.coalesce("url", F.lit(""))
    d = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce("html", F.lit("")).alias("html"))
    seen = materialize(d.drop("html").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)), "urls")
    edges = materialize(host_edges(d), "host-edges")
    # masses are in pages, so that they compare with the host's own pages without a rule
    scores = seen.where("host <> ''").groupBy("host").agg(F.count_if(F.col("rule").isNull()).alias("neutral"))
    for kind, verdict, (by, to) in (("trust", "allow", ("src", "dst")), ("doubt", "block", ("dst", "src"))):
        own = seen.where(F.col("rule.verdict") == verdict).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        total = own.agg(F.sum("n")).first()[0] or 0
        seeds = materialize(own.select("host", (F.col("n") / F.lit(max(total, 1))).alias("seed")), "seeds")
        rank = propagate(materialize(_normal(edges, by, to), "steps"), seeds, damping, rounds, tolerance)
        scores = scores.join(rank.select("host", (F.col("score") * total).alias(kind)), "host", "left")
    doubt, trust = F.coalesce("doubt", F.lit(0.0)), F.coalesce("trust", F.lit(0.0))
    scores = materialize(scores.select("host", (doubt / (doubt + trust + F.col("neutral"))).alias("distrust")), "host-scores")
    few = scores.count() <= BROADCAST_HOSTS
    out = seen.join(F.broadcast(scores) if few else scores, "host", "left")
    by_host = F.when(F.coalesce("distrust", F.lit(0.0)) > threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("rule.name").alias("rule"), F.coalesce("rule.verdict", by_host).alias("verdict"), "distrust")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
