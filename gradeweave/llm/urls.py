"""URL filters: rules first, then trust and distrust spread over the graph of hosts.

Rules name a host and a path; they fit the host and its subdomains where the
url's path starts with theirs, and the longest wins. Hosts whose pages the
rules allow or block are seeds, by the share of their pages. Personalised
PageRank runs from the trusted seeds along the links, and from the blocked ones
against them (a host that links to blocked hosts earns distrust): a host shares
its rank among its links by their counts, and the walk restarts at the seeds.

A raw rank falls with the number of hosts that share a source, so no threshold
fits it. The same walk restarting at every host alike goes along, in the same
table, and a host's score is the share of the rank it gets from its neighbours
that began at seeds: between 0 and 1, and alike in any graph. Its own seed is
the least it has. A page without a rule is blocked where its host's distrust
reaches ``threshold`` and is above its trust.

Links are the pages' ``href``s, resolved against the page: absolute, beginning
with ``//``, or relative to its ``<base>`` or own url. Edges are counted by host
pair before any shuffle of ranks, so a hot host costs as many rows as it has
neighbours. Every round's table is written to the shared folder. DataFrame
operations only.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is allowed; null pages link nowhere; repeated pages
count again; very long pages are matched in one pass, as the regexes' runs give
nothing back; extra columns of the pages leave, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.llm.common import ascii_lower, materialize

Rule = tuple[str, str, str]  # verdict, host, path


def host_col(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")))


def path_col(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_col(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null: one conditional, longest first."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


#: Regexes of a page's links and of its base, and of urls that begin with a scheme.
HREF = r"""(?i)\bhref\s*+=\s*+["']?+\s*+([^"'\s<>]++)"""
BASE = r"""(?i)<base\s[^<>]*?href\s*+=\s*+["']?+\s*+([^"'\s<>]++)"""
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, n): links between hosts, from rows with ``host`` and the page.

    Links with a scheme or beginning with ``//`` name their host; all others
    lie on the host of the page's ``<base>``, else on its own. Links within a
    host tell nothing and leave before they are counted.
    """
    page = F.coalesce(F.col(html), F.lit(""))
    named = lambda u: F.when(u.startswith("//"), host_col(F.concat(F.lit("http:"), u))).when(u.rlike(SCHEME), host_col(u))
    base = F.regexp_extract(page, BASE, 1)
    own = F.when(F.coalesce(named(base), F.lit("")) != "", named(base)).otherwise(F.col("host"))
    found = pages.select(F.col("host").alias("src"), own.alias("own"), F.regexp_extract_all(page, F.lit(HREF), F.lit(1)).alias("links"))
    # exploded apart, or the page would be searched for its base once a link
    found = found.select("src", "own", F.explode("links").alias("u")).select("src", F.coalesce(named(F.col("u")), F.col("own")).alias("dst"))
    return found.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """(host, score) of all hosts: the share of the rank that reaches a host which began at seeds, and its own seed at least.

    Two PageRanks in step: ``own`` restarts at the seeds, ``all`` at every
    host. A host's rank goes to the hosts it links to, by the links' counts;
    where no links lead on it ends, in both alike. Links of a host to itself
    leave.
    """
    links = edges.where("src <> dst")
    totals = links.groupBy("src").agg(F.sum("n").alias("all"))
    links = materialize(links.join(totals, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("w")), "host-links")
    if links.limit(1).count() == 0:
        return seeds.select("host", F.col("seed").alias("score"))  # every host only has its own
    hosts = seeds.select("host", "seed").unionByName(links.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("seed")))
    hosts = materialize(hosts.groupBy("host").agg(F.max("seed").alias("seed")), "host-restarts")
    start = F.lit(1 - damping)
    now = hosts.select("host", "seed", (start * F.col("seed")).alias("own"), start.alias("all"), F.lit(0.0).alias("heard_own"), F.lit(0.0).alias("heard_all"))
    for _ in range(rounds):
        given = links.join(now.select(F.col("host").alias("src"), "own", "all"), "src")
        heard = given.groupBy(F.col("dst").alias("host")).agg(*((damping * F.sum(F.col("w") * F.col(c))).alias(f"heard_{c}") for c in ("own", "all")))
        both = hosts.join(heard, "host", "left").na.fill(0.0, ["heard_own", "heard_all"])
        now = materialize(both.select("host", "seed", (start * F.col("seed") + F.col("heard_own")).alias("own"), (start + F.col("heard_all")).alias("all"), "heard_own", "heard_all"), "host-ranks")
    share = F.coalesce(F.try_divide("heard_own", "heard_all"), F.lit(0.0))
    return now.select("host", F.round(F.greatest("seed", share), 9).alias("score"))


def judge(pages: DataFrame, rules: Sequence[Rule], threshold: float = 0.5, damping: float = 0.85, rounds: int = 10, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: key, host, path, rule, verdict, trust, distrust."""
    host, path = host_col(F.col(url)), path_col(F.col(url))
    ruled = pages.select(F.col(key), host.alias("host"), path.alias("path")).withColumn("__rule", rule_col(F.col("host"), F.col("path"), rules))
    is_ = lambda v: F.avg(F.when(F.col("__rule.verdict") == v, 1.0).otherwise(0.0))
    hosts = materialize(ruled.where("host <> ''").groupBy("host").agg(is_("allow").alias("good"), is_("block").alias("bad")), "host-seeds")
    edges = materialize(host_edges(pages.select(host.alias("host"), F.col(html).alias("__html")), "__html"), "host-edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trust = spread(edges, hosts.select("host", F.col("good").alias("seed")), damping, rounds)
    distrust = spread(back, hosts.select("host", F.col("bad").alias("seed")), damping, rounds)
    known = materialize(trust.select("host", F.col("score").alias("trust")).join(distrust.select("host", F.col("score").alias("distrust")), "host", "full_outer"), "host-judged")
    out = ruled.join(known, "host", "left")
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.coalesce("trust", F.lit(0.0)))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.coalesce(bad, F.lit(False)), "block").otherwise("allow"))
    return out.select(key, "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
