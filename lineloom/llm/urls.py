"""URL filter: explicit rules, and for all other hosts trust and distrust spread over the graph of links.

Hosts are nodes; a link in a page's HTML to another host is an edge. Personalised PageRank from the hosts of allowed pages
along the links gives trust, the same from the hosts of blocked pages against the links gives distrust
(who links to blocked hosts is suspect). A host whose distrust outweighs its trust is blocked. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.llm.common import cut

#: Fixed values: (host, path, verdict) of the default rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]++)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` in lower case, and the path behind it; both empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst): distinct links between different hosts. ``pages`` has host and html."""
    to = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_HREF), 1))).alias("url"))
    return to.where(F.instr("url", "://") > 0).select("src", host_and_path(F.col("url"))[0].alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct()


#: Ranks have settled when a few rounds change their sum by less than this in all and reach no further host.
TOLERANCE = 1e-6


def personalised_rank(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, cut_every: int = 4) -> DataFrame:
    """(host, rank): PageRank that restarts in ``seeds`` (host, share; shares sum to 1), over distinct ``links`` (src, dst).

    Each round joins the ranks to the links by source and sums by target, with sums before the shuffle. Every few
    rounds a reliable checkpoint ends the plan. Without ``rounds`` it goes on until the ranks have settled and every host that
    links lead to is reached. Rank that reaches a host without links ends there; as a share of the sum of all ranks a host has what it would have
    if such rank went back to the seeds.
    """
    out = links.groupBy("src").agg(F.count("*").alias("n"))
    arcs = cut(links.join(out, "src").select("src", "dst", (F.lit(damping) / F.col("n")).alias("pass")))
    base = seeds.select("host", ((1 - damping) * F.col("share")).alias("rank"))
    rank = last = base
    k = 0
    while rounds is None or k < rounds:
        got = rank.join(arcs, rank.host == arcs.src).select(F.col("dst").alias("host"), (F.col("rank") * F.col("pass")).alias("rank"))
        rank = got.unionByName(base).groupBy("host").agg(F.sum("rank").alias("rank"))
        k += 1
        if k % cut_every == 0:
            rank = cut(rank)
            if rounds is None:
                both = rank.select("host", F.col("rank").alias("now")).join(last.select("host", F.col("rank").alias("was")), "host", "full_outer")
                change, reached = both.agg(F.sum(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))), F.count_if(F.col("was").isNull())).first()
                if (change or 0.0) < TOLERANCE and not reached:
                    break
                last = rank
    return rank


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 1.0, damping: float = 0.85, rounds: int | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict (allow or block), trust, distrust (of its host).

    A rule decides where one fits. Any other page is blocked when its host's distrust is over ``threshold`` times its trust.
    A url that is null or has no ``://`` has an empty host, which no rule and no link reaches: it is allowed. Null
    HTML has no links. Ids may be null or repeat; an empty table gives an empty result; other columns are not read.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    p = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).cast("string").alias("html"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = p.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))
    links = cut(host_links(p))
    counts = cut(ruled.where("ruled is not null").groupBy("host", "ruled").agg(F.count("*").alias("n")))
    ranks = []
    for which, arcs in (("allow", links), ("block", links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))):
        own = counts.where(F.col("ruled") == which)
        total = own.agg(F.sum("n")).first()[0] or 1
        rank = cut(personalised_rank(arcs, own.select("host", (F.col("n") / F.lit(total)).alias("share")), damping, rounds))
        whole = rank.agg(F.sum("rank")).first()[0] or 1.0
        ranks.append(rank.withColumn("rank", F.col("rank") / F.lit(whole)))
    trust, distrust = ranks[0].withColumnRenamed("rank", "trust"), ranks[1].withColumnRenamed("rank", "distrust")
    score = cut(trust.join(distrust, "host", "full_outer").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    both = ruled.join(score, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    by_rank = F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow")
    return both.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_rank).alias("verdict"), "trust", "distrust")
