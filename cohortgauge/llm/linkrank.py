"""URL filtering by link-graph propagation; DataFrame functions only.

Rules judge the pages they fit. Their verdicts seed two personalised PageRanks over the
links between hosts: trust flows along links from hosts with allowed pages, distrust flows
against links from hosts with blocked pages. A page that no rule fits gets the verdict of
its host's two ranks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgauge.llm.tables import discard, stored

#: ``(verdict, host and path prefix)``.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
DAMPING = 0.85
#: Passes that the SQL unrolls.
PASSES = 40
#: Passes end when no rank changes by more than the tolerance. Each hands on ``DAMPING`` of all change, so
#: 300 are enough for 10**14 hosts; more raise.
MOST_PASSES, TOLERANCE = 300, 1e-6
#: Passes between two stored copies of the ranks.
LEG = 5
#: A host is blocked if its distrust is above its trust and above that of a host of which
#: this share of the pages is blocked and which nothing links to.
LIMIT = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links with a host of their own: ``//host`` after an optional scheme.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to a slash, question mark, hash or the end; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """Verdict and text of the longest rule that fits, as a struct; null if none does."""
    made = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        made = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(made)
    return made


def host_links(pages: DataFrame) -> DataFrame:
    """``source, target, pages``: links between different hosts, counted once a page."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda h: F.translate(h, UPPER, LOWER)))
    links = pages.where("host <> ''").select(F.col("host").alias("source"), F.explode(targets).alias("target"))
    return links.where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("pages"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, passes: int = MOST_PASSES, tolerance: float = TOLERANCE) -> DataFrame:
    """Trust and distrust per host from ``seeds(host, trust, distrust)``.

    A host hands on ``damping`` of its rank, shared out by page counts: trust to the hosts
    it links to, distrust to those that link to it. Both directions are one edge table and
    one join a pass. Ranks are stored every few passes, until they change by no more than
    ``tolerance``; an error says if that takes more than ``passes``.
    """
    both = links.select(F.col("source").alias("from"), F.col("target").alias("to"), F.lit(1).alias("trusts"), "pages").unionByName(
        links.select(F.col("target").alias("from"), F.col("source").alias("to"), F.lit(0).alias("trusts"), "pages")
    )
    out = both.groupBy("from", "trusts").agg(F.sum("pages").alias("all"))
    edges = stored(both.join(out, ["from", "trusts"]).select("from", "to", "trusts", (F.col("pages") / F.col("all")).alias("share")), "host-edges")
    start = stored(seeds.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust")), "seeds")

    def once(ranks: DataFrame) -> DataFrame:
        along = edges.join(ranks, F.col("from") == F.col("host")).select(
            F.col("to").alias("host"), (damping * F.col("share") * F.col("trusts") * F.col("trust")).alias("trust"),
            (damping * F.col("share") * (1 - F.col("trusts")) * F.col("distrust")).alias("distrust"),
        )
        return along.unionByName(start).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))

    ranks = start
    for _ in range(0, passes, LEG):
        before = ranks
        ranks = stored(reduce(lambda r, _: once(r), range(LEG), ranks), "host-ranks")
        old = before.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        moved = F.greatest(
            F.abs(F.col("trust") - F.coalesce("t", F.lit(0.0))), F.abs(F.col("distrust") - F.coalesce("d", F.lit(0.0)))
        )
        change = ranks.join(old, "host", "left").agg(F.max(moved)).first()[0]
        if before is not start:
            discard(before)
        if change is None or change <= tolerance:
            return ranks
    raise RuntimeError(f"ranks still change by more than {tolerance} after {passes} passes")


def judge_pages(pages: DataFrame, rules: list[tuple[str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every page.

    A rule's verdict stands for the pages it fits. A page without a rule is blocked where
    its host's distrust exceeds both its trust and ``limit`` times the rank that a fully
    blocked host starts with, and allowed otherwise: also where the url is null or names
    no host. Null html has no links. Repeated rows are judged alike.
    """
    url = F.col("url").cast("string")
    read = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = read.withColumn("fit", fit)
    share = lambda verdict: F.avg(F.coalesce((F.col("fit.verdict") == verdict).cast("double"), F.lit(0.0)))
    seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    ranks = propagate(host_links(read), seeds)
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= limit * (1 - DAMPING))
    known = judged.drop("html").join(ranks, "host", "left")
    return known.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
