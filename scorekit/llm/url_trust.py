"""URL filter: host and path rules first, and for what they leave open, trust and distrust spread over the host graph.

Trust is personalised PageRank from trusted hosts along links, distrust the same from blocked hosts against them: a
host that links to blocked ones comes to be blocked, one that trusted hosts link to is safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import drop_path, materialize
from .common import LOWER, UPPER, materialize_at, small_side

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
LINK_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"

# (host, path, verdict)
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null without one. For a few rules: each is an expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``places`` (host, path and others) with ``rule`` and ``ruled``, text and verdict of the longest fitting rule, or nulls.

    ``rules`` is a table (host, path, verdict) of any size. Each different place gives the suffixes of its host, at dots, and
    those prefixes of its path whose length is that of some rule's path; their join with the rules finds all that fit.
    No suffix has more labels than the longest rule, so hosts of very many labels cost no more than others. Of rules of
    equal length the one with the greater host, path and verdict wins; rules with a null in them fit nothing.
    """
    known = rules.select("host", "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").distinct()
    known = materialize(known, "rules")
    shape = known.agg(
        F.count("*").alias("n"), F.sum(F.octet_length(F.concat("host", "path", "verdict"))).alias("bytes"),
        F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()  # as many as the longest path has characters
    if not shape["n"]:
        return places.withColumns({"rule": F.lit(None).cast("string"), "ruled": F.lit(None).cast("string")})
    lengths = F.array(*[F.lit(n) for n in sorted(shape["lengths"])])

    def suffixes(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(shape["labels"]))), lambda n: F.array_join(F.slice(parts, -n, n), "."))

    heads = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    seen = places.select("host", "path").distinct()
    tries = seen.select("host", "path", F.explode(suffixes(F.split("host", r"\."))).alias("_host")).select("host", "path", "_host", F.explode(heads).alias("_path"))
    side = small_side(known.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "verdict"), 1, (shape["bytes"] or 0) + 128 * shape["n"])
    rank = F.struct((F.length("_host") + F.length("_path")).alias("n"), "_host", "_path", "verdict")
    best = tries.join(side, ["_host", "_path"]).groupBy("host", "path").agg(F.max(rank).alias("best"))
    best = best.select("host", "path", F.concat("best._host", "best._path").alias("rule"), F.col("best.verdict").alias("ruled"))
    return places.join(best, ["host", "path"], "left")


def host_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Links between different hosts (src, dst, links). Relative links stay on their host and are no edge."""
    found = pages.select(url_host(F.col(url)).alias("src"), F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HREF), 1).alias("hrefs"))
    far = F.transform(
        F.filter("hrefs", lambda h: h.rlike(LINK_HOST)), lambda h: F.translate(F.regexp_extract(h, LINK_HOST, 1), UPPER, LOWER))
    pairs = found.select("src", F.explode(far).alias("dst"))
    return pairs.where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """Personalised PageRank of trust along ``edges`` (src, dst, links) and of distrust against them.

    ``seeds`` has host, trust and distrust; either may be zero. Returns host, trust, distrust, each summing to one over
    all hosts, or being zero where there is no seed. Mass of hosts without links goes back to the seeds, which scales
    all ranks alike and so is left to the closing division. Runs until no round moves more than ``tolerance`` of the
    mass, which damping brings about in some 85 rounds; raises if ``rounds`` are not enough.
    """
    along = edges.select(F.lit(True).alias("good"), F.col("src").alias("a"), F.col("dst").alias("b"), "links")
    against = edges.select(F.lit(False).alias("good"), F.col("dst").alias("a"), F.col("src").alias("b"), "links")
    both = along.unionByName(against)
    total = both.groupBy("good", "a").agg(F.sum("links").alias("total"))
    steps = materialize(both.join(total, ["good", "a"]).select("good", "a", "b", (F.col("links") / F.col("total")).alias("share")), "steps")

    kinds = F.array(F.struct(F.lit(True).alias("good"), F.col("trust").alias("mass")), F.struct(F.lit(False).alias("good"), F.col("distrust").alias("mass")))
    start = seeds.select("host", F.explode(kinds).alias("k")).select("k.good", "host", "k.mass").where("mass > 0")
    sums = start.groupBy("good").agg(F.sum("mass").alias("sum"))
    start = materialize(start.join(F.broadcast(sums), "good").select("good", "host", (F.col("mass") / F.col("sum")).alias("mass")), "seeds")

    ranks, spent = start, None
    if not steps.isEmpty():
        for _ in range(rounds):
            sent = ranks.join(steps, (ranks.good == steps.good) & (ranks.host == steps.a)).select(
                steps.good, F.col("b").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"), F.lit(0.0).alias("old"))
            parts = start.withColumn("old", F.lit(0.0)).unionByName(sent).unionByName(
                ranks.select("good", "host", F.lit(0.0).alias("mass"), F.col("mass").alias("old")))
            moved, path = materialize_at(parts.groupBy("good", "host").agg(F.sum("mass").alias("mass"), F.sum("old").alias("old")), "ranks")
            if spent is not None:
                drop_path(edges.sparkSession, spent)  # nothing reads the round before last any more
            spent = path
            ranks = moved.select("good", "host", "mass")
            change = moved.agg(F.sum(F.abs(F.col("mass") - F.col("old"))).alias("change"), F.sum("mass").alias("mass")).first()
            if (change["change"] or 0.0) <= tolerance * (change["mass"] or 1.0):
                break
        else:
            raise RuntimeError(f"ranks still move after {rounds} rounds")
    sums = ranks.groupBy("good").agg(F.sum("mass").alias("sum"))
    ranks = ranks.join(F.broadcast(sums), "good").select("good", "host", (F.col("mass") / F.col("sum")).alias("mass"))
    of = lambda good: F.coalesce(F.sum(F.when(F.col("good") == good, F.col("mass"))), F.lit(0.0))
    return ranks.groupBy("host").agg(of(True).alias("trust"), of(False).alias("distrust"))


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, page_id: str = "page_id", url: str = "url",
    html: str = "html", majority: float = 0.5, ratio: float = 1.0,
) -> DataFrame:
    """A verdict on every page: that of the longest rule that fits its url, else that of its host.

    ``rules`` are a few (host, path, verdict), or a table with these columns, see :func:`match_rules`. A host is a trusted (blocked) seed, with its number of pages as weight, if rules allow (block) more than ``majority``
    of its pages. It is blocked if its distrust exceeds ``ratio`` times its trust. Hosts that neither reaches, and urls
    without a host, are allowed. Returns one row per input row: ``page_id, host, path, rule, verdict, trust, distrust``;
    a null url, or one without ``://``, has an empty host and path.
    """
    judged = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if isinstance(rules, DataFrame):
        judged = materialize(match_rules(judged, rules), "ruled")
    else:
        rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
        judged = judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))

    def votes(v: str) -> Column:
        return F.count(F.when(F.col("ruled") == v, 1))

    hosts = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), votes("allow").alias("ok"), votes("block").alias("bad"))
    share = lambda c: F.when(F.col(c) > majority * F.col("n"), F.col("n")).otherwise(0).cast("double")
    seeds = materialize(hosts.select("host", share("ok").alias("trust"), share("bad").alias("distrust")), "hosts")
    ranks = materialize(propagate(host_edges(pages, url, html), seeds), "trust")

    out = judged.join(small_side(ranks, ranks.count(), 128), "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    spread = F.when(distrust > ratio * trust, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", spread).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
