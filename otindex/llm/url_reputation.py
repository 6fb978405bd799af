"""URL filter: explicit host rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (good or bad) are counted per host. A host's bad rate is shrunk towards its
registered domain, the domain towards its public suffix, the suffix towards the whole table: each
level is a beta-binomial whose prior mean is the posterior mean of the level above and whose strength
comes from the spread of the rates at that level (method of moments). A host is blocked when the lower
bound of its posterior bad rate exceeds the tolerated rate, so few labels never block a host.

Everything is a grouped sum (combined before the shuffle, so a host with a third of all pages is no
burden) and joins of narrow rows; texts are never read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otindex.session import broadcast_if_small, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Suffixes of two labels under which names are registered.
SUFFIXES = (
    "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br",
    "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk",
)

#: Blocked hosts up to which they are broadcast.
BROADCAST_HOSTS = 500_000


class Rule(NamedTuple):
    """A verdict for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits as ``struct(rule, verdict)``, or null. Equal lengths: block wins."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    if not ordered:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    cases = []
    for rule in ordered:
        inside = (host == F.lit(rule.host)) | host.endswith("." + rule.host)
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        cases.append(F.when(inside & path.startswith(rule.path), value))
    return F.coalesce(*cases)


def public_suffix(host: Column) -> Column:
    """The last label, or the last two where those are a known suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column) -> Column:
    """One label more than the public suffix."""
    labels = F.when(F.substring_index(host, ".", -2).isin(*SUFFIXES), F.lit(3)).otherwise(F.lit(2))
    return F.when(labels == 3, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _strength(level: DataFrame, least: float = 1e-3, most: float = 0.5) -> tuple[float, float]:
    """Pooled bad rate and prior strength of a level, by moments of its groups' rates (one row)."""
    n, b = F.col("n"), F.col("bad")
    row = level.where(n > 0).agg(
        F.count(F.lit(1)).alias("g"),
        F.sum(n).alias("n"),
        F.sum(b).alias("b"),
        F.sum((n * n).cast("double")).alias("nn"),
        F.sum((b * b).cast("double") / n).alias("bb"),
    ).first()
    if not row["n"]:
        return 0.0, 1.0
    g, total, bad = row["g"], float(row["n"]), float(row["b"])
    rate = bad / total
    spread, free = rate * (1 - rate), total - row["nn"] / total
    if spread <= 0 or free <= 0 or g < 2:
        return rate, 1 / least - 1
    between = (row["bb"] - bad * bad / total) - spread * (g - 1)
    share = between / (spread * (free - (g - 1))) if free != g - 1 else 0.0
    share = min(most, max(least, share))
    return rate, 1 / share - 1


def host_reputation(hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, n, bad, mean, lower): posterior bad rate of each host and its lower bound.

    ``hosts`` holds (host, n, bad) with one row per host; hosts without labels have n = 0 and get
    the rate of their domain. ``z`` is the number of posterior standard deviations below the mean.
    """
    hosts = materialize(
        hosts.select("host", "n", "bad").withColumns(
            {"domain": registered_domain(F.col("host")), "suffix": public_suffix(F.col("host"))}
        )
    )
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = materialize(hosts.groupBy("domain", "suffix").agg(*sums))
    suffixes = materialize(domains.groupBy("suffix").agg(*sums))
    rate, k_suffix = _strength(suffixes)
    _, k_domain = _strength(domains)
    _, k_host = _strength(hosts)

    def shrunk(prior: Column, k: float) -> Column:
        return (F.col("bad") + F.lit(k) * prior) / (F.col("n") + F.lit(k))

    top = suffixes.select("suffix", shrunk(F.lit(rate), k_suffix).alias("top"))
    middle = domains.join(broadcast_if_small(top, BROADCAST_HOSTS), "suffix").select(
        "domain", "suffix", shrunk(F.col("top"), k_domain).alias("prior")
    )
    mean = shrunk(F.col("prior"), k_host)
    wide = F.sqrt(mean * (1 - mean) / (F.col("n") + F.lit(k_host + 1)))
    return hosts.join(middle, ["domain", "suffix"]).select(
        "host", "n", "bad", mean.alias("mean"), (mean - F.lit(z) * wide).alias("lower")
    )


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[Rule],
    tolerated: float = 0.5,
    z: float = 1.645,
) -> DataFrame:
    """Judge every page: (page_id, host, path, rule, verdict, method).

    ``pages`` needs page_id and url, ``outcomes`` page_id and a boolean ``bad``; other columns are
    ignored. A null url, or one without ``://``, has an empty host and path, and hosts are compared as
    they stand. Repeated pages give repeated rows. Several outcomes of one page count as one, bad if
    any is; null outcomes do not count. A page whose id is null has no outcome.
    ``method`` says whether a rule, the reputation or nothing decided.
    """
    judged = pages.select(
        "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")
    ).withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    labels = outcomes.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    labelled = judged.select("page_id", "host").join(labels, "page_id", "left")
    hosts = labelled.groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")
    )
    reputation = host_reputation(hosts, z)
    blocked = materialize(reputation.where(F.col("lower") > F.lit(tolerated)).select("host", F.lit(True).alias("_bad")))
    by_rule, by_host = F.col("_rule").isNotNull(), F.col("_bad").isNotNull()
    return judged.join(broadcast_if_small(blocked, BROADCAST_HOSTS), "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.when(by_rule, F.col("_rule.verdict")).when(by_host, "block").otherwise("allow").alias("verdict"),
        F.when(by_rule, "rule").when(by_host, "reputation").otherwise("default").alias("method"),
    )
