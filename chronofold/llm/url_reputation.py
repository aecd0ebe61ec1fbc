"""URL filtering by rules and by an empirical-Bayes reputation of hosts.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix. Each level's rate has a
beta-binomial prior: its mean is the shrunken rate of the level above, its strength is fitted by moments over the units of
the level. A page without a rule is blocked where the lower bound of its host's posterior bad rate exceeds a limit.

Only DataFrame operations. Outcomes are counted by host once, before they are shuffled, so a host with most of the pages is one
row; the counts are saved, and the levels above are sums of them. Pages meet their host's verdict in a sort-merge or
broadcast join, as its size decides, whose hot partitions adaptive execution splits.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the reputation of
the empty host; a url of any length is read whole; pages without a known outcome count in no rate; repeated rows are judged
alike (their outcomes count once a row); a host that no outcome row names has no rate and is allowed; a bound equal to the
limit allows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.scratch import Scratch

#: Second-level labels under which country domains are registered one label deeper.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Standard deviations that the bound lies below the posterior mean.
BOUND_SD = 1.0
#: Bad rate that the bound must exceed for a host to be blocked.
LIMIT = 0.5
MIN_STRENGTH, MAX_STRENGTH = 2.0, 200.0


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without ``://``."""
    host = _lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def _bare(host: Column) -> Column:
    """Without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")


def registered_domain(host: Column) -> Column:
    """The last two labels, three below a country's second level; an address or a single label is its own."""
    parts = F.split(_bare(host), r"\.")
    n = F.size(parts)
    deep = (n >= 3) & (F.length(F.get(parts, n - 1)) == 2) & F.get(parts, n - 2).isin(*SECOND_LEVEL)
    take = F.when(deep, 3).otherwise(2)
    address = F.regexp_like(_bare(host), F.lit(r"^[\d.]+$"))
    return F.when(address | (n <= 2), _bare(host)).otherwise(F.array_join(F.slice(parts, -take, take), "."))


def suffix(domain: Column) -> Column:
    """What follows the first label of a registered domain; empty for a single label."""
    return F.regexp_extract(domain, r"^[^.]*\.(.*)$", 1)


def matching_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls: rules are few, so this is one CASE over them."""
    def fits(r: UrlRule) -> Column:
        return ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)

    def first(value) -> Column:
        ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
        return reduce(lambda c, r: c.when(fits(r), F.lit(value(r))), ordered[1:], F.when(fits(ordered[0]), F.lit(value(ordered[0])))) if ordered else F.lit(None).cast("string")

    return first(lambda r: r.text), first(lambda r: r.verdict)


def _shrunk(level: DataFrame, prior: str) -> DataFrame:
    """Adds ``rate``, the posterior mean of each unit, and ``strength``, from columns n, bad and the prior mean.

    Strength by moments over units with outcomes: with m the prior mean and s the strength, n (bad/n - m)^2 / (m (1-m)) is
    1 + (n-1) / (s+1) on average; solved for s and kept in limits. The sums are one row.
    """
    q = F.greatest(F.col(prior) * (1 - F.col(prior)), F.lit(1e-6))
    sums = level.where("n > 0").agg(
        F.coalesce(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col(prior), 2) / q), F.lit(0.0)).alias("seen"),
        F.count("*").alias("units"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("more"),
    ).first()
    over = max(0.0, sums["seen"] - sums["units"])
    s = MAX_STRENGTH if over * MAX_STRENGTH <= sums["more"] else sums["more"] / over - 1
    s = min(MAX_STRENGTH, max(MIN_STRENGTH, s))
    return level.withColumn("strength", F.lit(s)).withColumn("rate", (F.col("bad") + s * F.col(prior)) / (F.col("n") + s))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """host, bad (1, 0, or null where it isn't known) of pages -> host, n, bad, posterior mean and lower bound of its bad rate.

    A host without known outcomes has the posterior mean of its domain, a domain that of its suffix.
    """
    scratch = Scratch(outcomes.sparkSession)
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = scratch.save(hosts.withColumn("domain", registered_domain(F.col("host"))), "hosts")
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = scratch.save(domains.withColumn("suffix", suffix(F.col("domain"))), "domains")
    suffixes = scratch.save(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)
    top = _shrunk(suffixes.withColumn("prior", F.lit(overall)), "prior").select("suffix", F.col("rate").alias("prior"))
    middle = _shrunk(domains.join(top, "suffix"), "prior").select("domain", F.col("rate").alias("prior"))
    low = _shrunk(hosts.join(middle, "domain"), "prior")
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("strength") + 1))
    return low.select("host", "n", F.col("bad"), "rate", (F.col("rate") - BOUND_SD * spread).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple[UrlRule, ...] = RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, url of pages and host, bad of the outcomes of all pages -> page_id, host, path, rule, verdict, n_outcomes, bad_rate, bad_rate_bound (those of the host)."""
    known = host_reputation(outcomes).select("host", F.col("n").alias("n_outcomes"), F.col("rate").alias("bad_rate"), F.col("bound").alias("bad_rate_bound"))
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = rows.withColumn("rule", rule).withColumn("by_rule", verdict).join(known, "host", "left")
    own = F.when(F.col("bad_rate_bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "n_outcomes", "bad_rate", "bad_rate_bound")
