"""URL filters: rules first, then the empirical-Bayes reputation of the host; built-in functions only.

Labelled pages count as good or bad outcomes of their hosts. A host with few of them says little, so
its rate is shrunk towards that of its registered domain, the domain's towards that of its suffix,
and the suffix's towards the overall rate: each level's counts are added to a beta prior with the mean
of the level above. How strong a level's prior is, is estimated from how much the rates of its groups
differ beyond chance (moments of the beta-binomial). A host is blocked if the lower bound of its
posterior bad rate is above ``MOST_BAD``.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule, and the
verdict of the empty host; repeated rows are judged each; hosts without outcomes have their domain's
rate, or their suffix's or the overall one where that has none either, and are judged by the same
bound; with no outcomes at all, all are allowed but for rules; extra columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lower bounds are so many standard deviations below the posterior mean.
DEVIATIONS = 1.645
MOST_BAD = 0.5
WEAKEST, STRONGEST = 2.0, 1000.0
#: Common public suffixes of two labels.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.za", "co.jp", "ne.jp", "or.jp", "co.kr", "co.in", "com.br", "com.cn", "com.mx", "com.tr")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules in force.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without it."""
    return F.when(F.contains(url, F.lit("://")), F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest_rule(rules: tuple[Rule, ...], host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits; null if none does. Equal lengths: by name."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        chosen = F.when(fits(rule, host, path), F.lit(value(rule))).otherwise(chosen)
    return chosen


def bare(host: Column) -> Column:
    """The host without a user's name before it and a port after it."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")


def is_address(name: Column) -> Column:
    return name.rlike(r"^\d+\.\d+\.\d+\.\d+$|^\[")


def suffix_of(host: Column) -> Column:
    """The public suffix; a numeric address is its own."""
    name = bare(host)
    two = F.substring_index(name, ".", -2)
    return F.when(is_address(name), name).when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: one label more than the suffix; a numeric address is its own."""
    name = bare(host)
    two = F.substring_index(name, ".", -2)
    return F.when(is_address(name), name).when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def strength(groups: DataFrame) -> DataFrame:
    """One row (m, k): the overall bad rate, and how many outcomes the groups' common prior weighs."""
    totals = groups.agg(
        F.sum("n").alias("N"), F.sum("bad").alias("B"), F.count("*").alias("G"),
        F.sum(F.col("n") * F.col("n")).alias("Q"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("S"),
    )
    p = (F.coalesce("B", F.lit(0)) + 0.5) / (F.coalesce("N", F.lit(0)) + 1.0)
    t = totals.withColumn("m", p).withColumn("v", F.col("m") * (1 - F.col("m")))
    # between-group sum of squares, beyond what chance makes of it
    beyond = F.col("S") - 2 * F.col("m") * F.col("B") + F.col("m") * F.col("m") * F.col("N") - F.col("v") * (F.col("G") - 1)
    room = F.col("v") * (F.col("N") - F.col("Q") / F.col("N") - (F.col("G") - 1))
    rho = F.when((F.col("G") > 1) & (room > 0), beyond / room)
    k = F.when(rho > 0, F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), 1 / rho - 1))).otherwise(STRONGEST)
    return t.select("m", k.alias("k"))


def reputations(outcomes: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(host, rate, lower): posterior mean and lower bound of the bad rate of each host with outcomes
    (host, bad), and of each one in ``seen`` (host), whose posterior without outcomes is its prior."""
    counted = outcomes.select("host", F.lit(1).alias("n"), "bad")
    if seen is not None:
        counted = counted.union(seen.select("host", F.lit(0), F.lit(0)))
    hosts = counted.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    one = lambda df, level: F.broadcast(strength(df.where("n > 0")).select(F.col("m").alias(f"m{level}"), F.col("k").alias(f"k{level}")))

    s = suffixes.join(one(suffixes, "s")).select("suffix", ((F.col("bad") + F.col("ks") * F.col("ms")) / (F.col("n") + F.col("ks"))).alias("suffix_rate"))
    d = (
        domains.join(s, "suffix").join(one(domains, "d"))
        .select("domain", "suffix", ((F.col("bad") + F.col("kd") * F.col("suffix_rate")) / (F.col("n") + F.col("kd"))).alias("domain_rate"))
    )
    h = hosts.join(d, ["domain", "suffix"]).join(one(hosts, "h"))
    a = F.col("bad") + F.col("kh") * F.col("domain_rate")
    b = F.col("n") - F.col("bad") + F.col("kh") * (1 - F.col("domain_rate"))
    rate = a / (a + b)
    return h.select("host", rate.alias("rate"), (rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (a + b + 1))).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url); ``outcomes``:
    (host, bad 0 or 1), one row per labelled page."""
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    bad = reputations(outcomes, seen.select("host")).where(F.col("lower") > MOST_BAD).select("host", F.lit("block").alias("known"))
    host, path = F.col("host"), F.col("path")
    return seen.join(bad, "host", "left").select(
        "page_id", "host", "path",
        longest_rule(rules, host, path, lambda r: r.name).alias("rule"),
        F.coalesce(longest_rule(rules, host, path, lambda r: r.verdict), "known", F.lit("allow")).alias("verdict"),
    )


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): a page is a bad outcome if the document it shows, whose id is the first number in
    its URL's path, is labelled toxic or of low quality."""
    shown = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})", 1).alias("id"))
    bad = labels.groupBy("doc_id").agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
    return shown.where("id != ''").select("host", F.col("id").cast("long").alias("doc_id")).join(bad.where("bad is not null"), "doc_id").select("host", "bad")
