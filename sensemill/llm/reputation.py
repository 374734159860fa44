"""Host reputation by empirical Bayes: beta-binomial shrinkage from suffix to registered domain to host.

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Width of the posterior bound, in standard deviations, and the share of good pages that a blocked host surely misses.
Z = 1.645
THRESHOLD = 0.5
#: Limits of the estimated prior strength, in pages.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0

# Labels that, before a country's two letters, belong to the suffix ("co.uk").
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "mil", "ne", "net", "or", "org")


@dataclass(frozen=True)
class Rule:
    """Fits a host and all its subdomains where the path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest ends up outermost
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def public_suffix(host: Column) -> Column:
    """The last label, or the last two where they are like "co.uk"."""
    two = F.substring_index(host, ".", -2)
    return F.when(F.regexp_like(two, F.lit(rf"^(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$")), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column, suffix: Column) -> Column:
    """The suffix and one label more; a host without one is its own domain."""
    return F.when(F.instr(suffix, ".") == 0, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -3))


def _strength(units: DataFrame) -> tuple[float, float]:
    """Overall share of good outcomes and prior strength of one level, by moments of the beta-binomial.

    One row comes back, whatever the number of units.
    """
    n, g = F.col("n").cast("double"), F.col("good").cast("double")
    r = units.where("n > 0").agg(F.sum("n").alias("n"), F.sum("good").alias("g"), F.sum(g * g / n).alias("gg"), F.sum(n * n).alias("nn"), F.count("*").alias("k")).first()
    if not r.n:
        return 0.5, LEAST_STRENGTH
    total, p = float(r.n), float(r.g) / float(r.n)
    within = p * (1 - p)
    room = total - r.nn / total - (r.k - 1)
    if within <= 0 or room <= 0:
        return (float(r.g) + 1) / (total + 2), LEAST_STRENGTH
    rho = (r.gg - total * p * p - within * (r.k - 1)) / (within * room)
    strength = MOST_STRENGTH if rho <= 1 / (MOST_STRENGTH + 1) else max(LEAST_STRENGTH, 1 / rho - 1)
    return (float(r.g) + 1) / (total + 2), strength


def reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior of the share of good pages for every host.

    ``outcomes`` has host and good (boolean; null where a page has no label).  The
    overall share shrinks the suffixes' shares, these the registered domains', these
    the hosts', each by a strength estimated over its level.  Hosts without labels
    get their domain's posterior mean.  Returns host, n, good, mean, upper.
    """
    hosts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.count_if(F.col("good")).alias("good"))
    hosts = hosts.withColumn("suffix", public_suffix(F.col("host"))).withColumn("domain", registered_domain(F.col("host"), F.col("suffix")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    overall, s3 = _strength(suffixes)
    s2, s1 = _strength(domains)[1], _strength(hosts)[1]
    shrunk = lambda mean, s: (F.col("good") + s * mean) / (F.col("n") + s)
    by_suffix = suffixes.select("suffix", shrunk(F.lit(overall), s3).alias("suffix_mean"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", shrunk(F.col("suffix_mean"), s2).alias("domain_mean"))
    a = F.col("good") + s1 * F.col("domain_mean")
    b = F.col("n") - F.col("good") + s1 * (1 - F.col("domain_mean"))
    mean = a / (a + b)
    return hosts.join(by_domain, "domain").select("host", "n", "good", mean.alias("mean"), (mean + Z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("upper"))


def judge_urls(spark: SparkSession, pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """host, path, rule and verdict (allow or block) of every page.

    The longest fitting rule decides.  Pages that rules decide are the labelled
    outcomes; every other page goes by its host's posterior: blocked where even the
    upper bound of the share of good pages stays below ``threshold``.

    Null URLs and those without ``://`` have an empty host and path and the posterior
    of the empty host.  Repeated rows and null ids stay, each judged alone; very long
    URLs are like others, and other columns don't matter.  The
    hosts' table is written first: its size on disk, not a guess, decides whether
    the join broadcasts it; otherwise both sides are exchanged and a hot host's
    pages can be split.
    """
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = parse_url(F.col("url"))
    judged = read.select("page_id", host.alias("host"), path.alias("path"))
    rule, by_rule = longest_rule(rules, F.col("host"), F.col("path"))
    judged = judged.select("page_id", "host", "path", rule.alias("rule"), by_rule.alias("by_rule"))
    known = Workspace(spark, "reputation").keep(reputation(judged.select("host", (F.col("by_rule") == "allow").alias("good"))), "hosts")
    return judged.join(known, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", F.when(F.col("upper") < threshold, "block").otherwise("allow")).alias("verdict"),
        F.col("mean").alias("host_mean"),
        F.col("upper").alias("host_upper"),
    )
