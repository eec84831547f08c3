"""URL filter by rules and, where none fits, by empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted per host. A level's rates are
shrunk to those of the level above it, from host to registered domain to
suffix to all pages: a beta prior around the level above, whose strength
follows from how much the rates of the level differ (method of moments). A
host is bad if the lower posterior bound of its rate of bad pages is over
``LIMIT``. A host that has no labelled page has its domain's rate, and so on.

Counting has map-side sums and one row per host; a page meets its host's
verdict in a join that the planner may broadcast by the real size or split
where one host holds many pages.

Null urls and urls without ``://`` have an empty host and path. Rows that
repeat a page are judged each on their own. Without outcomes every host is
good. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Suffixes of two labels under which hosts are registered.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "or.jp", "co.nz", "com.br", "co.in")
BOUND = 1.645  # standard deviations: the lower bound holds with 95 %
COST = 1.0  # of a page blocked wrongly, where one passed wrongly costs 1


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + path)


# The rules of the query.
RULES = tuple(rule(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
                                 ("allow", "com/fr/"), ("block", "com/de/")))


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a domain above it and the start of the path."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # longer rules overrule
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; a host without a dot is both."""
    two = F.substring_index(host, ".", -2)
    long = two.isin(*LONG_SUFFIXES)
    suffix = F.when(long, two).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(long, F.substring_index(host, ".", -3)).otherwise(two)
    return domain, suffix


def _strength(rates: DataFrame) -> float:
    """Beta prior strength from the spread of a level's rates (``n``, ``bad``) around their prior means (``mean``).

    The squared differences beyond what binomial counts explain are the
    variance of the true rates; a beta of mean m has variance m (1 - m) / (s + 1).
    """
    mean = F.col("mean")
    row = rates.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - mean, 2)).alias("spread"),
        F.sum(mean * (1 - mean)).alias("chance"), F.sum(F.col("n") * mean * (1 - mean)).alias("scale")).first()
    if not row["scale"]:
        return 10.0
    # E spread = chance + (scale - chance) / (s + 1), by the beta-binomial's variance
    extra = max(row["spread"] - row["chance"], 1e-9)
    room = max(row["scale"] - row["chance"], 1e-9)
    return float(min(max(room / extra - 1, 0.5), 1e4))


def reputation(pages: DataFrame, bound: float = BOUND) -> DataFrame:
    """``host``, ``rate`` and ``low`` (posterior mean and lower bound of the bad share) of every host of ``pages``
    (``host``, ``bad``: 1 or 0, null where no outcome is known)."""
    domain, suffix = levels(F.col("host"))
    known = F.col("bad").isNotNull()
    hosts = (pages.groupBy("host").agg(F.count_if(known).cast("double").alias("n"),
                                       F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
             .withColumn("domain", domain).withColumn("suffix", suffix))
    hosts = _written(hosts, "hosts")
    # From the top down: a level's prior mean is the rate of the level above without the level's own pages, so
    # that no page counts twice. The top is a beta of mean a half and strength 2 over all pages.
    top = hosts.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("n", "bad")]).first()
    above = None
    for level, parent in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        own = hosts.groupBy(*filter(None, (level, parent))).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        own = own.join(above, parent) if parent else own.withColumns(
            {"n_above": F.lit(top["n"]), "bad_above": F.lit(top["bad"]), "mean_above": F.lit(0.5), "s_above": F.lit(2.0)})
        mean = (F.col("bad_above") - F.col("bad") + F.col("s_above") * F.col("mean_above")) / (
            F.col("n_above") - F.col("n") + F.col("s_above"))
        own = own.select(level, "n", "bad", mean.alias("mean"))
        s = _strength(own)
        above = own.select(level, *[F.col(c).alias(f"{c}_above") for c in ("n", "bad", "mean")], F.lit(s).alias("s_above"))
    own = own.withColumn("_weight", F.col("n") + F.lit(s)).withColumn(
        "rate", (F.col("bad") + F.lit(s) * F.col("mean")) / F.col("_weight"))
    # Wilson's lower bound at the posterior's weight: unlike a normal bound it stays wide where little is known.
    rate, n, z2 = F.col("rate"), F.col("_weight"), bound * bound
    low = (rate + z2 / (2 * n) - bound * F.sqrt(rate * (1 - rate) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return own.select("host", "rate", F.greatest(low, F.lit(0.0)).alias("low"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, outcomes: DataFrame | None = None, cost: float = COST) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``rate`` and ``low`` of every page.

    ``outcomes`` (``host``, ``bad``) are the labelled pages; without any, the
    pages that a rule decides are the labelled ones. A page that no rule decides
    is blocked if that costs less than passing it for sure: if its host's share
    of bad pages is, by its lower bound, over cost / (1 + cost). Repeated page ids are judged row by row; other columns of ``pages``
    play no part.
    """
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    text, verdict = fitting(rules, F.col("host"), F.col("path"))
    ruled = split.withColumn("rule", text).withColumn("_verdict", verdict)
    labelled = outcomes.select("host", F.col("bad").cast("int").alias("bad")) if outcomes is not None else ruled.select(
        "host", F.when(F.col("_verdict") == "block", 1).when(F.col("_verdict") == "allow", 0).alias("bad"))
    if outcomes is not None:
        labelled = labelled.unionByName(ruled.select("host", F.lit(None).cast("int").alias("bad")))
    judged = _written(reputation(labelled), "reputation")
    method = F.when(F.col("low") > cost / (1 + cost), "block").otherwise("allow")
    return ruled.join(judged, "host").select(
        "page_id", "host", "path", "rule", F.coalesce("_verdict", method).alias("verdict"), "rate", "low")
