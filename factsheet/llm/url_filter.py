"""Host reputation from labelled pages, by beta-binomial shrinkage. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from factsheet.llm.common import LOWER, UPPER, checkpointed, spread_join

#: Rules of the query: fixed values.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: Labels under which country suffixes give out names, as ``co.uk`` does: fixed values.
REGISTRIES = "ac co com edu gob gov go gouv mil ne net nom or org sch".split()
#: A suffix: a registry of a country, else the last label. After a boundary, so that ``xco.uk`` is a name under ``uk``.
SUFFIX = rf"(?:(?:{'|'.join(REGISTRIES)})\.[a-z][a-z]|[^.]+)$"
IN_SUFFIX, IN_DOMAIN = rf"(?:^|\.)({SUFFIX})", rf"(?:^|\.)((?:[^.]+\.)?{SUFFIX})"
ADDRESS = r"^(?:[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*\])$"


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def bare(host: Column) -> Column:
    """A host without user, port and dots at its end."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.*(?::[0-9]*)?$", "")


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix. An address is a domain of its own, and all addresses have one suffix, ``[ip]``."""
    name = bare(host)
    address = name.rlike(ADDRESS)
    domain, suffix = F.regexp_extract(name, IN_DOMAIN, 1), F.regexp_extract(name, IN_SUFFIX, 1)
    return F.when(address, name).otherwise(domain), F.when(address, "[ip]").otherwise(suffix)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null if none does.

    A rule fits its host and the hosts under it, for paths that begin with the rule's. Of two with equal
    length, the earlier wins.
    """
    tests = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        tests.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*tests)


def reputation(outcomes: DataFrame, hosts: DataFrame, z: float) -> DataFrame:
    """For each of ``hosts``, ``bad_rate`` and ``bad_at_least``: mean and lower bound of its bad pages' share.

    ``outcomes`` has ``host`` and ``bad`` (true or false), a row for each labelled page. Each level's rate is a
    beta-binomial posterior whose prior has the mean of the level above: all pages (as if ten more were labelled,
    one of them bad), public suffix, registered domain, host (see ``levels``). A level's prior strength comes from the spread of its units by
    moments: rho = (sum (k - n m)^2 - sum n m (1 - m)) / sum n (n - 1) m (1 - m), strength 1 / rho - 1, with
    rho held between 0.001 and 0.5, and 0.1 where no unit has two labelled pages. The bound is the posterior mean less ``z`` standard deviations. A host
    without labelled pages has its domain's rate with no more than the prior's weight.
    """
    domain, suffix = levels(F.col("host"))
    counted = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    units = checkpointed(
        hosts.join(counted, "host", "left").na.fill(0, ["n", "k"])
        .withColumn("domain", domain)
        .withColumn("suffix", suffix)
    )
    domains = checkpointed(units.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = checkpointed(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    overall = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 10)).alias("m")).scalar()

    def shrunk(rows: DataFrame, mean: Column) -> DataFrame:
        rows, m, n, k = rows.withColumn("m", mean), F.col("m"), F.col("n"), F.col("k")
        spread = F.sum((k - n * m) * (k - n * m)) - F.sum(n * m * (1 - m))
        rho = F.greatest(F.lit(0.001), F.least(F.lit(0.5), F.coalesce(F.try_divide(spread, F.sum(n * (n - 1) * m * (1 - m))), F.lit(0.1))))
        return rows.withColumn("s", rows.agg((1 / rho - 1).alias("s")).scalar()).withColumn("rate", (F.col("s") * m + k) / (F.col("s") + n))

    by_suffix = shrunk(suffixes, overall).select("suffix", F.col("rate").alias("above"))  # each level reads what was counted once
    by_domain = shrunk(spread_join(domains, by_suffix, "suffix", ["domain"]), F.col("above")).select("domain", F.col("rate").alias("above"))
    by_host = shrunk(spread_join(units, by_domain, "domain", ["host"]), F.col("above"))
    rate = F.col("rate")
    deviation = F.sqrt(rate * (1 - rate) / (F.col("s") + F.col("n") + 1))
    return by_host.select("host", rate.alias("bad_rate"), (rate - z * deviation).alias("bad_at_least"))


def judge(pages: DataFrame, outcomes: DataFrame, *, rules: Sequence[tuple[str, str]] = RULES, z: float = 2.0, worst: float = 0.5) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``bad_rate``, ``bad_at_least`` and ``verdict``.

    ``outcomes`` has ``page_id`` and ``bad`` for the labelled pages, at most a row each; a null is no label.
    The longest fitting rule decides. Else a host is blocked if its share of bad pages is above ``worst`` with
    the certainty that ``z`` asks for. Pages without a host are judged as hosts named by the empty text.
    Repeated pages are judged alike; an empty table gives an empty one. Pages of one host may be any share of the table: they are counted before
    the shuffle, and looked up over many tasks.
    """
    parts = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    labelled = outcomes.filter(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = parts.select("page_id", "host").join(labelled, "page_id").filter(F.col("bad").isNotNull())
    standing = reputation(seen, parts.select("host").distinct(), z)
    judged = spread_join(parts.withColumn("_fit", rule_for(F.col("host"), F.col("path"), rules)), standing, "host", ["page_id", "url"])
    own = F.when(F.col("bad_at_least") > worst, "block").otherwise("allow")
    return judged.withColumn("rule", F.col("_fit.rule")).withColumn("verdict", F.coalesce("_fit.verdict", own)).drop("_fit")
