"""URL verdicts: fixed rules, and an empirical-Bayes reputation of hosts where no rule fits.

Reputation: labelled pages are good or bad. Bad rates are shrunk from level to level: the overall rate is the prior of a
suffix, a suffix's posterior mean that of its registered domains, and a domain's that of its hosts. A level's prior is a
beta law about the parent's mean; its strength comes from the data by moments: with n pages, y of them bad, and prior
mean m, the intraclass correlation is

    rho = (sum((y - n m)^2 / (m (1 - m))) - sum(n)) / (sum(n^2) - sum(n)),  within [0.001, 0.5],

and the strength is 1 / rho - 1. A host is blocked where the lower bound of its posterior bad rate, mean - z sd of the
beta law, is above ``most_bad``. Only counts by host are aggregated, with partial sums before each exchange.

The registered domain is the suffix and one more label. Suffixes come from a table in the form of the public suffix list
(:func:`read_suffix_table`: plain, ``*.`` and ``!`` rules, the longest that fits); without a table the suffix is the last label,
or the last two where the last has two letters and the one before is one of the usual second levels. A port and user part
don't count for these. A host that is an address (four numbers, or one in brackets) is a domain and a suffix of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
SECOND_LEVEL = r"^(ac|co|com|edu|gov|net|org)\.[a-z][a-z]$"
ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: up to /, ?, # or the end, A-Z lower-cased; then up to ?, # or the end. Else both empty."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(has, host).otherwise(""), F.when(has, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, ties to the longer host; null where none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def bare(host: Column) -> Column:
    """A host without user part and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def read_suffix_table(spark: SparkSession, path: str) -> DataFrame:
    """(rule) of a file in the form of the public suffix list: a rule a line, comments after //."""
    rule = F.lower(F.trim(F.split("value", r"\s|//", 2)[0]))
    return spark.read.text(path).select(rule.alias("rule")).where("rule <> ''").distinct()


def with_levels(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts (one row a host) with columns domain and suffix."""
    name = bare(F.col("host"))
    two, split = F.substring_index(name, ".", -2), F.split(name, r"\.")

    def tail(k: Column) -> Column:
        """The last k labels, or all."""
        return F.array_join(F.slice(split, F.greatest(F.lit(1), F.size(split) - k + 1), k), ".")

    if suffixes is None:
        n = F.when(two.rlike(SECOND_LEVEL), 2).otherwise(1)
        rows = hosts.withColumn("suffix_labels", n)
    else:
        # each tail of a host's labels may be a rule, fit *.rule with one label more, or be an exception, whose suffix is one label shorter
        at = F.transform(F.sequence(F.lit(1), F.size(split)), lambda k: F.array(
            F.struct(tail(k).alias("rule"), k.alias("labels"), F.lit(0).alias("first")),
            F.struct(F.concat(F.lit("*."), F.when(k > 1, tail(k - 1))).alias("rule"), k.alias("labels"), F.lit(0).alias("first")),
            F.struct(F.concat(F.lit("!"), tail(k)).alias("rule"), (k - 1).alias("labels"), F.lit(1).alias("first")),
        ))
        tails = hosts.select("host", F.explode(F.flatten(at)).alias("t")).select("host", "t.*")
        fits = tails.join(suffixes.select("rule"), "rule").groupBy("host").agg(F.max(F.struct("first", "labels")).alias("best"))
        rows = hosts.join(fits.select("host", F.col("best.labels").alias("suffix_labels")), "host", "left").withColumn("suffix_labels", F.coalesce("suffix_labels", F.lit(1)))
    address = name.rlike(ADDRESS)
    return rows.withColumns({"domain": F.when(address, name).otherwise(tail(F.col("suffix_labels") + 1)), "suffix": F.when(address, name).otherwise(tail(F.col("suffix_labels")))}).drop("suffix_labels")


def strength(groups: DataFrame) -> float:
    """The prior's strength of a level, from n, y and the parent's mean m of its groups: one row of sums."""
    s = groups.agg(F.sum((F.col("y") - F.col("n") * F.col("m")) ** 2 / (F.col("m") * (1 - F.col("m")))).alias("s"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q")).first()
    if not s["n"] or s["q"] <= s["n"]:
        return 1.0
    return 1 / min(0.5, max(0.001, (s["s"] - s["n"]) / (s["q"] - s["n"]))) - 1


def host_reputation(outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, n, y, mean, sd) from (host, bad) rows, bad 0, 1 or null (unlabelled): posterior of each host's bad rate.

    Without labelled pages all hosts have the mean 1/2.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("y"))
    hosts = written(with_levels(hosts, suffixes), "url-hosts")  # a row a host: the pages are read once for all levels
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    all_ = tops.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    tops = tops.withColumn("m", F.lit(((all_["y"] or 0) + 1) / ((all_["n"] or 0) + 2)))

    def mean(k: float) -> Column:
        return (F.col("y") + k * F.col("m")) / (F.col("n") + k)

    tops = tops.select("suffix", mean(strength(tops)).alias("m"))
    domains = domains.join(tops, "suffix")
    domains = domains.select("domain", mean(strength(domains)).alias("m"))
    hosts = hosts.join(domains, "domain")
    k = strength(hosts)
    a, b = F.col("y") + k * F.col("m"), F.col("n") - F.col("y") + k * (1 - F.col("m"))
    return hosts.select("host", "n", "y", (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))).alias("sd"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages with bad = 1 where the label of the page's id says low quality or toxic, 0 where it says neither, else null.

    A page with several labels is bad if any says so; nulls say nothing.
    """
    says = F.greatest(1 - F.col("quality"), F.col("toxic"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(says).cast("long").alias("bad"))
    return pages.join(known, "page_id", "left")


def judged(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, suffixes: DataFrame | None = None, most_bad: float = 0.5, z: float = 1.645) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bad_bound) of every page; null and odd urls have the empty host."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    reputation = host_reputation(page_outcomes(rows, labels), suffixes).select("host", F.col("mean").alias("bad_rate"), (F.col("mean") - z * F.col("sd")).alias("bad_bound"))
    rule, action = matched(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_bound") > most_bad, "block").otherwise("allow")
    return rows.join(reputation, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict"), "bad_rate", "bad_bound")
