"""Operator 7: URL filters with rules and an empirical-Bayes host reputation.

Rules (host, path, verdict) come first: a rule fits its host and all subdomains if the
URL's path starts with the rule's; the longest (host and path together) wins. Pages that a rule judges are the
labelled outcomes (or give an own outcome column). For all other pages the host decides:

* Good and bad outcomes are counted per host, registered domain (the suffix and one label more) and suffix
  (the last label, or the last two where they are one of ``suffixes``, under which anybody registers).
* At each level a beta-binomial prior is fitted to the level's rates by moments: the rates' variance
  beyond what sampling explains gives the prior's strength, bounded to [1, 1000].
* Means are shrunk from the top: all pages -> suffix -> registered domain -> host. A host
  without outcomes keeps its domain's mean, an unseen domain its suffix's.
* A page is blocked if the lower bound of its host's posterior (mean - z standard deviations of the beta
  posterior) lies below ``least``.

Outcomes are summed map-side; only the tables of hosts are joined to pages, on narrow rows (a hot host's rows are
split by the adaptive join). Built-in expressions throughout.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule and the suffix "" (judged by the
prior like any host); without any outcome the mean is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesonar.llm.common import write_table

# The rules of the registered query (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# The usual suffixes of two labels.
SUFFIXES = ("ac.jp", "ac.uk", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk",
            "com.mx", "com.my", "com.sg", "com.tr", "com.tw", "com.ua", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(F.col(url), F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def strength(rates: DataFrame) -> DataFrame:
    """Rows (parent mean m, good g, n) of a level's units -> one row ``s``: the prior strength by moments."""
    fit = rates.agg(
        F.sum(F.col("n") * F.pow(F.col("g") / F.col("n") - F.col("m"), F.lit(2))).alias("q"),
        F.sum(F.col("m") * (1 - F.col("m"))).alias("e"),
        F.sum((F.col("n") - 1) * F.col("m") * (1 - F.col("m"))).alias("f"))
    # E q = sum m(1-m) (1 + (n-1) rho), strength = 1/rho - 1
    rho = (F.col("q") - F.col("e")) / F.col("f")
    s = F.when((F.col("f") > 0) & (rho > 0), 1 / rho - 1).otherwise(F.lit(1000.0))
    return fit.select(F.least(F.greatest(s, F.lit(1.0)), F.lit(1000.0)).alias("s"))


def registered(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; a host that is no longer than its suffix is its own domain."""
    labels = F.split(host, r"\.")
    last, pair = F.element_at(labels, -1), F.substring_index(host, ".", -2)
    double = pair.isin(*suffixes) if suffixes else F.lit(False)
    domain = F.when(double, F.substring_index(host, ".", -3)).otherwise(pair)
    return domain, F.when(double, pair).otherwise(last)


def reputations(outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, domain, suffix, good, n, mean, sd) for each host of ``outcomes`` (host, good: 1,
    0 or null): the mean and deviation of its beta posterior."""
    domain, suffix = registered(F.col("host"), suffixes)
    hosts = write_table(outcomes.groupBy("host").agg(
        F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("g"), F.count("good").cast("double").alias("n"))
        .withColumns({"domain": domain, "suffix": suffix}), "reputation-hosts")
    total = hosts.agg(F.sum("g").alias("g"), F.sum("n").alias("n")).select(
        ((F.col("g") + 1) / (F.col("n") + 2)).alias("m")).first()
    mean = F.lit(total["m"] if total["m"] is not None else 0.5)
    parent = None
    for level in ("suffix", "domain", "host"):
        units = hosts.groupBy(*{"suffix": ["suffix"], "domain": ["suffix", "domain"], "host": ["suffix", "domain", "host"]}[level]).agg(
            F.sum("g").alias("g"), F.sum("n").alias("n"))
        if parent is None:
            units = units.withColumn("m", mean)
        else:
            units = units.join(parent, [c for c in parent.columns if c != "m"])
        units = write_table(units, f"reputation-{level}")
        s = strength(units.filter("n > 0")).first()["s"]
        a, b = F.col("g") + s * F.col("m"), F.col("n") - F.col("g") + s * (1 - F.col("m"))
        shrunk = units.withColumns({"a": a, "b": b}).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))
        keys = [c for c in ("suffix", "domain", "host") if c in units.columns]
        parent = shrunk.select(*keys, F.col("mean").alias("m"))
    sd = F.sqrt(F.col("a") * F.col("b") / (F.pow(F.col("a") + F.col("b"), F.lit(2)) * (F.col("a") + F.col("b") + 1)))
    return shrunk.select("host", "domain", "suffix", F.col("g").alias("good"), "n", "mean", sd.alias("sd"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, outcome: str | None = None,
          z: float = 1.645, least: float = 0.5, key: str = "page_id", url: str = "url",
          suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(key, host, path, rule, verdict, mean, bound) for every page."""
    host, path = host_and_path(url)
    narrow = pages.select(F.col(key).alias("_id"), host.alias("host"), path.alias("path"),
                          *([F.col(outcome).cast("int").alias("_own")] if outcome else []))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = narrow.withColumns({"rule": rule, "_v": verdict})
    by_rule = F.when(F.col("_v").isNotNull(), (F.col("_v") == "allow").cast("int"))
    rep = reputations(ruled.select("host", (F.coalesce("_own", by_rule) if outcome else by_rule).alias("good")), suffixes)
    bound = F.col("mean") - F.lit(z) * F.col("sd")
    return (ruled.join(rep.select("host", "mean", bound.alias("bound")), "host")
            .select(F.col("_id").alias(key), "host", "path", "rule",
                    F.coalesce("_v", F.when(F.col("bound") >= least, "allow").otherwise("block")).alias("verdict"),
                    "mean", "bound"))
