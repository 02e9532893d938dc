"""URL filter: empirical-Bayes reputation of hosts, overruled by a list of rules kept by hand.

Outcomes of pages (1 bad, 0 good, null unknown) are counted per host. Beta-binomial priors shrink them: a
suffix towards all pages, a registered domain towards its suffix, a host towards its domain. The strength of
each prior comes from how much the rates of its level vary (moments). A host is blocked if the lower bound
of its posterior share of bad pages (mean - z * deviation) is above `limit`.

Only counts per host are shuffled. Pages meet the table of hosts in a join by host; Spark broadcasts the table if it
is small and splits hot hosts otherwise.

Defined results: a null url, or one without `://`, has an empty host and path; the empty host has a reputation like
any other. Rules fit a host and its subdomains if the path starts with the rule's path; the longest rule wins
(host and path together, then block before allow). No outcomes at all: nothing is blocked but by rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.session import written

# Second-level labels under which country suffixes register names
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def host_of(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#`, or the end; A-Z in lower case."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """Last label, or the last two if they look like `co.uk`."""
    two = rf"(?:^|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z][a-z])$"
    found = F.regexp_extract(host, two, 1)
    return F.when(found != "", found).otherwise(F.regexp_extract(host, r"([^.]*)$", 1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one more label, if there is one."""
    rest = F.left(host, F.length(host) - F.length(suffix))
    label = F.regexp_extract(rest, r"([^.]*)\.$", 1)
    return F.when(label != "", F.concat(label, F.lit("."), suffix)).otherwise(host)


def junk_outcome(html: Column, limit: float = 0.05) -> Column:
    """1 if over `limit` of a page's characters are symbols that prose hardly has, else 0; null without html."""
    symbols = F.length(html) - F.length(F.translate(html, "#%*$|{}<>", ""))
    marks = F.regexp_count(html, F.lit("<[a-zA-Z/!]"))
    return F.when(F.length(html) == 0, F.lit(1)).otherwise((symbols - 2 * marks > limit * F.length(html)).cast("int"))


def _strength(level: DataFrame, parent_mean: str) -> Column:
    """Prior strength by moments: how much the rates of a level vary beyond chance; 1 to 1000."""
    n, rate, m = F.col("n"), F.col("bad") / F.col("n"), F.col(parent_mean)
    chance = F.sum(m * (1 - m))
    spread = F.sum(n * (rate - m) * (rate - m))
    # E[spread] = sum m(1-m)(1 + (n-1) rho), rho = 1 / (strength + 1)
    rho = (spread - chance) / F.sum((n - 1) * m * (1 - m))
    strength = F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(1000.0))
    return F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), strength)), F.lit(1000.0))


def _shrunk(level: DataFrame, parent_mean: str) -> DataFrame:
    strength = level.where("n > 0").agg(_strength(level, parent_mean).alias("s")).first()["s"]
    a = F.col("bad") + strength * F.col(parent_mean)
    return level.withColumn("mean", a / (F.col("n") + strength)).withColumn("size", F.col("n") + strength)


def reputation(outcomes: DataFrame, host: str, outcome: str, z: float = 1.645) -> DataFrame:
    """One row per host: n, bad, posterior mean and its lower bound."""
    hosts = outcomes.groupBy(F.col(host).alias("host")).agg(
        F.count(outcome).alias("n"), F.coalesce(F.sum(outcome), F.lit(0)).cast("long").alias("bad")
    )
    suffix = suffix_of(F.col("host"))
    hosts = written(hosts.withColumn("suffix", suffix).withColumn("domain", domain_of(F.col("host"), suffix)), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = (total["bad"] or 0) / total["n"] if total["n"] else 0.0
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = _shrunk(hosts.groupBy("suffix").agg(*counts).withColumn("over", F.lit(overall)), "over")
    suffixes = suffixes.select("suffix", F.col("mean").alias("suffix_mean"))
    domains = hosts.groupBy("domain", "suffix").agg(*counts).join(suffixes, "suffix")
    domains = _shrunk(domains, "suffix_mean").select("domain", F.col("mean").alias("domain_mean"))
    found = _shrunk(hosts.join(domains, "domain"), "domain_mean")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("size") + 1))
    return found.select("host", "n", "bad", "mean", (F.col("mean") - z * deviation).alias("bound"))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Index of the longest fitting rule in `ordered(rules)`, else null. For short lists kept by hand."""
    if len(rules) > 500:
        raise ValueError("at most 500 rules")
    found = F.lit(None).cast("int")
    for i, (_, rule) in reversed(list(enumerate(ordered(rules)))):
        name, _, rest = rule.partition("/")
        fits = (host == F.lit(name)) | F.endswith(host, F.lit("." + name))
        found = F.when(fits & F.startswith(path, F.lit("/" + rest)), F.lit(i)).otherwise(found)
    return found


def ordered(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))


def filter_urls(
    pages: DataFrame,
    outcome: Column,
    rules: list[tuple[str, str]],
    id_: str = "page_id",
    url: str = "url",
    limit: float = 0.2,
    z: float = 1.645,
) -> DataFrame:
    """id, host, path, rule, verdict, host_mean, host_bound for every page. `rules`: (verdict, `host/path`)."""
    u = F.col(url)
    rows = pages.select(F.col(id_).alias("id"), host_of(u).alias("host"), path_of(u).alias("path"), outcome.alias("outcome"))
    known = written(reputation(rows, "host", "outcome", z), "reputation")
    rows = rows.drop("outcome").join(known.select("host", "mean", "bound"), "host")
    order = ordered(rules)
    index = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in order]) if order else None
    at = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("hit", F.get(index, at) if order else F.lit(None).cast("struct<verdict:string,rule:string>"))
    own = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return rows.select(
        F.col("id").alias(id_),
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", own).alias("verdict"),
        F.col("mean").alias("host_mean"),
        F.col("bound").alias("host_bound"),
    )
