"""Page addresses judged by rules, and else by the reputation of their host.

A rule names a host and the start of a path; it fits the host and its subdomains, and the longest
rule that fits decides. Other pages are judged by labelled outcomes. Each level of names, from
suffix over registered domain to host, has a beta-binomial prior: its mean is the posterior mean
of the level above, its strength comes from how far the level's outcomes scatter beyond chance
(method of moments). A page is blocked if the lower posterior bound of its host's share of bad
outcomes, the quantile that ``sure`` of the beta distribution lies above, exceeds the limit: ``ratio``
times the share in all outcomes, and never more than ``most``. So a host is held against the rest of
the corpus, however rare bad pages are in it. Hosts without outcomes have the posterior of the level
above. Ties: a bound equal to the limit does not block.

Null address or one without ``://``: host and path are empty, judged like any other host. Null
page_id, repeated rows: each row has its verdict. Outcomes of unknown pages or null labels are
ignored. Empty table: no rows. Other columns are ignored.
"""

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from defectloom.llm.store import keep

# The rules of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Suffixes of two names under which domains are registered; others are one name.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
RATIO, MOST, SURE = 1.5, 0.5, 0.95
# The series of the beta distribution; beyond so many outcomes the normal one is as good.
TERMS, MANY = 600, 10_000
LEAST_SPREAD, MOST_SPREAD = 0.001, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``."""
    at = F.coalesce(F.instr(F.col(url), "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    pages = pages.withColumn("_rest", rest)
    pages = pages.withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0))
    behind = F.substring("_rest", F.length("_host") + 1, F.length("_rest"))
    return pages.withColumns(
        {"host": F.translate("_host", UPPER, LOWER), "path": F.regexp_extract(behind, "^[^?#]*", 0)}
    ).drop("_rest", "_host")


def rule_of(rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls, for ``host`` and ``path``."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The longest comes last and so is asked first.
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = (F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))
        fits = fits & F.startswith("path", F.lit(path))
        rule = F.when(fits, host + path).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _names(host: Column, suffixes: Sequence[str]) -> tuple[Column, Column]:
    """Suffix and registered domain of a host."""
    two = F.substring_index(host, ".", -2)
    long = two.isin(*suffixes)
    suffix = F.when(long, two).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(long, F.substring_index(host, ".", -3)).otherwise(two)
    return suffix, domain


def _log_gamma(z: Column) -> Column:
    """Stirling's series, eight steps further up."""
    w, steps = z + 8, z
    for k in range(1, 8):
        steps = steps * (z + k)
    series = 1 / (12 * w) - 1 / (360 * w * w * w) + 1 / (1260 * w * w * w * w * w)
    return (w - 0.5) * F.log(w) - w + 0.5 * F.log(F.lit(2) * F.pi()) + series - F.log(steps)


def beta_above(x: Column, a: Column, b: Column) -> Column:
    """The probability that a beta variable exceeds ``x`` (between 0 and 1, both excluded)."""
    # The series converges fast on the side of the mean where x lies.
    low = x < (a + 1) / (a + b + 2)
    y, own, other = (F.when(low, u).otherwise(v) for u, v in ((x, 1 - x), (a, b), (b, a)))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, n):
        term = acc["term"] * (own + other + n) * y / (own + 1 + n)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(0), F.lit(TERMS - 1)), start, step, lambda acc: acc["total"])
    log_beta = _log_gamma(own) + _log_gamma(other) - _log_gamma(own + other)
    tail = F.exp(own * F.log(y) + other * F.log(1 - y) - log_beta) / own * total
    return F.when(low, 1 - tail).otherwise(tail)


def _strength(level: DataFrame) -> float:
    """Prior strength from rows of (n, bad, prior): spread beyond chance, kept within bounds."""
    n, p = F.col("n"), F.col("prior")
    beyond = (F.col("bad") - n * p) * (F.col("bad") - n * p) - n * p * (1 - p)
    above, below = level.agg(F.sum(beyond), F.sum(n * (n - 1) * p * (1 - p))).first()
    spread = above / below if below else LEAST_SPREAD
    return 1 / min(MOST_SPREAD, max(LEAST_SPREAD, spread)) - 1


def reputation(
    pages: DataFrame,
    outcomes: DataFrame,
    ratio: float = RATIO,
    most: float = MOST,
    sure: float = SURE,
    suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """``host``, its outcomes ``n`` and ``bad``, posterior ``mean`` and whether its lower bound
    exceeds the limit (``blocked``), for every host.

    ``pages`` has page_id and host, ``outcomes`` page_id and bad (0 or 1).
    """
    known = outcomes.where(F.col("bad").isNotNull())
    seen = pages.select("page_id", "host").join(known, "page_id")
    counts = seen.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    every = pages.select("host").distinct().join(counts, "host", "left")
    suffix, domain = _names(F.col("host"), suffixes)
    hosts = every.select(
        "host", suffix.alias("suffix"), domain.alias("domain"),
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"),
    )
    hosts = keep(hosts, "hosts")
    total, bad = hosts.agg(F.sum("n"), F.sum("bad")).first()
    # One outcome of either kind as the prior of the whole.
    share = ((bad or 0) + 1) / ((total or 0) + 2)

    def posterior(level: DataFrame, name: str, strength: float) -> DataFrame:
        value = (strength * F.col("prior") + F.col("bad")) / (strength + F.col("n"))
        return keep(level.select(name, value.alias("prior")), name)

    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    level = keep(hosts.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(share)), "suffixes")
    above = posterior(level, "suffix", _strength(level))
    level = keep(hosts.groupBy("domain", "suffix").agg(*sums).join(above, "suffix"), "domains")
    above = posterior(level, "domain", _strength(level))
    level = keep(hosts.join(above, "domain"), "priors")
    strength = _strength(level)
    a = strength * F.col("prior") + F.col("bad")
    b = strength * (1 - F.col("prior")) + F.col("n") - F.col("bad")
    level = keep(level.select("host", "n", "bad", a.alias("a"), b.alias("b")), "posteriors")
    a, b = F.col("a"), F.col("b")
    limit = min(most, ratio * share)
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    likely = F.when(a + b <= MANY, beta_above(F.lit(limit), a, b) > sure)
    far = a / (a + b) - NormalDist().inv_cdf(sure) * deviation > limit
    return level.select("host", "n", "bad", (a / (a + b)).alias("mean"), F.coalesce(likely, far).alias("blocked"))


def judge_pages(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    key: str = "page_id",
    url: str = "url",
    ratio: float = RATIO,
    most: float = MOST,
    sure: float = SURE,
    suffixes: Sequence[str] = SUFFIXES,
) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule`` and ``verdict``."""
    found = with_host(pages.select(F.col(key).alias("page_id"), F.col(url).alias("url")))
    hosts = keep(reputation(found, outcomes, ratio, most, sure, suffixes), "reputation")
    rule, verdict = rule_of(rules)
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    return found.join(hosts.select("host", "blocked"), "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict")
    )
