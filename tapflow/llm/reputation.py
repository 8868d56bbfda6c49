"""URL filter: rules, and empirical-Bayes host reputation where no rule fits.

Labelled page outcomes (bad or not) are counted for each host. The bad share
of a host is shrunk through beta-binomial priors: the public suffix (see
`public_suffixes`) is shrunk towards
the overall share, the registered domain towards its suffix, the host towards
its domain. Each level has one precision, from the spread of its groups around
their parents by moments, and a posterior variance that includes its parent's. A page is blocked if the lower posterior bound of
its host's bad share is above a limit, so little evidence never blocks.

Everything is DataFrame operations. Counts combine before the shuffle; the
join of pages with hosts has one row for each host on one side, so the rows of
a hot host can be split. Only the precision and the overall share, single
numbers, reach the driver.

Defined results: a null url, or one without ``://``, has empty host and path
and belongs to the host ''; repeated pages count as often as they occur; a
page with several label rows is bad if any of them says so; without labels
every host has the share 0 and is allowed; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapflow.llm.public_suffixes import BELOW, EXACT, EXCEPT, MOST_LABELS
from tapflow.operators.common import cut_lineage

Z = 1.645  # one-sided 95 % bound
MAX_BAD = 0.35  # a host is blocked if its bad share is above this with that certainty
RHO_MIN, RHO_MAX = 1e-4, 0.99
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule ``host/path`` that fits, else nulls.
    ``rules`` are (verdict, rule) pairs, a list short enough for one
    expression; of equal lengths the earlier in the list wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for outcome, text in sorted(reversed(rules), key=lambda r: len(r[1])):  # longer rules are wrapped outside
        of_host, slash, of_path = text.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + of_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(outcome)).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix): the longest public suffix (of several
    labels as listed, else the last label) with one label more, and itself,
    without a port; an address of digits is its own domain and suffix, and so
    is a host that is a suffix."""
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    number = bare.rlike(r"^[0-9.]+$")
    labels = F.size(F.split(bare, r"\.", -1))
    ends = F.array(*[F.when(labels >= k, F.substring_index(bare, ".", -k)) for k in range(MOST_LABELS, 1, -1)])
    ends = F.call_function("filter", ends, _is_suffix())
    suffix = F.coalesce(F.try_element_at(ends, F.lit(1)), F.substring_index(bare, ".", -1))
    domain = F.regexp_extract(F.left(bare, F.length(bare) - F.length(suffix)), r"[^.]*\.?$", 0)
    return F.when(number, bare).otherwise(F.concat(domain, suffix)), F.when(number, bare).otherwise(suffix)


def _is_suffix() -> Column:
    """Whether a name of several labels is a public suffix, as a lambda (SQL
    text, since thousands of literals are slow to make one by one)."""
    exact, below, but = (", ".join(f"'{x}'" for x in sorted(s)) for s in (EXACT, BELOW, EXCEPT))
    return F.expr(f"n -> n in ({exact}) or (substring(n, locate('.', n) + 1) in ({below}) and n not in ({but}))")


def _shrunk(groups: DataFrame) -> DataFrame:
    """``groups`` (n, bad, and the parent's posterior ``share`` and ``var``)
    with their own posterior: the beta-binomial mean, and its variance plus
    what the parent's uncertainty adds to it."""
    m, n, seen = F.col("share"), F.col("n").cast("double"), F.col("bad") / F.col("n")
    row = groups.filter("n > 0").agg(
        F.sum(n * (seen - m) * (seen - m)).alias("s"), F.sum(m * (1 - m)).alias("v"),
        F.sum(m * (1 - m) * (n - 1)).alias("w")).first()
    rho = (row["s"] - row["v"]) / row["w"] if row["w"] else RHO_MIN
    precision = F.lit(1 / min(RHO_MAX, max(RHO_MIN, rho)) - 1)
    share, total = (precision * m + F.col("bad")) / (precision + n), precision + n
    own = share * (1 - share) / (total + 1)
    return groups.withColumns({"share": share, "var": own + F.col("var") * (precision / total) * (precision / total)})


def host_reputation(pages: DataFrame, outcomes: DataFrame, host_col: str = "host", id_col: str = "page_id",
                    z: float = Z) -> DataFrame:
    """(host, n, bad, share, low, high) for every host of ``pages``, from the
    ``outcomes`` (id, bad) of some of them: posterior mean and bounds of the
    bad share."""
    marked = outcomes.groupBy("id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    domain, suffix = domain_of(F.col("host"))
    hosts = cut_lineage(  # the list of suffixes is looked up once, and is not in the later plans
        pages.select(F.col(id_col).alias("page"), F.col(host_col).alias("host"))
        .join(marked, F.col("page") == F.col("id"), "left")
        .groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumns({"domain": domain, "suffix": suffix}))
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("suffix", "domain").agg(*counts)
    suffixes = domains.groupBy("suffix").agg(*counts)
    total = suffixes.agg(*counts).first()
    n = float(total["n"] or 0)
    overall = float(total["bad"] or 0) / n if n else 0.0
    suffixes = _shrunk(suffixes.withColumns({"share": F.lit(overall), "var": F.lit(overall * (1 - overall) / (n + 1))}))
    domains = _shrunk(domains.join(suffixes.select("suffix", "share", "var"), "suffix"))
    hosts = _shrunk(hosts.join(domains.select("domain", "suffix", "share", "var"), ["domain", "suffix"]))
    spread = F.lit(z) * F.sqrt(F.greatest(F.col("var"), F.lit(0.0)))
    return hosts.select("host", "n", "bad", "share", (F.col("share") - spread).alias("low"),
                        (F.col("share") + spread).alias("high"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id",
               url_col: str = "url", max_bad: float = MAX_BAD) -> DataFrame:
    """(id, host, path, rule, verdict, low) for every page: the rule's verdict,
    else 'block' if the lower bound of the host's bad share is above
    ``max_bad``, else 'allow'."""
    host, path = url_parts(F.col(url_col))
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    known = host_reputation(parsed, outcomes, "host", id_col).select(F.col("host").alias("known_host"), "low")
    return (parsed.withColumns({"rule": rule, "by_rule": verdict})
            .join(known, F.col("host") == F.col("known_host"))
            .select(id_col, "host", "path", "rule",
                    F.coalesce("by_rule", F.when(F.col("low") > max_bad, "block").otherwise("allow")).alias("verdict"),
                    "low"))
