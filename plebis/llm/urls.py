"""Operator 5: URL filters.

Rules decide the pages that they fit.  Their verdicts are the labelled outcomes
from which the reputation of hosts is learned for all other pages: the share of
blocked pages is shrunk through beta-binomial priors from the whole table to the
suffix, from there to the registered domain and from there to the host.  The
strength of each prior comes from the spread between its groups (method of
moments).  A page without a rule is blocked when the lower bound of its host's
posterior share of blocked pages is above one half.

Counting is a partial aggregation by host, so a host with a third of all pages
costs one row a task; suffixes and domains are summed from the host rows, and what
a level's prior takes from all its groups is one row of sums.  Hosts meet their
pages by broadcast while they are few; beyond that by a shuffle, but for those that
hold more than a thousandth of all pages, of which there are a thousand at most.

Defined results.  A null url, or one without ``://``, has empty host and path,
no rule, and the verdict of the empty host.  Repeated rows count each.  An empty
table gives no rows.  The registered domain is the last two labels of the host
(three under a suffix of two labels that the caller names).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plebis.llm.common import durable, table

#: verdict and rule; the longest rule that fits wins.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Above so many hosts their bounds are joined by shuffle.
BROADCAST_HOSTS = 500_000
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1)
    return F.translate(found, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as (verdict, rule), or null."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<verdict:string,rule:string>") if found is None else found


def _shrunk(groups: DataFrame, by: str, outer: str) -> DataFrame:
    """Rows with n, bad and the outer level's mean to the same with this level's
    strength and mean: (bad + strength * outer) / (n + strength)."""
    noise = F.col(outer) * (1 - F.col(outer))
    spread = groups.agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col(outer), 2.0) - F.col("n") * noise).alias("surplus"),
        F.sum(F.col("n") * (F.col("n") - 1) * noise).alias("pairs"),
    )
    alike = F.when(F.col("pairs") > 0, F.least(F.greatest(F.col("surplus") / F.col("pairs"), F.lit(0.001)), F.lit(0.999))).otherwise(0.5)
    # One row, so every group meets it without a shuffle.
    return groups.join(F.broadcast(spread.select((1 / alike - 1).alias("strength")))).withColumn(
        f"{by}_mean", (F.col("bad") + F.col("strength") * F.col(outer)) / (F.col("n") + F.col("strength"))
    )


def reputations(pages: DataFrame, long_suffixes: Sequence[str] = (), z: float = 1.645) -> DataFrame:
    """Rows (host, bad) with bad 1, 0 or null where unlabelled, to one row a host
    with its posterior mean and the lower bound of its share of bad pages."""
    hosts = pages.groupBy("host").agg(
        F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"), F.count("*").alias("pages")
    )
    bare = F.regexp_replace(F.col("host"), r"^.*@|:[0-9]*$", "")
    labels = F.split(bare, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    suffixed = two.isin(*long_suffixes) if long_suffixes else F.lit(False)
    hosts = hosts.withColumn("domain", F.when(suffixed, three).otherwise(two)).withColumn(
        "suffix", F.when(suffixed, two).otherwise(F.element_at(labels, -1))
    )
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = suffixes.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("all_mean"))
    suffix_means = _shrunk(suffixes.join(F.broadcast(overall)), "suffix", "all_mean").select("suffix", "suffix_mean")
    domain_means = _shrunk(domains.join(suffix_means, "suffix"), "domain", "suffix_mean").select(
        "domain", "suffix", "domain_mean"
    )
    per_host = _shrunk(hosts.join(domain_means, ["domain", "suffix"]), "host", "domain_mean")
    mean, total = F.col("host_mean"), F.col("n") + F.col("strength")
    deviation = F.sqrt(mean * (1 - mean) / (total + 1))
    return per_host.select("host", mean.alias("mean"), (mean - z * deviation).alias("lower"), "pages")


def _with_reputation(pages: DataFrame, known: DataFrame) -> DataFrame:
    known = known.transform(durable)
    if known.count() <= BROADCAST_HOSTS:
        return pages.join(F.broadcast(known), "host")
    total = known.agg(F.sum("pages").alias("all"))
    sized = known.join(F.broadcast(total)).withColumn("hot", F.col("pages") * 1000 > F.col("all")).drop("all")
    hot = F.broadcast(sized.where("hot").drop("hot"))  # a thousand rows at most
    return pages.join(hot, "host").unionByName(pages.join(hot, "host", "left_anti").join(sized.where("not hot").drop("hot"), "host"))


def judge(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    above: float = 0.5,
    long_suffixes: Sequence[str] = (),
) -> DataFrame:
    """All rows as a column ``row`` with host, path, rule, verdict and, for pages
    without a rule, the posterior bound ``lower`` that decided."""
    host, path = host_of(pages[url]), path_of(pages[url])
    parsed = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"), host.alias("host"), path.alias("path"))
    ruled = parsed.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    outcome = F.when(F.col("fit.verdict") == "block", 1).when(F.col("fit.verdict") == "allow", 0)
    known = reputations(ruled.select("host", outcome.alias("bad")), long_suffixes)
    return _with_reputation(ruled, known).select(
        "row",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("lower") > above, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("fit").isNull(), F.col("lower")).alias("lower"),
    )


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("row.page_id", "host", "path", "rule", "verdict", F.round("lower", 6).alias("lower"))


OP5_SQL = r"""
WITH parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parsed),
labelled AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 0.0::DOUBLE WHEN rule IS NOT NULL THEN 1.0::DOUBLE END AS bad
  FROM ruled),
hosts AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad,
         string_split(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') AS labels
  FROM labelled GROUP BY host),
named AS (
  SELECT *, labels[len(labels)] AS suffix, array_to_string(labels[greatest(len(labels) - 1, 1):], '.') AS domain FROM hosts),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY ALL),
suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (sum(sum(bad)) OVER () + 1) / (sum(sum(n)) OVER () + 2) AS m
  FROM domains GROUP BY suffix),
s1 AS (
  SELECT *, sum(pow(bad - n * m, 2) - n * m * (1 - m)) OVER () AS x, sum(n * (n - 1) * m * (1 - m)) OVER () AS y FROM suffixes),
s2 AS (SELECT *, 1 / (CASE WHEN y > 0 THEN least(greatest(x / y, 0.001::DOUBLE), 0.999::DOUBLE) ELSE 0.5::DOUBLE END) - 1 AS s FROM s1),
suffix_means AS (SELECT suffix, (bad + s * m) / (n + s) AS m FROM s2),
d1 AS (
  SELECT d.*, m, sum(pow(bad - n * m, 2) - n * m * (1 - m)) OVER () AS x, sum(n * (n - 1) * m * (1 - m)) OVER () AS y
  FROM domains d JOIN suffix_means USING (suffix)),
d2 AS (SELECT *, 1 / (CASE WHEN y > 0 THEN least(greatest(x / y, 0.001::DOUBLE), 0.999::DOUBLE) ELSE 0.5::DOUBLE END) - 1 AS s FROM d1),
domain_means AS (SELECT suffix, domain, (bad + s * m) / (n + s) AS m FROM d2),
h1 AS (
  SELECT h.host, h.n, h.bad, m, sum(pow(bad - n * m, 2) - n * m * (1 - m)) OVER () AS x, sum(n * (n - 1) * m * (1 - m)) OVER () AS y
  FROM named h JOIN domain_means USING (suffix, domain)),
h2 AS (SELECT *, 1 / (CASE WHEN y > 0 THEN least(greatest(x / y, 0.001::DOUBLE), 0.999::DOUBLE) ELSE 0.5::DOUBLE END) - 1 AS s FROM h1),
h3 AS (SELECT host, (bad + s * m) / (n + s) AS mean, n + s AS total FROM h2),
known AS (SELECT host, mean - 1.645::DOUBLE * sqrt(mean * (1 - mean) / (total + 1)) AS lower FROM h3)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN lower > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL THEN round(lower, 6) END AS lower
FROM labelled JOIN known USING (host)
"""
