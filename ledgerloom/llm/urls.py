"""URL filters by host-suffix and path-prefix expressions.

A rule is a host and the beginning of a path; it fits its host and all subdomains, and the longest that fits decides. Each URL's host is
expanded into its suffixes, as many labels long as rules' hosts are. Those are joined with the rules' hosts on the first four bytes of
their SHA-256, and the full digests compared. Of a host that has rules, the URL's path is expanded into prefixes of the lengths that this
host's rules have; host and prefix together are joined with the rules in the same way. Of the rules that remain the longest wins (of
equally long ones, block before allow). So a URL meets only lengths that its own host's rules have, however many rules there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

PREFIX = 8
#: Null URLs are dealt over so many keys.
SPREAD = 1024
#: Rules of the registered query: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256)


def _confirmed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equi-join of (full, ...) and (digest, ...) on the digests' short prefixes; then the full ones decide."""
    left = left.withColumn("prefix", F.substring("full", 1, PREFIX))
    right = right.withColumn("_prefix", F.substring("digest", 1, PREFIX))
    return left.join(right, F.col("prefix") == F.col("_prefix")).filter("full = digest").drop("prefix", "_prefix", "full", "digest")


def verdicts(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url); rules: verdict, host (lower case), path.

    Null URLs and those without :// have an empty host and path, which no rule fits. rule is null where none fits, and the verdict is
    then `otherwise`. Without rules, all get that. Each different URL is judged once, so copies of one cost nothing more, and a very
    long one costs one digest for each label count and path length that fitting rules' hosts have. An empty table gives no rows, and
    other columns are ignored. Rules without a host or path fit nothing.
    """
    rules = rules.select("verdict", "host", "path").filter("host is not null and path is not null").distinct()
    known = rules.select(_digest(F.col("host"), F.col("path")).alias("digest"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("says"))
    hosts = rules.groupBy("host").agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).select(_digest(F.col("host")).alias("digest"), "lengths")
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    urls = pages.select("url").filter("url is not null").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    names = F.split("host", r"\.")
    depths = F.sequence(F.lit(1), F.least(F.size(names), F.lit(most))) if most else F.array().cast("array<int>")
    suffixes = urls.select("url", "path", F.explode(F.transform(depths, lambda n: F.array_join(F.slice(names, -n, n), "."))).alias("suffix"))
    met = _confirmed(suffixes.withColumn("full", _digest(F.col("suffix"))), hosts)
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    found = _confirmed(met.select("url", "suffix", F.explode(prefixes).alias("start")).select("url", _digest(F.col("suffix"), F.col("start")).alias("full")), known)
    best = found.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("says") == "block").alias("blocks"), "rule", "says")).alias("best"))
    best = best.select(F.col("url").alias("_url"), "best")
    # null URLs join nothing, but would all meet in one task
    key = F.coalesce("url", F.concat(F.lit("\0"), F.pmod(F.xxhash64("page_id"), F.lit(SPREAD)).cast("string")))
    out = pages.select("page_id", "url").join(best, key == F.col("_url"), "left")
    return out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.says", F.lit(otherwise)).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return verdicts(documents(spark, sf_dir, "pages"), rules)


_CASES = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{i}}}" for i, (_, h, p) in sorted(enumerate(RULES), key=lambda x: -len(x[1][1] + x[1][2]))
)
OP7_SQL = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
       CASE {_CASES.format(*[f"'{h}{p}'" for _, h, p in RULES])} END AS rule,
       CASE {_CASES.format(*[f"'{v}'" for v, _, _ in RULES])} ELSE 'allow' END AS verdict
FROM split
"""
