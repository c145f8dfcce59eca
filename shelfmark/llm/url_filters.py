"""URL filters: host-suffix and path-prefix expressions, hash-prefix join, digest check, rule precedence.

A rule is (host, path, verdict). It fits its host and all subdomains of it, if the URL's path starts with the
rule's path. Each URL is expanded into the expressions host suffix + path prefix. Only suffixes of as many labels and
prefixes of as many characters as some rule has are made, so the number of expressions of a URL, however long, is
bounded by the numbers of distinct rule label counts and path lengths. The expressions join the rules on the first 32 bits of their SHA-256
(sorted and compact to ship), and a candidate counts only if all 256 bits agree. The longest fitting rule wins
(ties: the longer host, then `block` before `allow`).

Defined cases: a null URL or one without `://` has empty host and path, no expressions, a null rule and the default
verdict; very long URLs are judged whole; equal rows are judged each; an empty rule set leaves the default for all; an empty
table gives no rows; other columns are kept, and columns with the names of results are replaced. A rule with a null host or path fits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rules: int = 200_000) -> DataFrame:
    """Judge every row of pages: its columns, then host, path, rule and verdict.

    The rule side is broadcast only if a count proves it to hold at most broadcast_rules rows; a larger set is joined
    by shuffling both sides on the hash prefix.
    """
    keep = pages.columns
    rules = rules.filter("rule_host is not null and rule_path is not null")
    sizes = rules.agg(F.collect_set(F.size(F.split("rule_host", r"\."))), F.collect_set(F.length("rule_path"))).first()
    counts, lengths = (sorted(x) for x in sizes)
    rules = rules.select(
        "rule_host", "rule_path", "rule_verdict", _digest(F.col("rule_host"), F.col("rule_path")).alias("_digest")
    ).withColumn("_prefix", F.substring("_digest", 1, 8))
    if rules.limit(broadcast_rules + 1).count() <= broadcast_rules:
        rules = F.broadcast(rules)
    base = pages.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[pages[c] for c in keep]).alias("_page"), host_of(pages[url]).alias("_host"), path_of(pages[url]).alias("_path"))
    suffixes = F.array(*[F.substring_index("_host", ".", -n) for n in counts]).cast("array<string>")
    wanted = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("_path"))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(wanted, lambda n: _digest(h, F.substring(F.col("_path"), F.lit(1), n)))))
    found = base.select("*", F.explode_outer(F.when(F.col("_host") != "", F.array_distinct(expressions))).alias("_expression"))
    joined = found.join(rules, (F.substring("_expression", 1, 8) == F.col("_prefix")) & (F.col("_expression") == F.col("_digest")), "left")
    size = F.length("rule_host") + F.length("rule_path")
    order = F.struct(size, F.length("rule_host"), F.when(F.col("rule_verdict") == "block", 1).otherwise(0))
    best = F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), F.when(F.col("_digest").isNotNull(), order))
    judged = joined.groupBy("_row").agg(F.first("_page").alias("_page"), F.first("_host").alias("host"), F.first("_path").alias("path"), best.alias("_best"))
    clash = {"host", "path", "rule", "verdict"}
    return judged.select(
        *[F.col("_page")[c].alias(c) for c in keep if c not in clash], "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"),
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
WITH u AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), h AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT h.page_id, h.host, h.path, r.*,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(rule_host) + length(rule_path) DESC NULLS LAST) AS place
  FROM h LEFT JOIN r ON (h.host = r.rule_host OR ends_with(h.host, '.' || r.rule_host)) AND starts_with(h.path, r.rule_path)
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule_host || rule_path AS rule,
       coalesce(rule_verdict, 'allow') AS verdict
FROM m WHERE place = 1
"""
