"""URL filters by a blocked Bloom filter and an exact hash join, in DataFrame operations alone.

Rules are canonical (host, path prefix) pairs. A url's candidate keys are its host's label
suffixes with its path's prefixes of the lengths that rules have. A candidate must first
pass the Bloom filter (a block of four 64-bit words, one bit in each); those that pass
meet the rules in an exact join, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import blocks_for, bloom_filter, may_hold
from .common import small, stage, table

#: The rules of the registered query: verdict, host and path prefix.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lowered) and path of a url; both empty for null or a url without '://'."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, PARTS, 1), UPPER, LOWER), F.regexp_extract(text, PARTS, 2)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """rules(rule, verdict): a rule is host, then a path that begins with '/'."""
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for v, r in rules]
    listed = F.array(*rows) if rows else F.array().cast("array<struct<rule: string, verdict: string>>")
    return spark.range(1).select(F.inline(listed))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of pages: id, host, path, rule, verdict.

    The longest fitting rule decides; of rules that are listed twice, a block goes before
    an allow. A url without a fitting rule is allowed, with a null rule; so is a null url
    or one without '://', whose host and path are empty. Repeated rows and null ids are
    kept as they come. An empty table gives no rows; other columns are ignored.
    """
    rules = stage(rules.where("rule IS NOT NULL").groupBy("rule").agg(F.max("verdict").alias("verdict")), "url-rules")
    n = rules.count()
    blocks = blocks_for(n)
    lengths = sorted(r[0] for r in rules.select(F.expr("length(rule) - instr(rule, '/') + 1").alias("k")).distinct().collect())  # a url's length bounds them
    host, path = url_parts(F.col(url_col))
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    spots = parsed.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    hosts = spots.select("host", "path", F.posexplode(labels).alias("at", "label")).select("host", "path", F.expr(r"array_join(slice(split(host, '\\.'), at + 1, size(split(host, '\\.'))), '.')").alias("suffix"))
    sized = F.array(*[F.lit(k) for k in lengths]).cast("array<int>")
    keys = hosts.select("host", "path", "suffix", F.explode(sized).alias("k")).where("k <= length(path)").select("host", "path", F.expr("suffix || substring(path, 1, k)").alias("key"))
    passed = may_hold(keys, "key", stage(bloom_filter(rules, "rule", blocks), "url-bloom"), blocks)
    hits = passed.join(small(rules, n), F.col("key") == F.col("rule"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("k"), "rule", "verdict")).alias("best"))
    best = stage(best.select("host", "path", "best.rule", "best.verdict"), "url-hits")
    return parsed.join(best, ["host", "path"], "left").select(F.col(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict under RULES: (page_id, host, path, rule, verdict)."""
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


OP5_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages
), r(rule, h, p, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
)
SELECT page_id, host, path,
       (SELECT rule FROM r WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) ORDER BY length(rule) DESC LIMIT 1) AS rule,
       coalesce((SELECT verdict FROM r WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) ORDER BY length(rule) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""
