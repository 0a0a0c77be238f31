"""URL filters by host-suffix and path-prefix expressions.

A rule (host, path, action) fits its host and all subdomains where the url's
path starts with the rule's. Each url is expanded into the suffixes of its host
that have as many labels as some rule host, times the prefixes of its path that
are as long as some rule path. The expansions meet the rules in an equi-join on
the first four bytes of their SHA-256; the whole digest is then compared and
the longest rule wins (ties: the longer host, then ``block``).

Null urls and urls without ``://`` have an empty host and path and fit no rule.
Rows may repeat or lack a page_id: rules are looked up once per distinct
(host, path) and joined back. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.keys import ascii_lower, attach

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")


def _digest(host: Column, path: Column) -> Column:
    # A zero byte keeps host and path apart; neither side can hold it as a separator of its own.
    return F.sha2(F.concat(host, F.lit("\u0000"), path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def url_parts(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.split(url, "://", 2)[1]).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages(page_id, url)``."""
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    shape = rules.agg(F.collect_set(F.size(F.split("host", "\\."))), F.collect_set(F.length("path"))).first()
    if not shape[0]:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    suffixes = F.array_distinct(F.array(*(F.substring_index("host", ".", -k) for k in sorted(shape[0]))))
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in sorted(shape[1]))), lambda x: x.isNotNull())
    expanded = rows.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    expanded = expanded.select("host", "path", "suffix", F.explode("prefixes").alias("prefix")).select("host", "path", _digest(F.col("suffix"), F.col("prefix")).alias("digest"))
    known = rules.distinct().select(_digest(F.col("host"), F.col("path")).alias("full"), F.concat("host", "path").alias("rule"), "action", F.length("host").alias("wide"))
    hit = expanded.withColumn("short", _short(F.col("digest"))).join(known.withColumn("short", _short(F.col("full"))), "short").where("digest = full")
    best = hit.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), F.col("wide"), F.col("action"), F.col("rule"))).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))
    return attach(rows, best, ("host", "path")).select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


ORACLE = """
with u as (select page_id, case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end as rest from pages),
h as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from u),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
r(rh, rp, action) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f as (select host, path, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(action, length(rh || rp)) as action
  from (select distinct host, path from p), r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by 1, 2)
select p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') as verdict from p left join f on p.host = f.host and p.path = f.path
"""
