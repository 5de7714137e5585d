"""URL filter: a blocked Bloom filter of the listed URLs, then an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import ascii_lower, bloom_blocks, bloom_filter, bloom_may_contain, fresh

def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule (the fitting rule's host and path, else null) and verdict.

    rules: host, path, verdict. A rule fits its host and all hosts below it, if the url's path starts with the rule's;
    the longest fitting rule wins (at equal length the greater text, then the greater verdict). A url that no rule
    fits gets `default`: what the list does not hold is not filtered.

    A url asks for its host's suffixes (no more labels than a rule has) with its path's prefixes (of the lengths that
    rules have). The filter, whose size has a bound, passes the possible hits; an exact join on their text removes the
    false positives. Only distinct possible hits are joined, so a host that all pages have costs one row.

    Null url, or one without `://`: host and path are empty, which only a rule of an empty host could fit. Columns of
    pages that have one of the four names go; other columns stay. Rules with a null host or path count as empty there.
    """
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    (hits,) = fresh(pages.select(*kept), "hits_")
    listed = rules.select(
        ascii_lower(F.coalesce("host", F.lit(""))).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")
    ).withColumn("rule_text", F.concat("rule_host", "rule_path"))
    listed = listed.groupBy("rule_host", "rule_path", "rule_text").agg(F.max("rule_verdict").alias("rule_verdict"))
    count, lengths, labels = listed.agg(F.count(F.lit(1)), F.sort_array(F.collect_set(F.length("rule_path"))), F.max(F.size(F.split("rule_host", r"\.")))).first()
    if count == 0:
        return pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = bloom_blocks(count)
    filled = bloom_filter(listed.select(F.xxhash64("rule_host", "rule_path").alias("h")), "h", blocks)

    seen = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(labels), F.size(F.split("host", r"\.")))), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n)
    )
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    asked = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("rule_host"), p.alias("rule_path")))))
    possible = F.filter(asked, lambda a: bloom_may_contain(filled, F.xxhash64(a["rule_host"], a["rule_path"]), blocks))
    seen = seen.withColumn(hits, possible)

    keys = seen.select(F.explode(hits).alias("k")).select("k.*").distinct()
    exact = keys.join(listed, ["rule_host", "rule_path"])
    best = (
        seen.where(F.size(hits) > 0).select(hits).distinct()
        .select(hits, F.explode(hits).alias("k"))
        .select(hits, "k.rule_host", "k.rule_path")
        .join(exact, ["rule_host", "rule_path"])
        .groupBy(hits)
        .agg(F.max(F.struct(F.length("rule_text").alias("n"), "rule_text", "rule_verdict")).alias("best_"))
        .withColumnRenamed(hits, "of_")
    )
    judged = seen.join(best, F.col(hits) == F.col("of_"), "left")
    return judged.select(*kept, "host", "path", F.col("best_.rule_text").alias("rule"), F.coalesce("best_.rule_verdict", F.lit(default)).alias("verdict"))


def rules_frame(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """rules: (verdict, host and path), like ("block", "example.com/en/")."""
    rows = [F.struct(F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path"), F.lit(v).alias("verdict")) for v, r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))
