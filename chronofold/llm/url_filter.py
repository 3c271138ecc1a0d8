"""URL rules by host suffix and path prefix.

Each URL is expanded into the host suffixes and the directory prefixes of its path that a
rule could name. Both sides meet on the first bytes of a digest; full digests and the rest
of a rule's path are confirmed after the join, and the longest rule decides. Each distinct
(host, path) is judged once, so a host with a third of all rows is no hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8
"""Hex digits of a digest in the join key: four bytes."""

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without a scheme or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(action, host, path) rules as a table."""
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), folder), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to ``pages``.

    A rule (action, host, path) fits its host and all subdomains when the URL's path starts
    with the rule's. The rule with most characters decides; of equal ones the one with the
    longer host, then ``block``. ``default`` is the verdict without a rule. Null URLs and
    URLs without a scheme have an empty host and path, and no rule fits them unless it names
    that; a rule with a null field is void; repeated rows and rules change nothing; very long URLs are
    judged whole; without rules every verdict is ``default``; an empty table gives no rows. Columns
    of ``pages`` named like the results are replaced, others stay.
    """
    host, path = url_parts(F.col(url))
    rows = pages.drop("rule", "verdict").withColumns({"host": host, "path": path})

    rule_path = F.col("r_path")
    sound = rules.where("action is not null and host is not null and path is not null").select(
        F.col("action").alias("r_action"), F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path")
    )
    folder = F.regexp_extract(rule_path, "^(?s:.*/)?", 0)
    sound = sound.distinct().withColumn("r_digest", _digest(F.col("r_host"), folder))
    sound = sound.withColumn("short", F.substring("r_digest", 1, PREFIX_HEX))
    labels, depth = sound.agg(
        F.max(F.size(F.split("r_host", r"\."))), F.max(_slashes(rule_path))
    ).first()

    urls = rows.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    tails = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels or 1))),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    slashes = "length(path) - length(replace(path, '/', ''))"
    folders = F.expr(
        f"transform(sequence(0, least({slashes}, {depth or 0})), n -> if(n = 0, '', substring_index(path, '/', n) || '/'))"
    )
    names = urls.select("host", "path", F.explode(tails).alias("tail"), folders.alias("folders"))
    names = names.select("host", "path", "tail", F.explode("folders").alias("folder"))
    names = names.select("host", "path", _digest(F.col("tail"), F.col("folder")).alias("digest"))
    names = names.withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    hits = names.join(sound, "short").where(
        (F.col("digest") == F.col("r_digest")) & F.startswith("path", rule_path)
    )
    rank = F.struct(F.length("r_host") + F.length(rule_path), F.length("r_host"), F.col("r_action") == "block")
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(rank.alias("rank"), F.concat("r_host", "r_path").alias("rule"), "r_action")).alias("best")
    )
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.r_action").alias("verdict"))
    # Written, so that a URL with a third of all rows, or the null ones, can be split between tasks.
    best = Scratch(pages.sparkSession).keep(best, "best")
    return rows.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
