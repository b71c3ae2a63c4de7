"""Allow and block rules on urls, found by short hash prefixes of host and path expressions.

A url is expanded into the suffixes of its host at dots, times the prefixes of its path at
slashes; a rule names one host and one path. Both sides carry the first 32 bits of the
SHA-256 of "host<newline>path prefix"; they are joined on those, confirmed by the full
digest, and the rest of the rule's path behind its last slash is compared as text. Only as
many host labels and slashes are expanded as the longest rule has, so a long url costs no
more than that. The longest rule wins: the longer host, then the longer path, then block
before allow.

Matches are kept per distinct url and joined back, so a url or a host that holds a third
of the rows is folded before the shuffle. Which side is broadcast is Spark's choice by size.

Defined cases: a null url, or one without "://", has an empty host and path and fits no
rule; a rule with a null host, path or verdict is left out; equal rules count once; without
rules every url gets the default; equal rows come back as often as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendshift.llm.tables import unused

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_COLUMNS = "host string, path string, verdict string"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What stands after the first "://", up to a slash, question mark, hash or the end; ASCII lower case."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, prefix: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), prefix), 256)


def _short(digest: Column) -> Column:
    """The first 32 bits of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def compiled(rules: DataFrame) -> DataFrame:
    """Rules with their digest; the path is split behind its last slash."""
    host = F.translate("host", _UPPER, _LOWER)
    stem = F.regexp_extract("path", r"^(?s)(.*/)?", 0)
    return (
        rules.select(host.alias("host"), F.col("path"), F.col("verdict"))
        .dropna().distinct()
        .select(
            F.concat("host", "path").alias("rule"), F.col("path").alias("rule_path"), "verdict",
            F.length("host").alias("host_length"), F.size(F.split("host", r"\.")).alias("labels"),
            (F.size(F.split(stem, "/")) - 1).alias("slashes"), _digest(F.col("host"), stem).alias("digest"),
        )
        .withColumn("short", _short(F.col("digest")))
    )


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """(url, host, path, rule, verdict) of every distinct url of ``pages``; null once if there are nulls.

    ``rules`` has the columns host, path and verdict (allow or block). ``rule`` is null and
    ``verdict`` the default where no rule fits.
    """
    ready = compiled(rules)
    most = ready.agg(F.coalesce(F.max("labels"), F.lit(0)).alias("labels"), F.coalesce(F.max("slashes"), F.lit(0)).alias("slashes")).first()
    urls = pages.select(F.col(url_col).alias("url")).distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    labels = F.split("host", r"\.")
    steps = F.split("path", "/")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, most.labels)))),
        lambda n: F.array_join(F.slice(labels, -n, n), "."),
    )
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(steps) - 1, F.lit(most.slashes))),
        lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(steps, 1, n), "/"), F.lit("/"))),
    )
    expressions = (
        urls.filter("host <> ''").select("url", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("url", "path", "suffix", F.explode("prefixes").alias("prefix"))
        .withColumn("full", _digest(F.col("suffix"), F.col("prefix")))
        .select("url", "path", "full", _short(F.col("full")).alias("key"))
    )
    fits = (F.col("key") == F.col("short")) & (F.col("full") == F.col("digest")) & F.col("path").startswith(F.col("rule_path"))
    # The longest whole rule wins.
    rank = F.struct(F.length("rule"), "host_length", F.col("verdict") == "block", "rule", "verdict")
    matched = expressions.join(ready, fits).groupBy("url").agg(F.max(rank).alias("best"))
    return urls.join(matched, "url", "left").select(
        "url", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def apply_rules(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", name: str = "judged") -> DataFrame:
    """The rows of ``pages`` with a struct (host, path, rule, verdict); a column of that ``name`` is replaced."""
    pages = pages.drop(name)
    key = unused(pages, "judged_url")
    judged = judge(pages, rules, url_col, default).select(F.col("url").alias(key), F.struct("host", "path", "rule", "verdict").alias(name))
    return pages.join(judged, pages[url_col].eqNullSafe(F.col(key)), "left").drop(key)
