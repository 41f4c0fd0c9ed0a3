"""URL rules by hashed expressions: each URL is expanded into host suffixes and path prefixes, matched by hash.

A rule (host, path, verdict) fits its host and every subdomain where the URL's path starts with the rule's.
The expressions of a URL are the pairs of a host suffix (the host, then the host without its first labels) and
a path prefix. Only those (number of labels, path length) pairs that some rule has are expanded, so a URL gives
at most as many expressions as the rules have shapes, and rules whose paths end in mid-word work as well.

Expressions meet rules on the first 32 bits of their SHA-256, an equi-join on a number; the full digest then
confirms. Of the rules that fit, the longest (host and path together, then host) decides; of equal rules with
contradicting verdicts, block does. A URL with no rule gets ``default``.

Nulls: a null URL or one without ``://`` has the empty host and path and no rule, unless a rule has the empty
host. Repeated rows each get their row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def rule_table(rules: DataFrame) -> DataFrame:
    """(host, path, verdict) -> one row a rule with its digest, its 32-bit prefix and its rank in precedence."""
    one = rules.groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    digest = _digest(F.col("host"), F.col("path"))
    return one.select(
        _short(digest).alias("short"),
        digest.alias("rule_digest"),
        (F.length("host") + F.length("path")).alias("long"),
        F.length("host").alias("host_long"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    ``rules``: host, path, verdict (``allow`` or ``block``). Which rules fit depends on the URL alone, so the
    best rule is found once for each (page_id, url) and joined back; the rows that no rule fits never shuffle
    before that join.
    """
    urls = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    # at most one entry for each pair of a label count and a path length, both bounded by the longest rule
    shapes = rules.select(_labels(F.col("host")).alias("n"), F.length("path").alias("at")).distinct().collect()
    labels = F.split(F.col("host"), r"\.")
    fitting = [
        F.when(
            (F.size(labels) >= n) & (F.length("path") >= at),
            _digest(F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."), F.substring("path", 1, at)),
        )
        for n, at in shapes
    ] or [F.lit(None).cast("string")]
    probes = (
        urls.select("page_id", "url", F.explode(F.array(*fitting)).alias("digest"))
        .filter("digest is not null")
        .withColumn("short", _short(F.col("digest")))
    )
    best = (
        probes.join(rule_table(rules), "short")
        .filter("digest = rule_digest")
        .groupBy("page_id", "url")
        .agg(F.max(F.struct("long", "host_long", "rule", "verdict")).alias("best"))
        .select(F.col("page_id").alias("at_id"), F.col("url").alias("at_url"), "best")
    )
    return urls.join(
        best, F.col("page_id").eqNullSafe(F.col("at_id")) & F.col("url").eqNullSafe(F.col("at_url")), "left"
    ).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
