"""URL filtering: a blocked Bloom filter in front of an exact join; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import materialize, may_hold, word_count

#: Labels that canonical hosts go without.
SERVICE_LABELS = r"^(www|m|blog)\."


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a service label, and path without closing slashes; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, SERVICE_LABELS, ""), F.rtrim(path, F.lit("/"))))


def listed(urls: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Add ``listed`` to ``urls``: is its canonical URL ``canon`` one of those of ``blocklist``?

    ``may_hold`` passes the possible hits by a blocked Bloom filter. URLs that it does not hold are done, and not shuffled
    while the filter can be broadcast; the possible hits are joined with the list itself, which removes false positives.
    A URL that fills much of the table splits as any skewed join does, for the list has each URL once. A null URL is not
    listed; rows that repeat stay; an empty list holds nothing.
    """
    once = materialize(blocklist.where("canon is not null").select("canon").distinct())
    probed = may_hold(urls, "canon", once, "may")
    keyed = once.select("canon", F.xxhash64("canon").alias("h"), F.lit(True).alias("listed"))
    hits = probed.where("may").withColumn("h", F.xxhash64("canon")).join(keyed, ["h", "canon"], "left").drop("h")
    hits = hits.withColumn("listed", F.coalesce("listed", F.lit(False)))
    return hits.unionByName(probed.where("not may").withColumn("listed", F.lit(False))).drop("may")


def judge(pages: DataFrame, blocklist: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A verdict for every page: that of the longest rule that fits, or else block if the URL is listed.

    ``rules`` are (verdict, host, path); a rule fits its host and all subdomains if the path starts with the rule's.
    Returns page_id, host, path, canon, rule, verdict. Pages without a usable URL are allowed; repeated rows are judged
    one by one; other columns are ignored; an empty table gives no rows.
    """
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    urls = urls.withColumn("canon", canonical(F.col("host"), F.col("path")))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return listed(urls, blocklist).select("page_id", "host", "path", "canon", rule.alias("rule"), verdict.alias("verdict"))


def entries(urls: DataFrame) -> DataFrame:
    """The list to block, from a table of listed URLs (url), in any spelling: canon, once each. URLs without a host, and nulls, list nothing."""
    return urls.select(canonical(host(F.col("url")), path(F.col("url"))).alias("canon")).where("canon is not null").distinct()


def spam(pages: DataFrame) -> DataFrame:
    """The pages (url) whose host says so: one of its labels, or a part of one between hyphens, is ``spam``."""
    return pages.where(host(F.col("url")).rlike(r"(^|[.-])spam([.-]|$)")).select("url")


def thin(pages: DataFrame, least: int = 60) -> DataFrame:
    """The pages (url) whose html has fewer than ``least`` words between its tags; pages without html are thin."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), "(?s)<[^>]*>", " ")
    return pages.where(word_count(text) < least).select("url")
