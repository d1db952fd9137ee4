"""Boilerplate lines by their frequency relative to the site.

A line goes from a host's pages if more than ``ratio`` of the host's pages
hold it (and at least ``least_pages`` do). Counts are made from line hashes,
so a shuffle carries no text, and partial sums absorb a hot host or line.
Since a page has few lines, at most (lines a page) / ratio lines of a host
can pass the ratio: the pages are rewritten in place against their host's
short list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.checkpoints import kept
from .names import fresh

#: Lists with up to this many lines in all (some 12 MB) are broadcast; beyond it the pages are shuffled by host.
BROADCAST_LINES = 200_000
WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """What makes lines equal: their characters without white space around them, as a 128-bit hash; null for blank lines."""
    return F.transform(F.array(F.btrim(line, F.lit(WHITE))), lambda bare: F.when(bare != "", F.md5(bare)))[0]


def boilerplate(pages: DataFrame, *, host_col: str = "host", text_col: str = "text", ratio: float = 0.1, least_pages: int = 5) -> DataFrame:
    """host, key, n_pages and n_host of the lines to drop. A null host is a host of its own."""
    hosts = pages.groupBy(F.col(f"`{host_col}`").alias("host")).agg(F.count("*").alias("n_host"))
    keys = F.array_distinct(F.transform(F.split(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "\n"), line_key))
    held = pages.select(F.col(f"`{host_col}`").alias("host"), F.explode(keys).alias("key")).filter(F.col("key").isNotNull())
    counts = held.groupBy("host", "key").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= least_pages)
    hosts = hosts.select(F.col("host").alias("_host"), "n_host")
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).filter(F.col("n_pages") > F.col("n_host") * ratio).drop("_host")


def drop_lines(pages: DataFrame, *, host_col: str = "host", text_col: str = "text", ratio: float = 0.1, least_pages: int = 5, keep_whole: bool = True) -> DataFrame:
    """``pages`` without their boilerplate lines, and with ``n_lines`` and ``n_dropped`` (non-blank lines).

    With ``keep_whole`` a page that would lose all its lines keeps them: a
    copied page is not boilerplate. Otherwise its text is what blank lines
    are left. A null text stays null and has no lines. Columns of the two
    names are replaced; all others, whatever they are called, and repeated
    rows stay.
    """
    host, keys, lines, n, d = fresh(pages.columns, "_host", "_keys", "_lines", "_n", "_d")
    listed = boilerplate(pages, host_col=host_col, text_col=text_col, ratio=ratio, least_pages=least_pages)
    listed = kept(listed.groupBy(F.col("host").alias(host)).agg(F.collect_list("key").alias(keys)))
    few = (listed.agg(F.sum(F.size(keys))).first()[0] or 0) <= BROADCAST_LINES
    listed = F.broadcast(listed) if few else listed
    columns = [c for c in pages.columns if c.lower() not in ("n_lines", "n_dropped")]
    keyed = F.transform(F.split(F.col(f"`{text_col}`").cast("string"), "\n"), lambda x: F.struct(x.alias("line"), line_key(x).alias("key")))
    joined = pages.select(*(F.col(f"`{c}`") for c in columns)).join(listed, F.col(f"`{host_col}`").eqNullSafe(F.col(host)), "left").withColumn(lines, keyed)
    solid = F.filter(lines, lambda x: x["key"].isNotNull())
    dropped = F.when(F.col(keys).isNull(), 0).otherwise(F.size(F.filter(lines, lambda x: F.coalesce(F.array_contains(keys, x["key"]), F.lit(False)))))
    counted = joined.withColumn(n, F.coalesce(F.size(solid), F.lit(0))).withColumn(d, F.coalesce(dropped, F.lit(0)))
    rewrite = (F.col(d) > 0) & ((F.col(d) < F.col(n)) | F.lit(not keep_whole))
    rest = F.filter(lines, lambda x: x["key"].isNull() | ~F.array_contains(keys, x["key"]))
    text = F.when(rewrite, F.array_join(F.transform(rest, lambda x: x["line"]), "\n")).otherwise(F.col(f"`{text_col}`"))
    return counted.select(
        *(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in columns),
        F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(F.col(n)).cast("long").alias("n_lines"),
        F.when(rewrite, F.col(d)).otherwise(0).cast("long").alias("n_dropped"),
    )


def page_host(url: Column) -> Column:
    """The lower-case host of a URL, or null."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/:?#]+)", 1)
    return F.when(host != "", host)


def html_lines(html: Column) -> Column:
    """The text of a page, a line for each stretch between tags; scripts, styles and comments are left out."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "\n")
    bare = F.regexp_replace(bare, r"<[^>]*>", "\n")
    return F.regexp_replace(bare, r"\n[\x20\x09-\x0D]*\n", "\n")
