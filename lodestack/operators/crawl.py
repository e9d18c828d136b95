"""What a crawl does to pages and urls, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.functions import html as H
from lodestack.functions import urls as U

# Fixed value: seconds between two fetches of a host.
DELAY = 0.4


def page_links(pages: DataFrame) -> DataFrame:
    """(page, link) of pages (url, html): every resolved link once."""
    ref = pages.select(F.col("url").alias("page"), H.base_href(F.col("html")).alias("base"), F.explode(H.links(F.col("html"))).alias("ref"))
    return ref.select("page", U.resolved(F.col("ref"), F.col("page"), F.col("base")).alias("link")).where("link IS NOT NULL").distinct()


def allowed(urls: DataFrame, patterns: list[str]) -> DataFrame:
    """The urls (url) that match any pattern. Patterns are a job's seeds: one expression, no join."""
    if not patterns:
        return urls.where(F.lit(False))
    any_of = F.lit(False)
    for p in patterns:
        any_of = any_of | F.col("url").rlike(p)
    return urls.where(any_of)


def unique_bodies(pages: DataFrame, body: str = "content", order: str = "url") -> DataFrame:
    """One page of each body, the first by `order`."""
    rows = pages.where(F.col(body).isNotNull()).withColumn("md5", F.md5(body))
    return rows.groupBy("md5").agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def schedule(urls: DataFrame, start: str, delay: float = DELAY) -> DataFrame:
    """(url, host, place, at): the k-th url of a host, in an order by their prints, may be fetched from start + (k - 1)
    delays on. Each url once; urls without a host can't be fetched. A host's places are counted in two steps, over 256
    parts of its urls and within them, so that no host is in one task."""
    own = urls.select("url").distinct().withColumn("host", U.host(F.col("url"))).where("host IS NOT NULL")
    own = own.withColumn("part", F.substring(F.md5("url"), 1, 2))
    sizes = own.groupBy("host", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("host").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = own.withColumn("k", F.row_number().over(W.partitionBy("host", "part").orderBy("url")))
    placed = within.join(before.drop("n"), ["host", "part"]).withColumn("place", F.col("before") + F.col("k"))
    at = F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + ((F.col("place") - 1) * F.lit(round(delay * 1e6))).cast("bigint"))
    return placed.select("url", "host", "place", at.alias("at"))


def not_downloaded(paths: DataFrame, have: DataFrame) -> DataFrame:
    """(path, command) of the listed paths whose file names are not among those there (name)."""
    name = F.element_at(F.split("path", "/"), -1)
    left = paths.withColumn("name", name).join(have.select("name").distinct(), "name", "left_anti")
    return left.select("path", F.format_string("wget -c %s", "path").alias("command"))
