"""Ranked and unranked search over an index."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.functions import scoring
from lodestack.functions.text import tokenize
from lodestack.plans.patterns import term_filter

from .index import KEYS, Index


def _alive(posts: DataFrame, tombstones: DataFrame | None) -> DataFrame:
    return posts if tombstones is None else posts.join(tombstones.select(*KEYS, "doc_id"), [*KEYS, "doc_id"], "left_anti")


def _scored(index: Index, posts: DataFrame, of_terms, wanted, tombstones: DataFrame | None, global_stats: bool) -> DataFrame:
    """posts (keys, term, doc_id, tf, doc_len, times) summed up to (keys, doc_id, score, term_count), where term_count
    meets `wanted`. Document frequencies are those of the dictionary's terms that meet `of_terms`. Statistics count
    deleted records until they are merged away. The table of records isn't read."""
    by = [] if global_stats else KEYS
    freq = index.terms.where(of_terms).select(*by, "term", "doc_freq")
    freq = freq if by else freq.groupBy("term").agg(F.sum("doc_freq").alias("doc_freq"))
    stats = index.stats if not global_stats else index.stats.agg(F.sum("num_docs").alias("num_docs"), F.sum("total_doc_len").alias("total_doc_len"))
    rows = _alive(posts, tombstones).join(freq, [*by, "term"])
    # one row per component; a single row for all
    rows = rows.join(F.broadcast(stats), KEYS) if by else rows.join(F.broadcast(stats))
    average = F.expr("total_doc_len DIV num_docs")
    part = F.col("times") * scoring.idf(F.col("num_docs"), F.col("doc_freq")) * scoring.saturation(F.col("tf"), F.col("doc_len"), average)
    return rows.groupBy(*KEYS, "doc_id").agg(F.sum(part).alias("score"), F.sum("times").cast("int").alias("term_count")).where(wanted(F.col("term_count")))


def scores(index: Index, query: str, tombstones: DataFrame | None = None, global_stats: bool = False) -> DataFrame:
    """(keys, doc_id, score, term_count) of the records that hold every term of the query. A term given twice counts
    twice. A query without terms finds nothing."""
    asked = Counter(tokenize(query))
    spark = index.docs.sparkSession
    q = spark.createDataFrame(list(asked.items()) or [("", 0)], "term string, times int")
    held = F.col("term").isin(*asked) if asked else F.lit(False)
    posts = index.postings.where(held).join(F.broadcast(q), "term")
    return _scored(index, posts, held, lambda n: n == asked.total(), tombstones, global_stats)


def with_urls(index: Index, found: DataFrame) -> DataFrame:
    return found.join(index.docs.select(*KEYS, "doc_id", "url"), [*KEYS, "doc_id"]).select(*KEYS, "doc_id", "url", "score", "term_count")


def bm25(index: Index, query: str, tombstones: DataFrame | None = None, global_stats: bool = False) -> DataFrame:
    """As scores, with urls, which are joined to what was found only."""
    return with_urls(index, scores(index, query, tombstones, global_stats))


def bm25_pattern(index: Index, pattern: str, tombstones: DataFrame | None = None) -> DataFrame:
    """As bm25, of the terms a pattern matches: the pattern is one term of a query, so that only the records that hold
    exactly one matching term are found."""
    held = term_filter("term", pattern)
    posts = index.postings.where(held).withColumn("times", F.lit(1))
    return with_urls(index, _scored(index, posts, held, lambda n: n == 1, tombstones, False))


def best(index: Index, query: str, n: int | None = None, tombstones: DataFrame | None = None, global_stats: bool = False) -> DataFrame:
    """The best n records by score, then the best of each url; so it may hold fewer than n. Urls are joined to these n."""
    found = scores(index, query, tombstones, global_stats)
    if n is not None:
        found = found.orderBy(F.col("score").desc(), *KEYS, "doc_id").limit(n)
    return top(with_urls(index, found))


def component_top(found: DataFrame, k: int) -> DataFrame:
    """The best k of each component by whole points of score; of equals the earlier doc_id."""
    order = W.partitionBy(*KEYS).orderBy(F.floor("score").desc(), "doc_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _apart(url: str = "url"):
    """A url, or what stands for it of a record that has none: such records are never taken for one another."""
    own = F.struct(F.lit(None).cast("string").alias("url"), F.struct(*KEYS, "doc_id").alias("record"))
    return F.when(F.coalesce(F.col(url), F.lit("")) == "", own).otherwise(F.struct(F.col(url).alias("url"), F.lit(None).cast(_RECORD).alias("record")))


_RECORD = "struct<collection:string,component_id:string,doc_id:bigint>"


def top(found: DataFrame, n: int | None = None) -> DataFrame:
    """The best n of all components by score, then the best of each url; records without url all stay."""
    if n is not None:
        found = found.orderBy(F.col("score").desc(), "url", *KEYS, "doc_id").limit(n)
    first = F.max_by(F.struct(*found.columns), F.struct("score", -F.col("doc_id"))).alias("best")
    return found.groupBy(_apart().alias("own")).agg(first).select("best.*").orderBy(F.col("score").desc(), "url")


def all_terms(index: Index, query: str, tombstones: DataFrame | None = None) -> DataFrame:
    """(keys, doc_id, url), unranked, of the records that hold every term of a query; none for a query without terms."""
    asked = sorted(set(tokenize(query)))
    posts = _alive(index.postings.where(F.col("term").isin(*asked) if asked else F.lit(False)), tombstones)
    found = posts.groupBy(*KEYS, "doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(asked))
    return _with_url(index, found)


def any_match(index: Index, pattern: str, tombstones: DataFrame | None = None) -> DataFrame:
    """(keys, doc_id, url) of the records that hold a term the pattern matches."""
    return _with_url(index, _alive(index.postings.where(term_filter("term", pattern)), tombstones).select(*KEYS, "doc_id").distinct())


def _with_url(index: Index, found: DataFrame) -> DataFrame:
    return found.select(*KEYS, "doc_id").join(index.docs.select(*KEYS, "doc_id", "url"), [*KEYS, "doc_id"])


def with_metadata(found: DataFrame, metadata: DataFrame) -> DataFrame:
    """Joins (keys, url, meta); a record without metadata keeps its row with a null map. The uri is left out of the map."""
    own = metadata.select(*KEYS, "url", F.map_filter("meta", lambda k, v: k != "uri").alias("meta"))
    return found.join(own, [*KEYS, "url"], "left")


def term_lookup(index: Index, term: str) -> DataFrame:
    return index.terms.where(F.col("term") == term)


def term_scan(index: Index, pattern: str) -> DataFrame:
    return index.terms.where(term_filter("term", pattern))


def doc_by_id(index: Index, doc_id: int) -> DataFrame:
    return index.docs.where(F.col("doc_id") == doc_id)


def docs_by_url(index: Index, url: str) -> DataFrame:
    return index.docs.where(F.col("url") == url).orderBy(*KEYS, "doc_id")


def cached_copy(content: DataFrame, url: str) -> DataFrame:
    """(url, content) of the first component that has the url; a row that says so if none has."""
    own = content.where(F.col("url") == url).orderBy(*KEYS, "content").limit(1).select("url", "content")
    none = content.sparkSession.createDataFrame([(url, "{not found!}")], "url string, content string")
    return none.join(own.withColumnRenamed("content", "copy"), "url", "left").select("url", F.coalesce("copy", "content").alias("content"))
