"""Deletion, merging, moving of components; the file cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .index import KEYS, Index

#: Fresh doc_ids tried for a record whose own is taken.
CANDIDATES = 4
TOMBSTONES = "collection string, component_id string, doc_id bigint"


def delete_urls(index: Index, urls: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Tombstones (keys, doc_id) with those of all records of the urls (url). A url that isn't there, or is already
    deleted, changes nothing; null and empty urls are none."""
    own = index.docs.join(urls.where("url <> ''").select("url").distinct(), "url", "left_semi").select(*KEYS, "doc_id")
    return own if tombstones is None else tombstones.select(*KEYS, "doc_id").unionByName(own).distinct()


def _held(index: Index, asked: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(keys, url, status) of each asked url in each component that has records of it: DELETED if all are, or PRESENT."""
    dead = tombstones.select(*KEYS, "doc_id").distinct().withColumn("dead", F.lit(1))
    own = index.docs.join(asked, "url", "left_semi").join(dead, [*KEYS, "doc_id"], "left").groupBy(*KEYS, "url").agg(F.count("*").alias("n"), F.count("dead").alias("gone"))
    return own.select(*KEYS, "url", F.when(F.col("gone") == F.col("n"), "DELETED").otherwise("PRESENT").alias("status"))


def status(index: Index, urls: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(url, keys, status) of each url in each component: MISSING, PRESENT or DELETED (all its records are)."""
    asked = urls.select("url").distinct()
    # the answer has a row for each asked url and component; compaction keeps components few
    every = asked.join(F.broadcast(index.docs.select(*KEYS).distinct()), F.lit(True), "inner")
    return every.join(_held(index, asked, tombstones), [*KEYS, "url"], "left").select("url", *KEYS, F.coalesce("status", F.lit("MISSING")).alias("status"))


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("url", "status").agg(F.count("*").alias("components"))


def status_histogram(index: Index, urls: DataFrame, tombstones: DataFrame) -> DataFrame:
    """status_counts of the status of the urls, without a row for each url and component: the components where a url is
    MISSING are those left of all."""
    asked = urls.select("url").distinct()
    every = index.docs.select(*KEYS).distinct().agg(F.count("*").alias("every"))
    held = _held(index, asked, tombstones).groupBy("url").agg(F.count_if(F.col("status") == "PRESENT").alias("PRESENT"), F.count_if(F.col("status") == "DELETED").alias("DELETED"))
    wide = asked.join(held, "url", "left").na.fill(0, ["PRESENT", "DELETED"]).join(F.broadcast(every), F.lit(True), "inner")
    wide = wide.withColumn("MISSING", F.col("every") - F.col("PRESENT") - F.col("DELETED"))
    kinds = F.array(*(F.struct(F.lit(k).alias("status"), F.col(k).alias("components")) for k in ("MISSING", "PRESENT", "DELETED")))
    return wide.select("url", F.inline(kinds)).where("components > 0")


def without_deleted(index: Index, tombstones: DataFrame | None) -> Index:
    if tombstones is None:
        return index
    dead = tombstones.select(*KEYS, "doc_id")
    return Index(*(t.join(dead, [*KEYS, "doc_id"], "left_anti") for t in (index.docs, index.postings)))


def _renumbered(kept: DataFrame, component_id: str) -> DataFrame:
    """kept with new_id: the doc_id, or, of a's record of a doc_id that both sides have, one that no record has. Each such
    record has CANDIDATES of them; it takes the first that is neither in use nor a candidate of another record."""
    rows = kept.withColumn("both", F.count("*").over(W.partitionBy("doc_id")) > 1)
    clash = rows.where(F.col("both") & (F.col("side") == 0)).select(*KEYS, "side", "doc_id")
    tries = clash.select("*", F.explode(F.sequence(F.lit(1), F.lit(CANDIDATES))).alias("k"))
    tries = tries.withColumn("candidate", F.xxhash64(*KEYS, "doc_id", F.lit(component_id), "k"))
    free = tries.join(kept.select(F.col("doc_id").alias("candidate")), "candidate", "left_anti")
    free = free.withColumn("n", F.count("*").over(W.partitionBy("candidate"))).where("n = 1")
    fresh = free.groupBy(*KEYS, "side", "doc_id").agg(F.min_by("candidate", "k").alias("fresh"))
    out = rows.join(fresh, [*KEYS, "side", "doc_id"], "left")
    none = F.raise_error(F.lit("no free doc_id among the candidates")).cast("bigint")
    moves = F.col("both") & (F.col("side") == 0)
    return out.withColumn("new_id", F.when(moves, F.coalesce("fresh", none)).otherwise(F.col("doc_id"))).drop("both", "fresh")


def merged(a: Index, b: Index, collection: str, component_id: str, tombstones: DataFrame | None = None) -> Index:
    """One component of two. Deleted records go first, with their postings; then each url keeps one record, of a before
    b and of the least doc_id (records without url all stay); a doc_id that both have is given anew to a's record. Of an empty b, a is left."""
    a, b = without_deleted(a, tombstones), without_deleted(b, tombstones)
    docs = a.docs.withColumn("side", F.lit(0)).unionByName(b.docs.withColumn("side", F.lit(1)))
    own = F.when(F.coalesce(F.col("url"), F.lit("")) == "", F.concat_ws("\\0", F.lit(""), "side", *KEYS, "doc_id")).otherwise(F.col("url"))
    docs = docs.withColumn("own", own)
    first = docs.groupBy("own").agg(F.min(F.struct("side", *KEYS, "doc_id")).alias("first")).select("own", "first.*")
    kept = docs.join(first, ["own", "side", *KEYS, "doc_id"], "left_semi").drop("own")
    kept = _renumbered(kept, component_id)
    posts = a.postings.withColumn("side", F.lit(0)).unionByName(b.postings.withColumn("side", F.lit(1)))
    posts = posts.join(kept.select(*KEYS, "side", "doc_id", "new_id"), [*KEYS, "side", "doc_id"])
    here = [F.lit(collection).alias("collection"), F.lit(component_id).alias("component_id")]
    return Index(
        kept.select(*here, F.col("new_id").alias("doc_id"), "url", "doc_len"), posts.select(*here, "term", F.col("new_id").alias("doc_id"), "tf", "doc_len")
    )


def first_of_each(a: DataFrame, b: DataFrame, key: str = "url") -> DataFrame:
    """The rows of two content or metadata tables, one per key, a's before b's."""
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    return both.groupBy(key).agg(F.min_by(F.struct(*a.columns), "side").alias("r")).select("r.*")


def moved(index: Index, source: str, target: str) -> Index:
    """The components of one collection put into another."""
    name = F.when(F.col("collection") == source, target).otherwise(F.col("collection"))
    return index._each(lambda t: t.withColumn("collection", name))


def collections(index: Index) -> DataFrame:
    return index.docs.groupBy("collection").agg(F.countDistinct("component_id").alias("components"), F.count("*").alias("docs"))


def first_write_wins(cache: DataFrame | None, new: DataFrame, key: str = "doc_uri", order: str | None = None) -> DataFrame:
    """The cache with the new rows whose key it hasn't; of several new rows of a key the first by `order`. Null keys are
    no entries."""
    rows = new.where(F.col(key).isNotNull())
    one = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*([order] if order else []), F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]))).alias("r"))
    one = one.select("r.*")
    return one if cache is None else cache.unionByName(one.join(cache, key, "left_anti"))


def ingest_or_get(cache: DataFrame, new: DataFrame, key: str = "doc_uri") -> DataFrame:
    """The rows of the cache after ingestion whose keys were asked for, each marked whether it was there before."""
    asked = new.select(key).distinct()
    before = cache.select(key).distinct().withColumn("cached", F.lit(True))
    return first_write_wins(cache, new, key).join(asked, key, "left_semi").join(before, key, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
