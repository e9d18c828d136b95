"""The inverted index as tables: build, write, open, dump, verify."""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import tokens

from .tables import Files, written

KEYS = ["collection", "component_id"]


class Reply(NamedTuple):
    num_docs: int
    num_terms: int
    ms_taken: int


@dataclass
class Index:
    """docs (keys, doc_id, url, doc_len), postings (keys, term, doc_id, tf, doc_len); dictionary (keys, term, doc_freq,
    n_chars) and totals (keys, num_docs, total_doc_len) are tables of a written index, and else follow from the first two."""

    docs: DataFrame
    postings: DataFrame
    dictionary: DataFrame | None = None
    totals: DataFrame | None = None

    @property
    def terms(self) -> DataFrame:
        if self.dictionary is not None:
            return self.dictionary
        return self.postings.groupBy(*KEYS, "term").agg(F.count("*").alias("doc_freq")).withColumn("n_chars", F.length("term"))

    @property
    def stats(self) -> DataFrame:
        if self.totals is not None:
            return self.totals
        return self.docs.groupBy(*KEYS).agg(F.count("*").alias("num_docs"), F.sum("doc_len").cast("bigint").alias("total_doc_len"))

    def _each(self, change) -> Index:
        return Index(*(None if t is None else change(t) for t in (self.docs, self.postings, self.dictionary, self.totals)))

    def where(self, condition) -> Index:
        return self._each(lambda t: t.where(condition))

    def union(self, other: Index) -> Index:
        both = self.dictionary is not None and other.dictionary is not None and self.totals is not None and other.totals is not None
        more = (self.dictionary.unionByName(other.dictionary), self.totals.unionByName(other.totals)) if both else ()
        return Index(self.docs.unionByName(other.docs), self.postings.unionByName(other.postings), *more)

    def as_component(self, component_id: str) -> Index:
        """All components of each collection seen as one: dictionaries and totals are summed up, of the terms asked for
        only, since a filter on the term reaches the scan. doc_ids must differ between the components."""
        name = F.lit(component_id)
        docs, posts = (t.withColumn("component_id", name) for t in (self.docs, self.postings))
        terms = self.terms.groupBy("collection", "term").agg(F.sum("doc_freq").alias("doc_freq"), F.max("n_chars").alias("n_chars"))
        stats = self.stats.groupBy("collection").agg(F.sum("num_docs").alias("num_docs"), F.sum("total_doc_len").alias("total_doc_len"))
        return Index(docs, posts, terms.withColumn("component_id", name), stats.withColumn("component_id", name))


def tokenized(docs: DataFrame) -> DataFrame:
    """docs (url, content, and if given collection, component_id, doc_id) with the terms of url and content.

    A record without doc_id gets one from its component and url. A null url stays null and has no terms; null contents
    count as empty.
    """
    has = set(docs.columns)
    collection = F.col("collection") if "collection" in has else F.lit("default")
    component = F.col("component_id") if "component_id" in has else F.lit("0")
    url = F.col("url") if "url" in has else F.lit(None).cast("string")
    doc_id = F.col("doc_id") if "doc_id" in has else F.xxhash64(component, F.coalesce(url, F.lit("")))
    terms = F.concat(tokens(url), tokens(F.col("content")))
    return docs.select(collection.alias("collection"), component.alias("component_id"), doc_id.cast("bigint").alias("doc_id"), url.alias("url"), terms.alias("tokens"))


def build(docs: DataFrame, stored: bool = False) -> Index:
    """The index of a batch of records. Postings are combined before they are shuffled, by record and term. An index that
    is read more than once is stored: its terms are written to the shared folder, so that texts are cut only once."""
    own = written(tokenized(docs), "tokens") if stored else tokenized(docs)
    rows = own.select(*KEYS, "doc_id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term"))
    postings = rows.groupBy(*KEYS, "term", "doc_id").agg(F.count("*").cast("int").alias("tf"), F.max("doc_len").alias("doc_len"))
    return Index(own.select(*KEYS, "doc_id", "url", F.size("tokens").alias("doc_len")), postings)


_DOCS = "doc_id bigint, url string, doc_len int, collection string, component_id string"
_POSTINGS = "term string, doc_id bigint, tf int, doc_len int, collection string, component_id string"
_TERMS = "term string, doc_freq bigint, n_chars int, collection string, component_id string"
_STATS = "num_docs bigint, total_doc_len bigint, collection string, component_id string"
SCHEMAS = {"docs": _DOCS, "postings": _POSTINGS, "terms": _TERMS, "stats": _STATS}


def write(index: Index, path: str) -> Reply:
    """Writes an index to a folder of its own: postings, dictionary, records, totals. Each later table is made from an
    earlier one as written, so that texts are cut once. Postings and dictionary are sorted by term within files, so that
    a term is found by its row groups' bounds. Of no records or no terms nothing is left."""
    began = time.monotonic()
    spark = index.docs.sparkSession

    def put(df: DataFrame, name: str, by: str) -> DataFrame:
        own = df.repartitionByRange(*KEYS, by).sortWithinPartitions(*KEYS, by)
        own.write.mode("overwrite").option("compression", "zstd").partitionBy(*KEYS).parquet(f"{path}/{name}")
        return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")

    posts = put(index.postings.select(*KEYS, "term", "doc_id", "tf", "doc_len"), "postings", "term")
    terms = put(Index(posts, posts).terms, "terms", "term")
    n_terms = terms.select("term").distinct().count()
    docs = put(index.docs.select(*KEYS, "doc_id", "url", "doc_len"), "docs", "doc_id")
    stats = put(Index(docs, posts).stats, "stats", "num_docs")
    n_docs = stats.agg(F.sum("num_docs")).first()[0] or 0
    if not n_docs or not n_terms:
        Files(spark).delete(path)
        n_docs = n_terms = 0
    return Reply(n_docs, n_terms, round((time.monotonic() - began) * 1000))


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.schema(s).parquet(f"{path}/{name}") for name, s in SCHEMAS.items()))


def dump(index: Index) -> DataFrame:
    """Every term with its postings, in order."""
    return index.postings.orderBy(*KEYS, "term", "doc_id")


def verify(index: Index) -> DataFrame:
    """(check, violations): what must hold of an index, and how often it doesn't."""
    posts, docs = index.postings, index.docs
    twice = posts.groupBy(*KEYS, "term", "doc_id").count().where("count > 1")
    lens = posts.groupBy(*KEYS, "doc_id").agg(F.sum("tf").alias("sum_tf"))
    joined = docs.join(lens, [*KEYS, "doc_id"], "left")
    counted = posts.groupBy(*KEYS, "term").agg(F.count("*").alias("n"))
    checks = [
        ("posting repeated", twice),
        ("frequency not positive", posts.where("tf IS NULL OR tf <= 0")),
        ("term empty", posts.where("term IS NULL OR term = ''")),
        ("record repeated", docs.groupBy(*KEYS, "doc_id").count().where("count > 1")),
        ("posting of no record", posts.join(docs, [*KEYS, "doc_id"], "left_anti")),
        ("length is not the sum of frequencies", joined.where("doc_len <> coalesce(sum_tf, 0)")),
        ("document frequency is not the number of postings", index.terms.join(counted, [*KEYS, "term"], "full").where("NOT doc_freq <=> n")),
    ]
    out = None
    for name, bad in checks:
        row = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = row if out is None else out.unionByName(row)
    return out
