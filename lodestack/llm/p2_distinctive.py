"""Problem 2: how distinctive a term is of a record, as its part of a divergence of smoothed language models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .p1_terms import postings

#: Weight of the collection's distribution in a record's, in tokens. Terms of fewer records get no score.
MU, MIN_DOC_FREQ = 200.0, 3
#: A term of at least this share of all records is looked up in a broadcast table. Their number is at most
#: (terms of an average record) / HEAD, whatever the size of the collection.
HEAD = 0.01


def scores(docs: DataFrame, min_doc_freq: int = MIN_DOC_FREQ, mu: float = MU, min_tf: int = 1) -> DataFrame:
    """Each term of each record (doc_id once in docs) with its part of the relative entropy between the record's
    Dirichlet-smoothed distribution and the collection's.

    Gives (doc_id, term, tf, true_len, doc_freq, coll_freq, total_len, score). True length is the sum of the record's
    frequencies; doc_len is not read. Terms of fewer than min_doc_freq records and of frequency below min_tf give no
    row, the latter before anything is joined, but count in all statistics. Records without terms give no row.

    A term may hold any share of the rows: those of the head of the vocabulary are broadcast, the others are each in
    under HEAD of the records.
    """
    spark = docs.sparkSession
    length = F.expr("aggregate(map_values(term_frequencies), 0L, (a, x) -> a + IF(x > 0, CAST(x AS BIGINT), 0L))")
    docs = docs.select("doc_id", "term_frequencies", length.alias("true_len"))
    rows = postings(docs, "true_len")
    vocab = written(
        rows.groupBy("term").agg(F.count("*").alias("doc_freq"), F.sum(F.col("tf").cast("bigint")).alias("coll_freq")),
        "vocabulary",
    )
    n_docs = docs.count()
    total = vocab.agg(F.sum("coll_freq")).first()[0] or 0
    kept = vocab.where(F.col("doc_freq") >= min_doc_freq)
    is_head = F.col("doc_freq") >= max(1, HEAD * n_docs)
    head = kept.where(is_head)
    known = spark.createDataFrame([], "term string").limit(0) if n_docs == 0 else vocab.where(is_head).select("term")
    rows = rows.where(F.col("tf") >= min_tf)
    common = rows.join(F.broadcast(head), "term")
    others = rows.join(F.broadcast(known), "term", "left_anti").join(kept.where(~is_head), "term")
    p_coll = F.col("coll_freq") / F.lit(float(max(1, total)))
    p_doc = (F.col("tf") + F.lit(mu) * p_coll) / (F.col("true_len") + F.lit(mu))
    return common.unionByName(others).select(
        "doc_id", "term", "tf", "true_len", "doc_freq", "coll_freq",
        F.lit(total).cast("bigint").alias("total_len"), (p_doc * F.log2(p_doc / p_coll)).alias("score"),
    )


def distinctive(scored: DataFrame, min_tf: int = 4, min_doc_freq: int = 3, times: int = 20) -> DataFrame:
    """The scored terms whose share of the record is at least `times` their share of the collection: an exact condition,
    which a positive score follows from."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731 - products of counts outgrow 64 bits
    share = exact("tf") * exact("total_len") >= F.lit(times).cast("decimal(3,0)") * (exact("coll_freq") * exact("true_len")).cast("decimal(35,0)")
    return scored.where((F.col("score") > 0) & (F.col("tf") >= min_tf) & (F.col("doc_freq") >= min_doc_freq) & share)
