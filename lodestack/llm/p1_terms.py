"""Problem 1: how often every distinct term occurs, and in how many records, kept up by signed deltas."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.tables import Files, session_dir

from .common import written

#: A term of at most so many records is rare; one of at least this share of all records is common.
RARE, COMMON = 2, 0.25
#: Partitions of the persistent counts.
PARTS = 16
#: Ids up to which a list of them is broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000


def one_per_doc(docs: DataFrame) -> DataFrame:
    """Each doc_id once: (doc_id, term_frequencies).

    Of several rows of a doc_id the latest indexed_at counts, of those the greatest map by hash. A null doc_id is no
    record; a null map is a record without terms. Other columns are left behind, whatever their names. Only ids are
    counted for it; maps are compared, and move, of the ids that repeat, or all at once where more than BROADCAST_IDS do.
    """
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "term_frequencies", F.coalesce(F.unix_micros("indexed_at"), F.lit(-1 << 62)).alias("t"))
    again = written(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    age = F.struct("t", F.xxhash64(F.array_sort(F.map_entries("term_frequencies"))))
    best = lambda r: r.groupBy("doc_id").agg(F.max_by("term_frequencies", age).alias("term_frequencies"))
    if again.count() > BROADCAST_IDS:
        return best(rows)
    again = F.broadcast(again)
    return rows.join(again, "doc_id", "left_anti").select("doc_id", "term_frequencies").unionByName(best(rows.join(again, "doc_id", "left_semi")))


def postings(docs: DataFrame, *keep: str) -> DataFrame:
    """A row per term of a record: (doc_id, keep..., term, tf). A null or not positive frequency is no occurrence."""
    entry = F.explode("term_frequencies").alias("term", "tf")
    return docs.select("doc_id", *keep, entry).where("tf > 0")


def deltas(new: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Signed changes per term, (term, d_occ, d_docs), that lead from the records `old` to the records `new`.

    Both hold each doc_id once. Only records that were added, changed or deleted give rows, so that what is shuffled
    follows the change, not the collection.
    """
    if old is None:
        signed = postings(new.withColumn("sign", F.lit(1)), "sign")
    else:
        # marks of all records, maps of the changed ones only
        mark = F.xxhash64(F.map_entries("term_frequencies"))  # an equal map in another order only adds to 0
        n, o = new.select("doc_id", mark.alias("n")), old.select("doc_id", mark.alias("o"))
        changed = written(n.join(o, "doc_id", "full").where("NOT n <=> o").select("doc_id"), "changed-records")
        changed = F.broadcast(changed) if changed.count() <= BROADCAST_IDS else changed
        of = lambda df, sign: df.join(changed, "doc_id", "left_semi").withColumn("sign", F.lit(sign))
        signed = postings(of(new, 1).unionByName(of(old, -1)), "sign")
    return signed.groupBy("term").agg(
        F.sum(F.col("sign") * F.col("tf").cast("bigint")).alias("d_occ"), F.sum(F.col("sign").cast("bigint")).alias("d_docs")
    )


class TermCounts:
    """The persistent counts of a collection, (term, occurrences, doc_freq), in PARTS partitions by a hash of the term, and
    how many records they come from. A partition is a folder; a version says which folder of each partition counts."""

    def __init__(self, spark: SparkSession, parts: dict[int, str], n_docs: int):
        self.spark, self.parts, self.n_docs = spark, parts, n_docs

    @property
    def counts(self) -> DataFrame:
        return self._read(self.parts.values())

    def _read(self, paths) -> DataFrame:
        return self.spark.read.schema(_COUNTS).parquet(*paths) if paths else self.spark.createDataFrame([], _COUNTS)

    @classmethod
    def of(cls, docs: DataFrame) -> TermCounts:
        """The counts of a first load: a delta against nothing."""
        return cls(docs.sparkSession, {}, 0).updated(docs)

    def updated(self, new: DataFrame, old: DataFrame | None = None) -> TermCounts:
        """Merges the change from `old` to `new` (all records of each doc_id touched) into a new version. Only partitions
        with terms of the change are read and written; the others are those of this version.

        Terms whose record count falls to 0 leave the table.
        """
        part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int").alias("part")
        change = written(deltas(new, old).select("term", F.col("d_occ").alias("occurrences"), F.col("d_docs").alias("doc_freq")), "term-deltas")
        touched = [r.part for r in change.select(part).distinct().collect()]  # at most PARTS
        before = self._read([self.parts[p] for p in touched if p in self.parts])
        total = before.unionByName(change).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("doc_freq").alias("doc_freq")).where("doc_freq > 0")
        at = f"{session_dir(self.spark)}/term-counts-{uuid.uuid4().hex}"
        total.withColumn("part", part).repartition("part").write.option("compression", "zstd").partitionBy("part").parquet(at)
        there = {int(n.split("=")[1]) for n in Files(self.spark).names(at) if n.startswith("part=")}
        parts = {p: x for p, x in self.parts.items() if p not in touched} | {p: f"{at}/part={p}" for p in there}
        n = self.n_docs + new.count() - (old.count() if old is not None else 0)
        return TermCounts(self.spark, parts, n)

    def mark(self, rare: int = RARE, common: float = COMMON) -> Column:
        """`rare`, `common` or null. In a collection so small that a term is both, it is rare."""
        df = F.col("doc_freq")
        return F.when(df <= rare, "rare").when(df >= common * self.n_docs, "common")

    def marked(self) -> DataFrame:
        return self.counts.withColumn("mark", self.mark())


_COUNTS = "term string, occurrences bigint, doc_freq bigint"
