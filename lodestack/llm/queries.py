"""The queries of this subpackage, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import p1_terms, p10_personal, p2_distinctive, p3_lookalikes, p4_encoding, p5_stuffed, p6_body, p7_neardups, p8_encode, p9_mixture
from .common import table, written


def _counts(spark: SparkSession, sf_dir: str) -> p1_terms.TermCounts:
    """The counts of the nine tenths of the records that were indexed first, brought up to date by the delta of what was
    indexed since."""
    rows = table(spark, sf_dir, "indexed_docs")
    at = F.coalesce(F.unix_micros("indexed_at"), F.lit(-1 << 62))
    late = rows.agg(F.percentile_approx(at, 0.9)).first()[0]
    early = p1_terms.one_per_doc(rows.where(at <= (late or 0)))
    return p1_terms.TermCounts.of(early).updated(p1_terms.one_per_doc(rows), early)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).marked().where("mark IS NOT NULL").select("term", "mark")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).marked().select("term", "occurrences", "doc_freq", "mark")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = p1_terms.one_per_doc(table(spark, sf_dir, "indexed_docs"))
    scored = p2_distinctive.scores(docs, min_doc_freq=3, min_tf=4)
    return p2_distinctive.distinctive(scored).select("doc_id", "term")


def p2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = p1_terms.one_per_doc(table(spark, sf_dir, "indexed_docs"))
    return p2_distinctive.scores(docs).select("doc_id", "term", F.round("score", 6).alias("score"))


def _looks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, p3_lookalikes.Lookalikes]:
    docs = table(spark, sf_dir, "input_docs").select("input_id", "url", F.col("content").alias("text"), "compression")
    terms = table(spark, sf_dir, "terms").select("term_id", "component_id", F.col("term").alias("text"), F.lit(None).cast("string").alias("compression"))
    return docs, terms, p3_lookalikes.lookalikes(docs, terms)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, terms, looks = _looks(spark, sf_dir)
    of_terms = p3_lookalikes.same_look(p3_lookalikes.consistent(terms, looks, ["component_id", "term_id"]), "component_id", "term_id")
    prints = p3_lookalikes.consistent(docs.where("text <> ''"), looks, ["url", "input_id"], as_prints=True)
    of_docs = p3_lookalikes.same_look(prints, "url", "input_id")
    return of_terms.select(F.lit("terms").alias("tab"), "id_a", "id_b").unionByName(of_docs.select(F.lit("input_docs").alias("tab"), "id_a", "id_b"))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct term of the dictionaries and its consistent form."""
    _, terms, looks = _looks(spark, sf_dir)
    return p3_lookalikes.consistent(terms, looks, ["term_id"]).select("term_id", F.col("text").alias("term"), "form").distinct()


def p3_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of each record, its compression undone, in its consistent form."""
    docs, _, looks = _looks(spark, sf_dir)
    return p3_lookalikes.consistent(docs, looks, ["input_id"]).select("input_id", "form")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "input_docs")
    return p4_encoding.improbable(docs, p4_encoding.PairModel.of(docs)).select("input_id").distinct()


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "input_docs")
    return p4_encoding.improbable(docs, p4_encoding.PairModel.of(docs), restore=True).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_stuffed.scored(table(spark, sf_dir, "input_docs")).where("stuffed").select("input_id")


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_stuffed.scored(table(spark, sf_dir, "input_docs"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "input_docs").select(
        F.lit("input_docs").alias("tab"), F.col("input_id").cast("string").alias("rec_key"),
        F.lower(F.regexp_extract("url", "^[^:/]+://([^/:?#]+)", 1)).alias("host"), "content", "compression",
    )
    saved = table(spark, sf_dir, "content_metadata").select(
        F.lit("content_metadata").alias("tab"), F.col("doc_uri").alias("rec_key"), F.lit("").alias("host"), "content", F.lit(None).cast("string").alias("compression"),
    )
    return docs.unionByName(saved)


def _stuffed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_found(spark, sf_dir).select(F.lit("input_docs").alias("tab"), F.col("input_id").cast("string").alias("rec_key"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_body.frame_lines(_pages(spark, sf_dir)).join(_stuffed_keys(spark, sf_dir), ["tab", "rec_key"], "left_anti")


def p6_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_body.main_bodies(_pages(spark, sf_dir)).join(_stuffed_keys(spark, sf_dir), ["tab", "rec_key"], "left_anti")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_neardups.NearDuplicates(table(spark, sf_dir, "input_docs"), 0.7, 3, 20).pairs()


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_neardups.NearDuplicates(table(spark, sf_dir, "input_docs"), 0.7, 3, 20).groups()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_encode.encoded(table(spark, sf_dir, "documents")).select("doc_id", "ids")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_mixture.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of languages and topics in the mixture, beside those of all records of its sources."""
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    sizes = written(p9_mixture.sized(docs, "byte_bpe_50k").join(targets.select("source").distinct(), "source", "left_semi"), "sizes")
    return p9_mixture.marginals(p9_mix(spark, sf_dir), sizes)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_mixture.shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return p10_personal.personal(docs, p10_personal.Names.of(docs), clean=False).select("doc_id", F.inline("found")).distinct()


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    known = p10_personal.Names.of(docs)
    return p10_personal.personal(docs, known, terms=p10_personal.revealing(docs, known)).select("doc_id", "clean").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_counts, p2_found, p2_scores, p3_found, p3_forms, p3_contents, p4_found, p4_restored, p5_found, p5_scores, p6_found, p6_bodies, p7_found, p7_groups, p8_ids, p9_mix, p9_marginals, p9_shares, p10_found, p10_clean)
    return {f.__name__: f for f in own}


_ONE = """one AS (SELECT doc_id, any_value(term_frequencies) AS tfs FROM indexed_docs WHERE doc_id IS NOT NULL GROUP BY doc_id),
posts AS (SELECT doc_id, e.key AS term, e.value AS tf FROM (SELECT doc_id, unnest(map_entries(tfs)) AS e FROM one) WHERE e.value > 0),
counts AS (SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS doc_freq FROM posts GROUP BY term),
lens AS (SELECT doc_id, sum(tf) AS len FROM posts GROUP BY doc_id),
alls AS (SELECT count(*) AS n FROM one),
total AS (SELECT sum(tf) AS c FROM posts)"""

_MARK = "CASE WHEN doc_freq <= 2 THEN 'rare' WHEN doc_freq >= 0.25 * n THEN 'common' END"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_ONE} SELECT term, {_MARK} AS mark FROM counts, alls WHERE doc_freq <= 2 OR doc_freq >= 0.25 * n",
        "p1_counts": f"WITH {_ONE} SELECT term, occurrences, doc_freq, {_MARK} AS mark FROM counts, alls",
        "p2_found": f"""WITH {_ONE} SELECT p.doc_id, p.term FROM posts p JOIN counts k USING (term) JOIN lens l ON l.doc_id = p.doc_id, total
WHERE p.tf >= 4 AND k.doc_freq >= 3 AND p.tf * total.c >= 20 * k.occurrences * l.len""",
        "p2_scores": f"""WITH {_ONE}, x AS (SELECT p.doc_id, p.term, k.occurrences / total.c AS pc,
(p.tf + 200.0::DOUBLE * (k.occurrences / total.c)) / (l.len + 200.0::DOUBLE) AS pd
FROM posts p JOIN counts k USING (term) JOIN lens l ON l.doc_id = p.doc_id, total WHERE k.doc_freq >= 3)
SELECT doc_id, term, round(pd * log2(pd / pc), 6) AS score FROM x""",
    }
