"""Terms of the dictionary within an edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import spelling_terms

from .index import Index


def suggestions(index: Index, query: str, distance: int = 1) -> DataFrame:
    """(query_term, dist, suggestion) over all components; distance 0 is the term itself. A query's words are few, and
    are held against each distinct term of the dictionary once: lengths first, then distances that stop at the limit.
    Lengths and distances are in characters."""
    words = sorted(set(spelling_terms(query)))
    sizes = sorted({n for w in words for n in range(len(w) - distance, len(w) + distance + 1)})
    terms = index.terms.where(F.col("n_chars").isin(sizes) if sizes else F.lit(False)).select("term").distinct()
    asked = F.explode(F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")).alias("query_term")
    near = terms.select("term", asked).where(F.abs(F.length("term") - F.length("query_term")) <= distance)
    found = near.withColumn("dist", F.levenshtein("query_term", "term", distance)).where("dist >= 0")
    return found.select("query_term", "dist", F.col("term").alias("suggestion"))


def grouped(found: DataFrame) -> DataFrame:
    """(query_term, suggestions: map of distance to terms)"""
    each = found.groupBy("query_term", "dist").agg(F.array_sort(F.collect_set("suggestion")).alias("terms"))
    return each.groupBy("query_term").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dist", "terms")))).alias("suggestions"))
