"""The parts of a BM25 score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Saturation and length normalisation.
K1, B = 1.2, 0.75


def idf(n_docs: Column, doc_freq: Column) -> Column:
    """Can be negative: a term in more than half of the records counts against them."""
    return F.log((n_docs - doc_freq + F.lit(0.5)) / (doc_freq + F.lit(0.5)))


def saturation(tf: Column, doc_len: Column, average_len: Column) -> Column:
    """average_len is a whole number; at 0 (no terms at all) it counts as 1."""
    share = doc_len / F.greatest(average_len, F.lit(1))
    return tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * share))


def wait_micros(now: Column, allowed: Column) -> Column:
    """Microseconds until `allowed`, null if it has come."""
    left = F.unix_micros(allowed) - F.unix_micros(now)
    return F.when(left > 0, left)
