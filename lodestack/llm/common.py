"""What the operators of this subpackage share: tables, contents, working tables, code point arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.contents import decoded
from lodestack.operators.tables import shared_dir, spread, written

__all__ = ["decoded", "shared_dir", "written"]

#: Tables of which each row is much work.
TEXTS = ("input_docs", "content_metadata", "documents")
#: Characters that a worker lays out as one array at a time; bounds its memory whatever the batch.
CHUNK_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def decoded_all(contents: Iterable[str | None], compressions: Iterable[str | None]) -> list[str | None]:
    return [decoded(c, z) for c, z in zip(contents, compressions)]


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` characters together; a longer text is a range of its own."""
    at = total = 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > most:
            yield at, i
            at, total = i, 0
        total += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, one separator after each; begin and end of each text."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens + 1) - 1
    joined = "\n".join(texts) + "\n"
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), ends - lens, ends


class PointTable:
    """A property of code points, worked out by a rule when a point is first met."""

    def __init__(self, rule: Callable[[str], int]):
        self.rule, self.known = rule, np.full(0x110000, -1, np.int16)

    def of(self, points: np.ndarray) -> np.ndarray:
        got = self.known[points]
        if (got < 0).any():
            for p in np.unique(points[got < 0]).tolist():
                self.known[p] = self.rule(chr(p))
            got = self.known[points]
        return got


_alnum = PointTable(lambda c: c.isalnum())

#: Multiplier of the rolling hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _BASE_INV)):
            x = np.full(max(n, CHUNK_CHARS + 1), b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts (maximal runs of letters and digits), and the row of its text."""
    points, _, ends = laid_out(texts)
    inside = np.zeros(len(points) + 1, bool)
    inside[1:] = _alnum.of(points) == 1
    edge = inside[1:] != inside[:-1]
    at = np.flatnonzero(edge)  # the last point is a separator, so begins and ends come in pairs
    begin, end = at[0::2], at[1::2]
    power, inverse = _grown(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=total[1:])
    return mixed((total[end] - total[begin]) * inverse[begin]), np.searchsorted(ends, begin)


def shingles_of(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit hashes of the different runs of `size` words of each text, ascending; first index of each text's (one more
    at the end); number of words of each text."""
    h, row = words_of(texts)
    words = np.bincount(row, minlength=len(texts))
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64), words
    g = h[:n].copy()
    for k in range(1, size):
        g = mixed(g * np.uint64(3) + h[k : k + n])
    whole = row[:n] == row[size - 1 :]
    key = np.sort((row[:n][whole].astype(np.uint64) << np.uint64(32)) | (g[whole] >> np.uint64(32)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    of = (key >> np.uint64(32)).astype(np.int64)
    return key.astype(np.uint32), np.searchsorted(of, np.arange(len(texts) + 1)), words


def one_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key: the first by `order`; rows of equal order are taken to be the same."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("first")
    return df.groupBy(*keys).agg(first).select("first.*")
