"""Problem 7: near-duplicate contents by banded MinHash and odd sketches, with an exact check of the candidates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, decoded_all, shingles_of, written

#: MinHash values of a set; how many make up the key of a band and how many bands there are. At a similarity of 0.7 a
#: pair shares none of 20 bands of 3 with probability 2e-4, at 0.75 with 3e-5.
HASHES, ROWS, BANDS = 96, 3, 20
#: Sub-bands into which a band key held by more than HOT classes is split: pairs of the MinHash values that no band
#: uses. At 0.7 a pair shares none of them with probability 6e-6.
SUB_ROWS, SUB_BANDS, HOT = 2, 18, 500
#: Classes of one key, or records of one class, that one task pairs with the others.
SPLIT = 1000
#: Bits of an odd sketch. Candidates whose estimate lies so many standard deviations below the threshold are dropped, those
#: as far above it are taken; only what lies between is checked exactly.
SKETCH_BITS, SURE = 1024, 3.5
#: Up to so many classes, the list of candidates is broadcast (8 bytes each); beyond, it is joined by a shuffle.
BROADCAST_CLASSES = 1_000_000

_rng = np.random.default_rng(7)
_A = _rng.integers(1 << 62, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def min_hashes(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HASHES values of each non-empty set; `first` is where each set begins."""
    x, out = shingles.astype(np.uint64), np.empty((HASHES, len(first)), np.uint64)
    for k in range(HASHES):
        out[k] = np.minimum.reduceat((x * _A[k] + _B[k]) >> np.uint64(32), first)
    return out


def _keys(mins: np.ndarray, rows: int, bands: int, at: int, salt: int) -> np.ndarray:
    """The 64-bit key of each band, a row per set."""
    out = np.empty((mins.shape[1], bands), np.uint64)
    for b in range(bands):
        h = np.full(mins.shape[1], salt + b, np.uint64)
        for r in range(rows):
            h = (h ^ mins[at + b * rows + r]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, b] = h
    return out.view(np.int64)


def sketches(mins: np.ndarray) -> np.ndarray:
    """Odd sketches: each (position, MinHash value) flips one bit of its set's bitmap."""
    out = np.zeros((mins.shape[1], SKETCH_BITS), np.uint8)
    at = np.arange(mins.shape[1])
    for k in range(len(mins)):
        bit = ((mins[k] + np.uint64(k << 32)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 10)
        out[at, bit.astype(np.int64)] ^= 1
    return np.packbits(out, axis=1)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by the population count of the XOR of two odd sketches."""
    odd = np.bitwise_count(a ^ b).sum(axis=1).astype(float)
    inside = np.maximum(1 - 2 * odd / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS * np.log(inside) / (4 * HASHES)


_SETS = "input_id bigint, url string, ck1 bigint, ck2 bigint, n int, bands array<bigint>, sketch binary, shingles binary"


def shingle_sets(docs: DataFrame, size: int, min_words: int) -> DataFrame:
    """A row per content of enough words: its set of shingles, the class (ck1, ck2) of all contents of the same set,
    its band keys and its odd sketch."""
    schema = pa.schema([
        ("input_id", pa.int64()), ("url", pa.string()), ("ck1", pa.int64()), ("ck2", pa.int64()), ("n", pa.int32()),
        ("bands", pa.list_(pa.int64())), ("sketch", pa.binary()), ("shingles", pa.binary()),
    ])

    def run(batches):
        for batch in batches:
            ids, urls = batch["input_id"].to_pylist(), batch["url"].to_pylist()
            texts = [(t or "").lower() for t in decoded_all(batch["content"].to_pylist(), batch["compression"].to_pylist())]
            for lo, hi in chunks(texts):
                shingles, first, words = shingles_of(texts[lo:hi], size)
                n = np.diff(first)
                keep = np.flatnonzero((words >= min_words) & (n > 0))
                if not len(keep):
                    continue
                begins = first[:-1][n > 0]
                mins = min_hashes(shingles, begins)
                x = shingles.astype(np.uint64)
                spread = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                ck1 = np.add.reduceat(spread ^ (spread >> np.uint64(31)), begins)
                spread = (x + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
                ck2 = np.add.reduceat(spread ^ (spread >> np.uint64(29)), begins)
                bands, odd = _keys(mins, ROWS, BANDS, 0, 0), sketches(mins)
                at = np.cumsum(n > 0) - 1
                rows = at[keep]
                yield pa.record_batch([
                    pa.array([ids[lo + i] for i in keep.tolist()], pa.int64()), pa.array([urls[lo + i] for i in keep.tolist()], pa.string()),
                    pa.array(ck1[rows].view(np.int64)), pa.array(ck2[rows].view(np.int64)), pa.array(n[keep].astype(np.int32)),
                    pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * BANDS, pa.array(bands[rows].ravel())),
                    pa.array([odd[r].tobytes() for r in rows.tolist()], pa.binary()),
                    pa.array([shingles[first[i] : first[i + 1]].tobytes() for i in keep.tolist()], pa.binary()),
                ], schema=schema)

    return docs.select("input_id", "url", "content", "compression").where("input_id IS NOT NULL AND content IS NOT NULL").mapInArrow(run, _SETS)


def deviation(similarity: float) -> float:
    """Standard deviation of an estimate at a similarity: of the MinHash sample, and of bits that flip back."""
    flips = 2 * HASHES * (1 - similarity)
    decay = np.exp(-2 * flips / SKETCH_BITS)
    odd = SKETCH_BITS / 4 * (1 - decay**2) - flips * decay**2
    return float(np.sqrt(similarity * (1 - similarity) / HASHES + max(0.0, odd) / (2 * HASHES * decay) ** 2))


def _paired(rows: DataFrame, sizes: DataFrame, keys: list[str], left: list[str], right: list[str], by: str) -> DataFrame:
    """Joins rows with themselves on keys: left columns as a_, right ones as b_. A key of many rows (n in sizes) is split:
    the left rows by a hash of `by`, the right ones go to all splits, so that no task makes more than SPLIT x n pairs."""
    rows = rows.join(sizes.select(*keys, F.ceil(F.col("n") / SPLIT).cast("int").alias("splits")), keys)
    a = rows.select(*keys, F.pmod(F.xxhash64(by), F.col("splits")).cast("int").alias("split"), *(F.col(c).alias(f"a_{c}") for c in left))
    b = rows.select(*keys, F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), *(F.col(c).alias(f"b_{c}") for c in right))
    return a.join(b, [*keys, "split"])


def _bucket_pairs(keyed: DataFrame, hot: int | None, sets: DataFrame) -> DataFrame:
    """Pairs (a < b) of classes that share a key, from rows (key, ck1).

    One aggregation, combined before the shuffle, gives the key's row count and its least and greatest class; it settles
    keys of one class (however many copies) and of two rows. Only the rows of the other keys are gathered again, and
    their classes counted. Keys of more than `hot` classes are first split by sub-bands.
    """
    spread = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("ck1").alias("a"), F.max("ck1").alias("b")).where("a < b")
    spread = written(spread, "band-keys")
    pairs = spread.where("n = 2").select("a", "b")
    rows = written(keyed.join(spread.where("n > 2").select("key"), "key").distinct(), "band-rows")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    few = sizes.where(f"n <= {hot}") if hot else sizes
    pairs = pairs.unionByName(_paired(rows, few, ["key"], ["ck1"], ["ck1"], "ck1").where("a_ck1 < b_ck1").select(F.col("a_ck1").alias("a"), F.col("b_ck1").alias("b")))
    if hot and (many := sizes.where(f"n > {hot}").select("key")).head(1):
        crowded = rows.join(many, "key", "left_semi")
        split = sets.join(crowded.select("ck1").distinct(), "ck1", "left_semi").select("ck1", "shingles").dropDuplicates(["ck1"])
        sub = crowded.join(_sub_bands(split), "ck1").select(F.xxhash64("key", "sub").alias("key"), "ck1")
        pairs = pairs.unionByName(_bucket_pairs(sub, None, sets))
    return pairs


def _sub_bands(sets: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [np.frombuffer(s, np.uint32) for s in batch["shingles"].to_pylist()]
            first = np.concatenate(([0], np.cumsum([len(s) for s in own])[:-1])).astype(np.int64)
            keys = _keys(min_hashes(np.concatenate(own), first), SUB_ROWS, SUB_BANDS, ROWS * BANDS, 1 << 20)
            offs = np.arange(len(own) + 1, dtype=np.int32) * SUB_BANDS
            yield pa.record_batch([batch["ck1"], pa.ListArray.from_arrays(offs, pa.array(keys.ravel()))], names=["ck1", "subs"])

    return sets.mapInArrow(run, "ck1 bigint, subs array<bigint>").select("ck1", F.explode("subs").alias("sub"))


def _shares(pairs: DataFrame) -> DataFrame:
    """(a1, a2, b1, b2, similarity) by the shingle sets of both sides."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
                p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = np.concatenate((p, q))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                out.append(same / (len(both) - same))
            cols = [batch[c] for c in ("a1", "a2", "b1", "b2")]
            yield pa.record_batch([*cols, pa.array(out, pa.float64())], names=["a1", "a2", "b1", "b2", "similarity"])

    return pairs.select("a1", "a2", "b1", "b2", "x", "y").mapInArrow(run, "a1 bigint, a2 bigint, b1 bigint, b2 bigint, similarity double")


def _estimate(x: Column, y: Column) -> Column:
    """The estimate of two columns of sketches."""

    @F.pandas_udf("double")
    def run(x, y):
        import pandas as pd

        return pd.Series(estimated(*(np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (x, y))) if len(x) else [], dtype=float)

    return run(x, y)


class NearDuplicates:
    """The near-duplicate classes of contents (input_id, url, content, compression).

    Contents of the same set of shingles are one class, however many there are; links are between classes. Null
    contents and those of under `min_words` words are in no class. Repeated rows of an input_id count once.
    """

    def __init__(self, docs: DataFrame, threshold: float = 0.8, size: int = 5, min_words: int = 5):
        self.threshold = threshold
        self.sets = written(shingle_sets(docs, size, max(size, min_words)), "shingle-sets")
        keyed = self.sets.select(F.explode("bands").alias("key"), "ck1")
        self.candidates = written(_bucket_pairs(keyed, HOT, self.sets).distinct(), "candidates")
        self.links = written(self._links(), "links")

    def _links(self) -> DataFrame:
        """(a1, a2, b1, b2, similarity) of each pair of classes at least `threshold` similar, (a1, a2) < (b1, b2)."""
        ids = self.candidates.select(F.explode(F.array("a", "b")).alias("ck1")).distinct()
        many = ids.count()
        ids = F.broadcast(ids) if many <= BROADCAST_CLASSES else ids
        own = self.sets.join(ids, "ck1", "left_semi").select("ck1", "ck2", "n", "sketch", "shingles").dropDuplicates(["ck1", "ck2"])
        own = written(own, "candidate-sets")
        small = own.select("ck1", "ck2", "n", "sketch")
        l, r = (small.select(*(F.col(c).alias(f"{s}_{c}") for c in small.columns)) for s in "ab")
        pairs = self.candidates.join(l, F.col("a") == F.col("a_ck1")).join(r, F.col("b") == F.col("b_ck1"))
        size_ok = F.least("a_n", "b_n") >= F.lit(self.threshold - 1e-9) * F.greatest("a_n", "b_n")
        pairs = pairs.where(size_ok).select("a_ck1", "a_ck2", "b_ck1", "b_ck2", _estimate(F.col("a_sketch"), F.col("b_sketch")).alias("estimate"))
        t, far = self.threshold, SURE * deviation(self.threshold)
        pairs = written(pairs.where(F.col("estimate") >= t - far).selectExpr("a_ck1 AS a1", "a_ck2 AS a2", "b_ck1 AS b1", "b_ck2 AS b2", "estimate"), "estimates")
        sure = F.col("estimate") >= t + far
        x = own.selectExpr("ck1 AS a1", "ck2 AS a2", "shingles AS x")
        y = own.selectExpr("ck1 AS b1", "ck2 AS b2", "shingles AS y")
        checked = _shares(pairs.where(~sure).join(x, ["a1", "a2"]).join(y, ["b1", "b2"])).where(F.col("similarity") >= t)
        return checked.unionByName(pairs.where(sure).withColumnRenamed("estimate", "similarity"))

    def members(self) -> DataFrame:
        return self.sets.select("input_id", "url", "ck1", "ck2").distinct()

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: every two records of different urls whose classes are linked or the same. The records
        of a class are split over tasks where they are many."""
        m = self.members()
        sizes = written(m.groupBy("ck1", "ck2").agg(F.count("*").alias("n"), F.min("url").alias("u"), F.max("url").alias("v")), "class-sizes")
        parts = F.ceil(F.col("n") / SPLIT).cast("int")
        parted = m.join(sizes.select("ck1", "ck2", parts.alias("splits")), ["ck1", "ck2"]).withColumn("split", F.pmod(F.xxhash64("input_id"), F.col("splits")).cast("int"))
        linked = self.links.select("a1", "a2", "b1", "b2")
        for s in "ab":
            # of each link a row for each split of the class on one side
            of = sizes.select(F.col("ck1").alias(f"{s}1"), F.col("ck2").alias(f"{s}2"), F.explode(F.sequence(F.lit(0), parts - 1)).alias(f"{s}_split"))
            linked = linked.join(of, [f"{s}1", f"{s}2"])
        for s in "ab":
            own = parted.select(F.col("ck1").alias(f"{s}1"), F.col("ck2").alias(f"{s}2"), F.col("split").alias(f"{s}_split"), *(F.col(c).alias(f"{s}_{c}") for c in ("input_id", "url")))
            linked = linked.join(own, [f"{s}1", f"{s}2", f"{s}_split"])
        cols = ["input_id", "url"]
        same = _paired(m, sizes.where("u < v"), ["ck1", "ck2"], cols, cols, "input_id").where("a_input_id < b_input_id")
        cols = ["a_input_id", "a_url", "b_input_id", "b_url"]
        both = linked.select(*cols).unionByName(same.select(*cols)).where("NOT a_url <=> b_url AND a_input_id <> b_input_id")
        return both.select(F.least("a_input_id", "b_input_id").alias("id_a"), F.greatest("a_input_id", "b_input_id").alias("id_b")).distinct()

    def groups(self) -> DataFrame:
        """(input_id, group_id, links): a row per record in a class. group_id is the least input_id that can be reached
        over links; links, how many other classes the record's class is linked to."""
        m = self.members()
        rep = m.groupBy("ck1", "ck2").agg(F.min("input_id").alias("rep"))
        rep = written(rep, "representatives")
        l, r = rep.selectExpr("ck1 AS a1", "ck2 AS a2", "rep AS u"), rep.selectExpr("ck1 AS b1", "ck2 AS b2", "rep AS v")
        edges = written(self.links.join(l, ["a1", "a2"]).join(r, ["b1", "b2"]).select("u", "v"), "edges")
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        degree = both.groupBy(F.col("u").alias("rep")).agg(F.count("*").alias("links"))
        roots = _components(edges).withColumnRenamed("node", "rep")
        own = rep.join(degree, "rep", "left").join(roots, "rep", "left")
        own = own.select("ck1", "ck2", F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
        return m.join(own, ["ck1", "ck2"]).select("input_id", "group_id", "links").distinct()


def _components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that can be reached, for each node of an edge (u, v).

    Alternates large and small stars until the edges stand still: the rounds grow with the logarithm of the longest
    path, and every round is an aggregation and a join, whatever the size of a component.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.selectExpr("v AS u", "u AS v")) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        moved = both.join(low, "u")
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")) if large else moved.select(F.explode(F.array("v", "u")).alias("u"), F.col("low").alias("v"))
        return moved.where("u <> v").distinct()

    now, mark = edges.where("u <> v").distinct(), None
    while True:
        now = written(star(star(now, True), False), "stars")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen
