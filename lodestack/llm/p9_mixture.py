"""Problem 9: a mixture of sources of target shares of its tokens, by raked weights and order sampling."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .p1_terms import BROADCAST_IDS
from .p8_encode import encoded

#: Languages that count as such; all else is "other", so that the table that is raked stays small.
LANGUAGES = ("de", "en", "es", "fr", "ja", "ru")
#: Kinds of site, from the first label of the host; all else is "site".
TOPICS = ("blog", "docs", "forum", "mail", "news", "shop", "wiki", "www")
#: Rounds of raking; slices into which the sampling keys of a source are cut in each round of the search.
ROUNDS, SLICES = 200, 1024
#: Relative change of a factor below which raking has converged.
CONVERGED = 1e-6


def language(lang: Column) -> Column:
    tag = F.regexp_extract(F.lower(F.trim(lang)), "^[a-z]+", 0)
    return F.when(tag.isin(*LANGUAGES), tag).otherwise("other")


def topic(host: Column) -> Column:
    label = F.lower(F.split_part(host, F.lit("."), F.lit(1)))
    return F.when(label.isin(*TOPICS), label).otherwise("site")


def raked(cells: dict[tuple[str, str, str], float], shares: dict[str, float], repeats: dict[str, int], total: float) -> dict[tuple[str, str, str], float]:
    """How often the tokens of each cell (source, language, topic) occur in a mixture of `total` tokens.

    Iterative proportional fitting: the cells are scaled in turn to the marginals of topic and language, which keep the
    shares they have in the collection, and to those of source, which are the targets and come last. No factor exceeds
    its source's repeats; what the cap takes from a cell goes to the source's other cells.
    """
    factor = {c: 1.0 for c in cells}
    goals: list[tuple[int, dict[str, float]]] = []
    everything = sum(cells.values())
    for axis in (2, 1):
        own: dict[str, float] = defaultdict(float)
        for c, n in cells.items():
            own[c[axis]] += n
        goals.append((axis, {k: total * n / everything for k, n in own.items()}))
    goals.append((0, {s: total * share for s, share in shares.items()}))
    for _ in range(ROUNDS):
        moved = 0.0
        for axis, goal in goals:
            now: dict[str, float] = defaultdict(float)
            for c, n in cells.items():
                now[c[axis]] += n * factor[c]
            for c in cells:
                f = goal[c[axis]] / now[c[axis]] if now[c[axis]] > 0 else 0.0
                factor[c] *= f
                moved = max(moved, abs(f - 1)) if axis else moved
        if moved <= CONVERGED:  # the marginals of language and topic hold while those of source are met
            break
    for s in shares:
        own_cells = [c for c in cells if c[0] == s]
        for _ in range(ROUNDS):  # each pass fixes the cells at the cap and scales the others up
            over = [c for c in own_cells if factor[c] >= repeats[s]]
            for c in over:
                factor[c] = float(repeats[s])
            free = [c for c in own_cells if factor[c] < repeats[s]]
            want = total * shares[s] - sum(cells[c] * factor[c] for c in over)
            have = sum(cells[c] * factor[c] for c in free)
            if not free or have <= 0 or abs(want - have) <= 1e-9 * max(1.0, have):
                break
            for c in free:
                factor[c] *= max(0.0, want / have)
    return factor


def sized(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """(doc_id, source, language, topic, n_tokens) of each doc_id once, of the row of the least text. Ids are counted; only
    texts of ids that repeat are compared, all others go where they are to the tokenizer."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", "source", "lang", "host")
    again = written(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    least = lambda r: r.groupBy("doc_id").agg(F.min(F.struct("text", "source", "lang", "host")).alias("r")).select("doc_id", "r.*")
    if again.count() > BROADCAST_IDS:
        one = least(rows)
    else:
        again = F.broadcast(again)
        one = rows.join(again, "doc_id", "left_anti").unionByName(least(rows.join(again, "doc_id", "left_semi")))
    flat = one.select(F.struct("doc_id", "source", language(F.col("lang")).alias("language"), topic(F.col("host")).alias("topic")).alias("doc"), "text")
    counted = flat.withColumn("doc", F.to_json("doc", {"ignoreNullFields": "false"}))
    counted = encoded(counted, "text", tokenizer, folder, key="doc", counts_only=True)
    doc = F.from_json("doc", "doc_id bigint, source string, language string, topic string")
    return counted.select(doc.alias("d"), "n_tokens").select("d.*", "n_tokens")


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = "byte_bpe_50k", folder: str | None = None, seed: int = 9) -> DataFrame:
    """(doc_id, source, language, topic, n_tokens, copies): the records of the mixture and how often each occurs.

    Targets (source, target_share, max_repeats) are a small table; of a repeated source the greatest row counts, a null
    share is 0, null repeats are 1. total_tokens defaults to the largest size, up to that of the documents, at which
    every source reaches its share within its repeats. A record occurs floor(f) times, f its cell's raked factor, and
    once more if its sampling key is below its source's threshold: a key is u / (f - floor(f)), u a uniform hash of
    doc_id, so that records come in with probability about f - floor(f); the threshold is set where the source's tokens
    come nearest to its target. Records of no target source, without text or without tokens are left out. If a source
    has no tokens, its share can't be reached and the mixture is empty.
    """
    spark = docs.sparkSession
    # a row per source of the targets: small by definition, and checked
    rows = targets.where("source IS NOT NULL").groupBy("source").agg(
        F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("most"))).alias("t")
    ).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 target sources")
    scale = sum(r.t.share for r in rows) or 1.0
    shares = {r.source: r.t.share / scale for r in rows if r.t.share > 0}
    repeats = {r.source: max(1, r.t.most) for r in rows}
    sizes = written(sized(docs, tokenizer, folder).where(F.col("n_tokens") > 0), "sizes")
    wanted = sizes.where(F.col("source").isin(*shares)) if shares else sizes.where("false")
    cells = {
        (r.source, r.language, r.topic): float(r.n)
        for r in wanted.groupBy("source", "language", "topic").agg(F.sum("n_tokens").alias("n")).collect()
    }  # at most 10,000 sources x 7 languages x 9 topics
    own: dict[str, float] = defaultdict(float)
    for c, n in cells.items():
        own[c[0]] += n
    if not shares or any(own[s] <= 0 for s in shares):
        return wanted.where("false").select("doc_id", "source", "language", "topic", "n_tokens", F.lit(1).alias("copies"))
    feasible = min(own[s] * repeats[s] / share for s, share in shares.items())
    total = min(feasible, total_tokens if total_tokens is not None else sum(own.values()))
    factor = raked(cells, shares, repeats, total)
    table = spark.createDataFrame([(*c, f, repeats[c[0]]) for c, f in factor.items()], "source string, language string, topic string, f double, most int")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    part = wanted.join(F.broadcast(table), ["source", "language", "topic"])
    part = part.withColumn("whole", F.least(F.floor(F.col("f") + 1e-12), F.col("most")).cast("int"))
    frac = F.greatest(F.lit(0.0), F.col("f") - F.col("whole"))
    part = part.withColumn("key", F.when((F.col("whole") < F.col("most")), u / F.greatest(frac, F.lit(1e-9))))
    part = part.select("doc_id", "source", "language", "topic", "n_tokens", "whole", "key")
    fixed = {r.source: r.n for r in part.groupBy("source").agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("n")).collect()}
    limit = _thresholds(part, {s: total * share - fixed.get(s, 0) for s, share in shares.items()})
    bounds = spark.createDataFrame([(s, *b) for s, b in limit.items()], "source string, below double, tie bigint")
    # among equal keys (a doc_id has one row, so only by chance) the lesser doc_id comes first
    inside = (F.col("key") < F.col("below")) | ((F.col("key") == F.col("below")) & (F.col("doc_id") <= F.col("tie")))
    out = part.join(F.broadcast(bounds), "source").withColumn("copies", F.col("whole") + F.when(inside, 1).otherwise(0))
    return out.where("copies > 0").select("doc_id", "source", "language", "topic", "n_tokens", "copies")


def marginals(mixed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(axis, value, goal, reached) of the languages and topics of a mixture: their shares in all records of `sizes` (of
    mixed's columns), which are the goal, and in the mixture. Sources come first, and are capped, so they may differ."""
    out = None
    for axis in ("language", "topic"):
        share = lambda df, n, name: df.groupBy(F.col(axis).alias("value")).agg(F.sum(n).alias(name))  # noqa: B023, E731
        both = share(sizes, F.col("n_tokens"), "g").join(share(mixed, F.col("n_tokens") * F.col("copies"), "m"), "value", "left").na.fill(0, ["m"])
        sums = both.agg(F.sum("g").alias("gs"), F.sum("m").alias("ms"))
        row = both.join(F.broadcast(sums)).select(F.lit(axis).alias("axis"), "value", (F.col("g") / F.col("gs")).alias("goal"), F.when(F.col("ms") > 0, F.col("m") / F.col("ms")).otherwise(0.0).alias("reached"))
        out = row if out is None else out.unionByName(row)
    return out


def _thresholds(part: DataFrame, missing: dict[str, float]) -> dict[str, tuple[float, int]]:
    """For each source the key, and doc_id among equal keys, up to which the tokens come nearest to what is missing.

    Every round counts tokens in SLICES slices of each source's range in one pass and narrows it to the slice where the
    target lies; at most (sources x SLICES) numbers come to the driver. A range goes from its least key to its greatest,
    both inside, so that they fall into different slices. Keys outside are left out before they are cut into slices: in a
    narrow range they are further away than an integer counts.
    """
    spark = part.sparkSession
    ranges = {r.source: (0.0, r.hi, 0.0) for r in part.where("key IS NOT NULL").groupBy("source").agg(F.max("key").alias("hi")).collect()}
    done: dict[str, tuple[float, int]] = {s: (-1.0, -1) for s in missing}
    ranges = {s: r for s, r in ranges.items() if missing.get(s, 0) > 0}
    while ranges:
        rows = [(s, lo, hi) for s, (lo, hi, _) in ranges.items()]
        at = spark.createDataFrame(rows, "source string, lo double, hi double")
        slot = F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * SLICES)
        hist = part.join(F.broadcast(at), "source").where("key BETWEEN lo AND hi").withColumn("slot", F.least(slot, F.lit(SLICES - 1)))
        hist = hist.groupBy("source", "slot").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"), F.max("doc_id").alias("doc"))
        slots: dict[str, list] = defaultdict(list)
        for r in hist.collect():
            slots[r.source].append(r)
        following = {}
        for s, (_, _, sofar) in ranges.items():
            below = None
            for r in sorted(slots[s], key=lambda r: r.slot):
                if sofar + r.t > missing[s]:
                    if r.n == 1 or r.least == r.most:  # one record (or equal keys) lies across the target
                        take = sofar + r.t - missing[s] < missing[s] - sofar
                        below = (r.most, r.doc) if take else done[s]
                    else:
                        following[s] = (r.least, r.most, sofar)
                    break
                sofar += r.t
                done[s] = (r.most, r.doc)
            if below:
                done[s] = below
        ranges = following
    return {s: (b, 1 << 62) if b >= 0 else (-1.0, -1) for s, (b, _) in done.items()}


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, docs, most_copies) of each source of the targets, with zeros for a
    source the mixture doesn't hold."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("docs"), F.max("copies").alias("most_copies"))
    total = mixed.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("total"))
    goal = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"))
    out = goal.join(got, "source", "left").join(F.broadcast(total))
    n = F.coalesce("tokens", F.lit(0))
    share = F.when(F.col("total") > 0, n / F.col("total")).otherwise(0.0)
    return out.select("source", "target_share", share.alias("actual_share"), n.alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
