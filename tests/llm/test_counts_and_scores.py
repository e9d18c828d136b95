import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lodestack.llm import p1_terms as P1
from lodestack.llm import p2_distinctive as P2

SCHEMA = "doc_id bigint, term_frequencies map<string,int>, doc_len int, indexed_at timestamp, term string"


def table(spark, docs, extra=()):
    """Rows with a null or wrong doc_len and a column whose name clashes."""
    return spark.createDataFrame([(i, m, None, None, "clash") for i, m in docs] + list(extra), SCHEMA)


def random_docs(n, seed):
    rng = random.Random(seed)
    return [(i, {f"t{int(rng.paretovariate(0.7)) % 60}": rng.randint(1, 9) for _ in range(rng.randint(0, 12))}) for i in range(n)]


def counted(docs):
    occ, df = Counter(), Counter()
    for _, m in docs:
        for t, n in (m or {}).items():
            if n and n > 0:
                occ[t] += n
                df[t] += 1
    return {t: (occ[t], df[t]) for t in df}


def as_dict(counts):
    return {r.term: (r.occurrences, r.doc_freq) for r in counts.counts.collect()}


def test_counts_once_per_doc_and_marks(spark):
    docs = random_docs(40, 1) + [(100, None), (101, {}), (102, {"": 1, "odd": 0, "none": None})]
    rows = table(spark, docs + docs[:5], [(None, {"x": 1}, 1, None, "")])
    counts = P1.TermCounts.of(P1.one_per_doc(rows))
    assert as_dict(counts) == counted(docs) and counts.n_docs == 43
    marks = {r.term: r["mark"] for r in counts.marked().collect()}
    assert marks == {t: "rare" if df <= 2 else "common" if df >= 43 / 4 else None for t, (_, df) in counted(docs).items()}


def test_deltas_lead_to_the_same_counts(spark):
    old = random_docs(50, 2)
    new = [(i, {**m, "added": 2} if i % 7 == 0 else m) for i, m in old if i % 5] + [(900 + i, m) for i, m in random_docs(9, 3)]
    a, b = (P1.one_per_doc(table(spark, d)) for d in (old, new))
    updated = P1.TermCounts.of(a).updated(b, a)
    assert as_dict(updated) == counted(new) and updated.n_docs == len(new)
    assert P1.deltas(b, b).count() == 0
    gone = updated.updated(b.where("false"), b)
    assert as_dict(gone) == {} and gone.n_docs == 0


def test_only_touched_partitions_are_written(spark):
    old = random_docs(50, 2)
    a = P1.one_per_doc(table(spark, old))
    first = P1.TermCounts.of(a)
    second = first.updated(P1.one_per_doc(table(spark, [(777, {"t1": 1})])))
    moved = {p for p in second.parts if second.parts[p] != first.parts.get(p)}
    assert len(moved) == 1 and set(first.parts) - moved == set(second.parts) - moved
    assert as_dict(first) == counted(old) and as_dict(second) == counted(old + [(777, {"t1": 1})])


def test_later_rows_of_a_doc_count(spark):
    rows = spark.sql("SELECT 1L doc_id, map('a', 1) term_frequencies, timestamp'2024-01-01 00:00:00' indexed_at UNION ALL SELECT 1L, map('b', 2), timestamp'2024-01-02 00:00:00' UNION ALL SELECT 1L, map('c', 2), NULL")
    assert as_dict(P1.TermCounts.of(P1.one_per_doc(rows))) == {"b": (2, 1)}


def test_empty_tables(spark):
    empty = P1.one_per_doc(table(spark, []))
    assert P1.TermCounts.of(empty).marked().count() == 0 and P2.scores(empty).count() == 0


def test_scores_by_brute_force(spark):
    docs = random_docs(60, 4) + [(70, None), (71, {"only": 3})]
    got = {(r.doc_id, r.term): r for r in P2.scores(P1.one_per_doc(table(spark, docs + docs[:3])), min_doc_freq=3, mu=50.0).collect()}
    counts = counted(docs)
    total = sum(o for o, _ in counts.values())
    want = {}
    for i, m in docs:
        n = sum((m or {}).values())
        for t, tf in (m or {}).items():
            o, df = counts[t]
            if df >= 3:
                pd = (tf + 50.0 * o / total) / (n + 50.0)
                want[i, t] = pd * math.log2(pd / (o / total))
    assert got.keys() == want.keys() and all(abs(got[k].score - want[k]) < 1e-9 for k in want)
    scored = P2.scores(P1.one_per_doc(table(spark, docs)), min_tf=4)
    found = {(r.doc_id, r.term) for r in P2.distinctive(scored, times=2).collect()}
    share = lambda i, t, m: m[t] * total >= 2 * counts[t][0] * sum(m.values())
    assert found == {(i, t) for i, m in docs for t in m or {} if m[t] >= 4 and counts[t][1] >= 3 and share(i, t, m)}
    assert scored.where(F.col("tf") < 4).count() == 0
