import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import index as I
from lodestack.operators import mutation as M
from lodestack.operators import search as S
from lodestack.operators import spelling
from lodestack.plans import structured as Q
from lodestack.plans.compaction import _fibonacci_up_to, choose
from lodestack.plans.engine import SearchEngine
from lodestack.plans.manifest import Busy

THREE = [("doc-1", "words in first doc"), ("doc-2", "words in second doc"), ("doc-3", "this is doc 3")]


def docs(spark, rows, component="c", **more):
    df = spark.createDataFrame(rows, "url string, content string").withColumn("component_id", F.lit(component))
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def hits(found):
    return sorted(r.url for r in found.collect())


def test_counts_with_terms_of_the_url(spark):
    index = I.build(docs(spark, [("https://example.com/test", "Hello world test document")]))
    assert index.docs.first().doc_len == 8
    assert {(r.term, r.tf) for r in index.postings.collect()} >= {("test", 2), ("https", 1)}
    assert {r.violations for r in I.verify(index).collect()} == {0}


def test_nulls_empty_and_clashing_columns(spark):
    rows = spark.createDataFrame([(None, None, 1), ("u", "", 2)], "url string, content string, term int")
    index = I.build(rows)
    assert sorted(r.doc_len for r in index.docs.collect()) == [0, 1]
    empty = I.build(rows.where("false"))
    assert empty.postings.count() == 0 and S.bm25(empty, "x").count() == 0 and S.bm25(index, "").count() == 0


def test_search_and_scores(spark):
    import math

    index = I.build(docs(spark, THREE))
    assert hits(S.bm25(index, "missing")) == [] and hits(S.bm25(index, "words")) == ["doc-1", "doc-2"]
    assert hits(S.all_terms(index, "words second")) == ["doc-2"] and hits(S.any_match(index, "^(fir|sec)")) == ["doc-1", "doc-2"]
    got = {r.url: r.score for r in S.bm25(index, "first").collect()}
    n, df, dl, avg = 3, 1, 6, 18 // 3
    want = math.log((n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avg))
    assert abs(got["doc-1"] - want) < 1e-9
    twice = {r.url: (r.score, r.term_count) for r in S.bm25(index, "first first").collect()}
    assert abs(twice["doc-1"][0] - 2 * want) < 1e-9 and twice["doc-1"][1] == 2
    assert S.top(S.bm25(index, "words"), 1).count() == 1
    assert hits(S.bm25_pattern(index, "^first$")) == ["doc-1"]


def test_deletion_status_and_merge(spark):
    a, b = I.build(docs(spark, THREE, "a")), I.build(docs(spark, [("doc-2", "second again"), ("doc-4", "fourth doc")], "b"))
    asked = spark.createDataFrame([("doc-2",), ("none",)], "url string")
    both = a.union(b)
    none = spark.createDataFrame([], M.TOMBSTONES)
    before = {(r.url, r.status): r.components for r in M.status_counts(M.status(both, asked, none)).collect()}
    assert before == {("doc-2", "PRESENT"): 2, ("none", "MISSING"): 2}
    dead = M.delete_urls(both, asked)
    dead = M.delete_urls(both, asked, dead)
    assert dead.count() == 2
    after = {(r.url, r.status): r.components for r in M.status_counts(M.status(both, asked, dead)).collect()}
    assert after == {("doc-2", "DELETED"): 2, ("none", "MISSING"): 2}
    m = M.merged(a, b, "default", "m", dead)
    assert hits(m.docs) == ["doc-1", "doc-3", "doc-4"] and hits(S.all_terms(m, "second")) == []
    m = M.merged(a, b, "default", "m")
    assert hits(m.docs) == ["doc-1", "doc-2", "doc-3", "doc-4"] and hits(S.all_terms(m, "again")) == []
    assert hits(M.merged(a, a, "default", "m").docs) == ["doc-1", "doc-2", "doc-3"]
    empty = I.Index(b.docs.where("false"), b.postings.where("false"))
    assert M.merged(a, empty, "default", "m").postings.count() == a.postings.count()


def test_doc_ids_that_clash(spark):
    one = lambda u, t, c: I.build(spark.createDataFrame([(u, t, 1, c)], "url string, content string, doc_id bigint, component_id string"))
    m = M.merged(one("http://one", "one", "a"), one("http://two", "two", "b"), "default", "m")
    assert hits(S.all_terms(m, "one")) == ["http://one"] and hits(S.all_terms(m, "two")) == ["http://two"]
    assert m.docs.select("doc_id").distinct().count() == 2


@pytest.mark.parametrize("words,query,distance,want", [
    ("one two three four five", "thr", 2, {(2, "three"), (2, "two")}), ("apple apricot banana", "appke", 1, {(1, "apple")}), ("café naïve résumé", "cafe", 1, {(1, "café")}),
])
def test_spelling(spark, words, query, distance, want):
    index = I.build(docs(spark, [("", words)]))
    found = spelling.suggestions(index, query, distance)
    assert {(r.dist, r.suggestion) for r in found.collect()} == want
    assert {d for d in spelling.grouped(found).first().suggestions} == {d for d, _ in want}


def test_parser():
    assert Q.parse("plain words") == Q.Text("plain words") and Q.parse("~ ^ab") == Q.Pattern("^ab")
    nested = Q.parse("\\/ a\n\\/ /\\ b\n   /\\ c\n\\/ -- d\n   -- ~ e")
    assert nested == Q.Clause("or", (Q.Text("a"), Q.Clause("and", (Q.Text("b"), Q.Text("c"))), Q.Clause("less", (Q.Text("d"), Q.Pattern("e")))))
    assert Q.parse("-- foo") == Q.Text("foo") and Q.parse("\\/ a\n\\/") == Q.Clause("or", (Q.Text("a"), Q.Text("")))
    with pytest.raises(Q.QueryError, match="mismatch"):
        Q.parse("\\/ a\n/\\ b")
    with pytest.raises(Q.QueryError, match="leftover"):
        Q.parse("a\nb")


def test_structured_is_set_algebra(spark):
    index = I.build(docs(spark, THREE))
    assert hits(Q.structured("-- doc\n-- ~ ^sec", index)) == ["doc-1", "doc-3"]
    assert hits(Q.structured("/\\ words\n/\\ \\/ first\n   \\/ third", index)) == ["doc-1"]
    assert hits(Q.structured("\\/ first\n\\/", index)) == ["doc-1"]


def test_compaction_reaches_fibonacci_sizes():
    fib = _fibonacci_up_to(10**6)
    rng = random.Random(1)
    for _ in range(60):
        parts = [(rng.randint(1, 10), f"p{i}") for i in range(rng.randint(0, 10))] + [(rng.randint(1, 200), "big")]
        for step in range(1000):
            if all(n in fib for n, _ in parts) and choose(parts) is None:
                break
            pair = choose(parts)
            if pair is None:
                parts.append((1, f"n{step}"))
                continue
            parts = [p for p in parts if p not in pair] + [(pair[0][0] + pair[1][0], f"m{step}")]
        assert all(n in fib for n, _ in parts)
    assert choose([]) is None and choose([(3, "a")]) is None and choose([(1, "a"), (2, "b")]) == ((1, "a"), (2, "b"))


def test_engine_over_a_folder(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path / "engine"))
    new = lambda *rows: spark.createDataFrame(rows, "url string, content string")
    assert e.index_docs("col", new(*THREE[:2]))[:2] == (2, 7)
    assert e.is_doc_deleted("col", "doc-1") == {"PRESENT": 1}
    e.delete_doc("col", "doc-1")
    e.delete_doc("col", "doc-1")
    assert e.is_doc_deleted("col", "doc-1") == {"DELETED": 1} and hits(e.query("col", "words", 10)) == ["doc-2"]
    e.index_docs("col", new(THREE[2]))  # 2 + 1 is a Fibonacci number: one component is left
    assert len(e.components("col")) == 1 and e.is_doc_deleted("col", "doc-1") == {"MISSING": 1}
    assert hits(e.structured_query("col", "\\/ second\n\\/ ~ ^3$")) == ["doc-2", "doc-3"]
    assert e.cached("col", "doc-2") == "words in second doc" and e.cached("col", "x") == "{not found!}"
    assert {r.suggestion for r in e.spelling("col", "word").collect()} == {"words"}
    assert e.index_docs("other", new(("doc-9", "nine words")))[:2] == (1, 4) and e.collections() == ["col", "other"]
    e.merge_into("col", "other")
    assert e.collections() == ["col"] and hits(e.query("col", "nine")) == ["doc-9"] and e.num_docs("col") == 3
    assert {r.violations for r in e.verify("col").collect()} == {0}
    assert e.index_docs("col", new(("", "")))[:2] == (0, 0)
    with pytest.raises(ValueError):
        e.index_docs("a b", new(*THREE))
    e.delete_collection("col")
    assert e.collections() == []


def test_status_of_many_urls(spark):
    n = 12_000
    docs = spark.range(n).select(F.lit("c").alias("collection"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("component_id"), F.col("id").alias("doc_id"), F.concat(F.lit("u"), F.col("id") % 9000).alias("url"), F.lit(1).alias("doc_len"))
    index, dead = I.Index(docs, docs), docs.where("doc_id % 2 = 0").select("collection", "component_id", "doc_id")
    asked = docs.select("url").unionByName(spark.range(2000).select(F.concat(F.lit("none"), "id").alias("url")))
    states = {}
    for i in range(n):
        states.setdefault((f"u{i % 9000}", "a" if i % 3 == 0 else "b"), []).append(i % 2 == 0)
    want = {}
    for url in [f"u{i}" for i in range(9000)] + [f"none{i}" for i in range(2000)]:
        for c in "ab":
            s = "MISSING" if (url, c) not in states else "DELETED" if all(states[url, c]) else "PRESENT"
            want[url, s] = want.get((url, s), 0) + 1
    for got in (M.status_counts(M.status(index, asked, dead)), M.status_histogram(index, asked, dead)):
        assert {(r.url, r.status): r.components for r in got.collect()} == want


def test_a_change_is_seen_whole(spark, tmp_path, monkeypatch):
    e = SearchEngine(spark, str(tmp_path / "engine"))
    new = lambda *rows: spark.createDataFrame(rows, "url string, content string")
    e.index_docs("col", new(*THREE[:1]), component="one")
    assert e.index_docs("col", new(*THREE[:1]), component="one") == (0, 0, 0) and e.num_docs("col") == 1
    e.index_docs("col", new(THREE[1]), compact=False)
    before = e.query("col", "words")
    # a merge that breaks off before the swap leaves two components and no record twice
    with monkeypatch.context() as m:
        m.setattr(e.manifest, "commit", lambda change: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            e.compact("col")
    assert len(e.components("col")) == 2 and hits(e.query("col", "words")) == ["doc-1", "doc-2"] and e.manifest.locked() == []
    # a pair that someone else merges is left alone; a record deleted meanwhile stays deleted
    held = e.manifest.lock([i for _, i in e.components("col")])
    with pytest.raises(Busy):
        e.manifest.lock(held[:1])
    assert not e.compact("col") and '"locked": ["' in e.diagnostics()
    e.manifest.unlock(held)
    real = e._put

    def meanwhile(*args):
        got = real(*args)
        e.delete_doc("col", "doc-2")
        return got

    with monkeypatch.context() as m:
        m.setattr(e, "_put", meanwhile)
        assert not e.compact("col")
    assert hits(e.query("col", "words")) == ["doc-1"] and len(e.components("col")) == 2
    assert e.compact("col") and len(e.components("col")) == 1 and hits(e.query("col", "words")) == ["doc-1"]
    assert hits(before) == ["doc-1", "doc-2"]  # what was opened before stays readable


def test_entries_of_the_engine(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path / "engine"))
    got = e.index_url_lines("col", " http://a/x \n\nno url\nhttp://b/y", fetch=lambda u: ("page of " + u[-1], None) if "a" in u else (None, "gone"))
    assert hits(got["success"]) == ["http://a/x"] and {r.url: r.error for r in got["failure"].collect()} == {"no url": "not a url", "http://b/y": "gone"}
    pages = spark.createDataFrame([("http://c", "snapshot words"), ("http://d", "more words")], "url string, content string")
    e.index_url_lines("each", pages.select("url"), snapshot=pages, per_url=True)
    assert hits(e.unscored("each", "words")) == ["http://c", "http://d"]
    (tmp_path / "f.txt").write_text("local words")
    e.index_local_files("col", str(tmp_path / "f.txt"))
    from lodestack.sources import warc

    warc.write_warc(pages, str(tmp_path / "w"), own_ids=True, packed=False)
    assert e.index_warc("warc", str(tmp_path / "w"))[0][:2] == (2, 6) and e.doc_url_exists("warc", "http://c") and not e.doc_url_exists("warc", "http://x")
    assert hits(e.unscored("warc", "^snap", pattern=True)) == ["http://c"] and e.term("warc", "words").first().doc_freq == 2
    one = e.dump("warc").where("term = 'more'").first()
    assert [r.url for r in e.doc("warc", one.doc_id).collect()] == ["http://d"] and len(e.collection_dir("warc")) == 1
    assert hits(e.query(["warc", "col"], "words")) == sorted([f"{tmp_path}/f.txt", "http://c", "http://d"])


def test_records_without_url_are_kept_apart(spark):
    rows = spark.createDataFrame([(None, "one word", 1), (None, "one word", 2), ("", "one word", 3), ("u", "one word", 4), ("u", "one", 5)], "url string, content string, doc_id bigint")
    index = I.build(rows)
    assert sorted(r.doc_id for r in S.top(S.bm25(index, "word")).collect()) == [1, 2, 3, 4]
    assert sorted(r.doc_id for r in S.best(index, "word", 3).collect()) in ([1, 2, 3], [1, 2, 4], [1, 3, 4], [2, 3, 4])
    assert M.delete_urls(index, spark.createDataFrame([("",), (None,)], "url string")).count() == 0
    assert sorted(r.doc_id for r in M.merged(index, index.where("false"), "c", "m").docs.collect()) in ([1, 2, 3, 4], [1, 2, 3, 5])


def test_written_index_answers_alike(spark, tmp_path):
    docs_ = docs(spark, THREE, "a").unionByName(docs(spark, [("doc-4", "words of a fourth doc")], "b"))
    built = I.build(docs_)
    assert I.write(built, str(tmp_path / "i"))[:2] == (4, 14)
    opened = I.open_index(spark, str(tmp_path / "i"))
    assert opened.dictionary is not None and {r.violations for r in I.verify(opened).collect()} == {0}
    rows = lambda df: sorted((r.component_id, r.url, round(r.score, 9)) for r in df.collect())
    for x, y in ((built, opened), (built.as_component("z"), opened.as_component("z")), (built.union(built.where("false")), opened.union(opened.where("false")))):
        assert rows(S.bm25(x, "words doc")) == rows(S.bm25(y, "words doc")) and rows(S.bm25(x, "doc", global_stats=True)) == rows(S.bm25(y, "doc", global_stats=True))
    plan = S.scores(opened, "words")._jdf.queryExecution().explainString(opened.docs._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(term,words)" in plan or "In(term" in plan
    assert "docs" not in "".join(x for x in plan.splitlines() if x.startswith("Location"))
    assert I.write(I.build(docs_.where("false")), str(tmp_path / "none"))[:2] == (0, 0)


def test_fresh_ids_are_free(spark):
    rows = lambda side, ids: I.build(spark.createDataFrame([(f"{side}{i}", f"text {side}", i) for i in ids], "url string, content string, doc_id bigint").withColumn("component_id", F.lit(side)))
    m = M.merged(rows("a", range(40)), rows("b", range(20, 60)), "default", "m")
    assert m.docs.count() == 80 and m.docs.select("doc_id").distinct().count() == 80 and {r.violations for r in I.verify(m).collect()} == {0}
