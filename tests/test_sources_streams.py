import gzip
import hashlib
import json
import struct
import subprocess
import time
import zipfile

import pytest

from lodestack.operators import crawl
from lodestack.operators import mutation as M
from lodestack.plans import crawler
from lodestack.plans.cache import FileCache
from lodestack.plans.engine import SearchEngine
from lodestack.sources import docs as D
from lodestack.sources import warc
from lodestack.streaming import frontier, ingest


def test_warc_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("http://a", "äb"), ("http://b", ""), ("http://c", None)], "url string, content string")
    warc.write_warc(rows.repartition(2), str(tmp_path / "w"))
    entries = warc.read_warc(spark, str(tmp_path / "w" / "*.warc"))
    good, bad = warc.to_docs(entries)
    assert {(r.url, r.content) for r in good.collect()} == {("http://a", "äb"), ("http://b", ""), ("http://c", "")} and bad.count() == 0
    plain = warc.recoded(entries, packed=False)
    assert {bytes(r.body) for r in plain.collect()} == {"äb".encode(), b""} and plain.where("compressed").count() == 0
    assert warc.recoded(plain, packed=True).where("compressed").count() == 3
    warc.register(spark)
    assert spark.read.format("warc").load(str(tmp_path / "w")).count() == 3
    assert warc.decompress({"Compression-Mode": "none"}, b"as it is")[1] == b"as it is"


def test_warc_errors_keep_what_was_read(spark, tmp_path):
    ok = warc.record_bytes({"WARC-Type": "response", "WARC-Target-URI": "u", "X-Own": "1"}, b"abc")
    other = warc.record_bytes({"WARC-Type": "request", "WARC-Target-URI": "v"}, b"abc")
    binary = warc.record_bytes({"WARC-Type": "response", "WARC-Target-URI": "w"}, b"\xff\xfe")
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(ok + other + binary + b"WARC/1.0\r\nno header\r\n\r\n"))
    entries = warc.read_warc(spark, str(tmp_path))
    assert entries.where("headers['X-Own'] = '1'").count() == 1 and entries.where("error IS NOT NULL").count() == 1
    good, bad = warc.to_docs(entries)
    assert [r.url for r in good.collect()] == ["u"] and bad.count() == 3
    assert warc.responses(entries).count() == 2


def test_document_sources(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"docs": [{"url": "u", "content": "c"}, {"url": "v", "content": None}]}))
    assert {(r.url, r.content) for r in D.json_batches(spark, str(tmp_path / "b.json")).collect()} == {("u", "c"), ("v", None)}
    (tmp_path / "urls.txt").write_text(" http://a \n\nhttp://b\n")
    lines = D.url_lines(spark, str(tmp_path / "urls.txt"))
    got = D.fetched(lines, lambda u: ("page", None) if u.endswith("a") else (None, "gone"))
    assert {(r.url, r.content, r.error) for r in got.collect()} == {("http://a", "page", None), ("http://b", None, "gone")}
    assert {r.md5 for r in got.collect()} == {hashlib.md5(b"page").hexdigest(), None}
    pages = spark.createDataFrame([("http://a", "p")], "url string, content string")
    assert D.from_snapshot(lines, pages).where("error IS NULL").count() == 1
    src = tmp_path / "repo"
    (src / "skipme").mkdir(parents=True)
    (src / "a.ts").write_text("ok")
    (src / "b.ts").write_bytes(b"\xff\xff")
    (src / "c.txt").write_text("no")
    (src / "skipme" / "d.ts").write_text("no")
    files = D.crawled_files(spark, str(src), "h", ("skipme",)).collect()
    assert [(r.url, r.content) for r in files] == [(f"file://h{src}/a.ts", "ok")]
    with pytest.raises(ValueError):
        D.git_files(spark, str(src))
    subprocess.run(f"cd {src} && git init -q && git add a.ts", shell=True, check=True)
    assert [r.content for r in D.git_files(spark, str(src)).collect()] == ["ok"]
    assert D.crawl_jobs('{"jobs": [{"seedUrls": ["u"], "maxPages": 3}]}') == [{"actions": [], "seedUrls": ["u"], "maxPages": 3}]
    sent = D.post_each(pages, lambda d: (_ for _ in ()).throw(OSError("down"))).collect()
    assert sent[0].error == "down"
    D.write_reports(sent and spark.createDataFrame(sent), str(tmp_path / "reports"))
    assert spark.read.json(str(tmp_path / "reports")).count() == 1


def test_crawl_follows_allowed_links_once(spark):
    site = {
        "http://a.example/": '<a href="x">x</a><a href="/y">y</a><a href="http://b.example/">b</a>',
        "http://a.example/x": '<a href="/">back</a><a href="/z">z</a>', "http://a.example/y": '<a href="/">back</a><a href="/z">z</a>',
        "http://a.example/z": "end",
    }
    acted = []
    pages, errors = crawler.run(spark, ["http://a.example/"], lambda u: (site[u], None) if u in site else (None, "gone"), actions=(lambda df: acted.append(df.count()),))
    assert sorted((r.url, r["round"]) for r in pages.collect()) == [("http://a.example/", 0), ("http://a.example/x", 1), ("http://a.example/z", 2)]
    assert acted == [1, 2, 1] and errors.count() == 0
    pages, errors = crawler.run(spark, ["http://a.example/", "http://a.example/none"], lambda u: (site.get(u), None if u in site else "gone"), max_pages=1)
    assert pages.count() == 1 and [r.error for r in errors.collect()] == ["gone"]


def test_extraction(spark, tmp_path):
    (tmp_path / "a.txt").write_text("text")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    got = {r.metadata["resourceName"]: r for r in D.extracted(spark, str(tmp_path)).collect()}
    assert got["a.txt"].content == "text" and got["a.txt"].metadata["Content-Type"] == "text/plain" and got["b.pdf"].content is None
    assert got["a.txt"].doc_uri == f"file://{tmp_path}/a.txt"


def test_crawl_operators(spark):
    urls = spark.createDataFrame([(f"http://h{i % 2}.example/{i}",) for i in range(6)] + [("nope",), (None,), ("http://h0.example/0",)], "url string")
    rows = crawl.schedule(urls, "2024-01-01 00:00:00", 0.4).collect()
    assert sorted((r.host, r.place) for r in rows) == [(f"h{h}.example", k) for h in range(2) for k in (1, 2, 3)]
    assert {r.place: r["at"].microsecond for r in rows} == {1: 0, 2: 400_000, 3: 800_000}
    pages = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", None)], "url string, content string")
    assert [r.url for r in crawl.unique_bodies(pages).collect()] == ["a"]
    assert crawl.allowed(urls, []).count() == 0
    left = crawl.not_downloaded(spark.createDataFrame([("p/a.gz",), ("p/b.gz",)], "path string"), spark.createDataFrame([("a.gz",)], "name string"))
    assert [r.command for r in left.collect()] == ["wget -c p/b.gz"]


def test_cache_keeps_the_first(spark):
    new = spark.createDataFrame([("u", "1"), ("u", "1"), ("v", "2"), (None, "3")], "doc_uri string, content string")
    cache = M.first_write_wins(None, new)
    assert sorted((r.doc_uri, r.content) for r in cache.collect()) == [("u", "1"), ("v", "2")]
    more = spark.createDataFrame([("u", "other"), ("w", "4")], "doc_uri string, content string")
    got = {(r.doc_uri, r.content, r.cached) for r in M.ingest_or_get(cache, more).collect()}
    assert got == {("u", "1", True), ("w", "4", False)}


def test_frontier_trace():
    f = frontier.Frontier(1.0)
    assert f.next(0.0) == ("done", None)
    assert f.submit(0.1, "host1", "1") and not f.submit(0.1, "host1", "1")
    assert f.next(0.1) == ("url", "1") and f.next(0.1) == ("done", None)
    f.submit(1.0, "host2", "2"), f.submit(1.0, "host2", "3")
    assert f.next(1.0) == ("url", "2") and f.next(1.1) == ("wait", 900_000) and f.next(2.0) == ("url", "3")


def _stream(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def _run(df, name, checkpoint, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    urls = _stream(spark, [("http://a.example/1#x",), ("http://a.example/1",), ("no",)], "url string", str(tmp_path / "u"))
    assert [r.url for r in _run(frontier.submitted(urls), "submitted", str(tmp_path / "c1")).collect()] == ["http://a.example/1"]
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = _stream(spark, [("a", f"u{i}", t) for i in range(3)] + [("b", "v", t)], "host string, url string, ts timestamp", str(tmp_path / "p"))
    got = _run(frontier.polite(rows, 1.0), "polite", str(tmp_path / "c2")).collect()
    assert sorted((r.host, (r["at"] - t).seconds) for r in got) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    pages = _stream(spark, [("u", "one word"), ("v", "two words")], "url string, content string", str(tmp_path / "d"))
    engine = SearchEngine(spark, str(tmp_path / "i"))
    ingest.indexed(pages, engine, "col", str(tmp_path / "c3")).awaitTermination(120)
    spark.createDataFrame([("w", "a third page")], pages.schema).write.mode("append").parquet(str(tmp_path / "d"))
    ingest.indexed(pages, engine, "col", str(tmp_path / "c3")).awaitTermination(120)
    # 2 and 1 were merged; content came along; a batch that is run again changes nothing
    assert [r.url for r in engine.unscored("col", "one").collect()] == ["u"] and [n for n, _ in engine.components("col")] == [3]
    assert engine.cached("col", "w") == "a third page"
    ingest.indexed(pages, engine, "col", str(tmp_path / "c4")).awaitTermination(120)
    assert engine.num_docs("col") == 3


def cbor(x):
    """A value in CBOR, by its definition."""
    head = lambda kind, n: bytes([kind << 5 | n]) if n < 24 else bytes([kind << 5 | 24, n]) if n < 256 else bytes([kind << 5 | 25]) + struct.pack(">H", n)
    if isinstance(x, str):
        return head(3, len(x.encode())) + x.encode()
    if isinstance(x, bytes):
        return head(2, len(x)) + x
    if isinstance(x, dict):
        return head(5, len(x)) + b"".join(cbor(k) + cbor(v) for k, v in x.items())
    if isinstance(x, list):
        return head(4, len(x)) + b"".join(map(cbor, x))
    return b"\xf6" if x is None else b"\xf5" if x is True else b"\xfb" + struct.pack(">d", x) if isinstance(x, float) else head(0, x) if x >= 0 else head(1, -1 - x)


def test_cbor_batches(spark, tmp_path):
    value = [{"a": [1, -5, 300, 1.5, None, True], "b": b"xy"}, "ä" * 300]
    assert D.read_cbor(cbor(value)) == value and D.read_cbor(b"\x9f\x01\x7f\x61a\x61b\xff\xff") == [1, "ab"] and D.read_cbor(b"\xc1\x05") == 5
    for bad in (b"", b"\x81", b"\x63ab", b"\x01\x01", b"\x19\x01"):
        with pytest.raises(ValueError):
            D.read_cbor(bad)
    (tmp_path / "a.cbor").write_bytes(cbor([{"url": "u", "content": "one word", "compression": "none"}, {"url": "v", "content": "x" * 400, "compression": "none"}]))
    (tmp_path / "b.cbor").write_bytes(cbor([["w", "third", "none"]]))
    assert {(r.url, r.compression) for r in D.cbor_batches(spark, str(tmp_path / "*.cbor")).collect()} == {("u", "none"), ("v", "none"), ("w", "none")}
    engine = SearchEngine(spark, str(tmp_path / "e"))
    assert engine.index_cbor("c", str(tmp_path / "*.cbor")).num_docs == 3 and [r.url for r in engine.unscored("c", "third").collect()] == ["w"]


def test_warc_sinks_and_posts(spark, tmp_path):
    rows = spark.createDataFrame([("http://a", "x"), ("http://b", "y")], "url string, content string")
    for _ in range(2):  # behind what is there
        warc.write_warc(rows, str(tmp_path / "w"), own_ids=True, packed=False)
    entries = warc.read_warc(spark, str(tmp_path / "w"))
    assert entries.count() == 4 and entries.where("compressed").count() == 0
    assert {r[0][:10] for r in entries.selectExpr("headers['WARC-Record-ID']").collect()} == {"<urn:uuid:"}
    out = tmp_path / "posted"
    out.mkdir()

    def post(d, out=str(out)):
        import os
        import uuid

        with open(os.path.join(out, uuid.uuid4().hex), "w") as f:
            json.dump(d, f)

    assert warc.posted(entries, post, size=10).where("error IS NULL").count() == 4
    assert sum(len(json.loads(p.read_text())["docs"]) for p in out.iterdir()) == 4


def test_texts_of_files(spark, tmp_path):
    (tmp_path / "p.html").write_text("<head><title>T &amp; U</title><meta name='k' content='v'><style>no</style></head><p>One<p>Two &lt;3")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<d xmlns='x'><p><t>First</t></p><p><t>Second</t></p></d>")
    with zipfile.ZipFile(tmp_path / "e.odt", "w") as z:
        z.writestr("content.xml", "<d><p>Kept</p><broken")
    (tmp_path / "x.zip").write_bytes(b"PK\x03\x04 no archive")
    got = {r.metadata["resourceName"]: r for r in D.extracted(spark, str(tmp_path)).collect()}
    assert got["p.html"].content == "One\nTwo <3" and got["p.html"].metadata["title"] == "T & U" and got["p.html"].metadata["k"] == "v"
    assert got["d.docx"].content == "First\nSecond" and got["e.odt"].content == "Kept" and got["x.zip"].content is None


def test_file_cache(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("first")
    cache = FileCache(spark, str(tmp_path / "cache"))
    uri = f"file://{tmp_path}/f/a.txt"
    assert cache.check_file(uri).count() == 0 and [r.content for r in cache.ingest_or_get(str(tmp_path / "f")).collect()] == ["first"]
    (tmp_path / "f" / "a.txt").write_text("second")
    (tmp_path / "f" / "b.txt").write_text("new")
    assert sorted(r.reply for r in cache.ingest_file(str(tmp_path / "f")).collect()) == ["already done", "new"]
    one = cache.check_file(uri).first()
    import xxhash

    assert one.content == "first" and one.hash & 0xFFFFFFFF == xxhash.xxh32_intdigest(b"first", 0xDEADBEEF)


def test_frontier_in_tables_by_its_trace(spark):
    waiting, hosts, seen = {}, {}, []
    f = frontier.Frontier(1.0)
    for now, urls in ((0, ["a/1", "a/2", "b/1"]), (500_000, ["a/3"]), (1_000_000, []), (1_200_000, ["c/1"]), (2_100_000, []), (9_000_000, [])):
        for u in urls:
            waiting[u] = u[0]
            f.submit(now / 1e6, u[0], u)
        w = spark.createDataFrame(list(waiting.items()), "url string, host string")
        taken, left, kept = frontier.next_urls(w, spark.createDataFrame(list(hosts.items()), "host string, free bigint"), now, 1.0)
        got = sorted(r.url for r in taken.collect())
        want = []
        while (x := f.next(now / 1e6))[0] == "url":
            want.append(x[1])
        assert got == sorted(want)
        waiting, hosts = {r.url: r.host for r in left.collect()}, {r.host: r.free for r in kept.collect()}
        seen += got
    assert sorted(seen) == ["a/1", "a/2", "a/3", "b/1", "c/1"] and not waiting and not hosts


def test_stream_holds_urls_back(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        urls = _stream(spark, [("a", f"u{i}") for i in range(3)] + [("b", "v")], "host string, url string", str(tmp_path / "h"))
        q = frontier.held(urls, 1.0).writeStream.format("memory").queryName("held").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
        end = time.time() + 90
        while time.time() < end and spark.table("held").count() < 4 and q.isActive:
            time.sleep(0.5)
        q.stop()
        rows = spark.table("held").collect()
        at = sorted(r["at"] for r in rows if r.host == "a")
        assert len(rows) == 4 and all(y - x >= 1000 for x, y in zip(at, at[1:]))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
