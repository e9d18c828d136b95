"""The queries of the engine's own operators, and the SQL they are held against."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import hashing, scoring
from lodestack.functions import html as H
from lodestack.functions import text as T
from lodestack.functions import urls as U
from lodestack.functions.contents import undone
from lodestack.operators import crawl, mutation, spelling
from lodestack.operators import index as I
from lodestack.operators import search as S
from lodestack.operators.tables import built_once, session_dir, spread, written
from lodestack.plans.compaction import choose
from lodestack.plans.structured import structured
from lodestack.sources import docs as D
from lodestack.sources import warc
from lodestack.streaming.frontier import next_urls

_QUERY, _PATTERN = "frontier index", "^frost"
_STRUCTURED = """
\\/ lantern
\\/ /\\ honey
   /\\ \\/ oven
      \\/ ~ ^ladle
\\/ -- quay
   -- harbour
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a collection; the content is the text, a component holds the documents of a source."""
    return spread(_table(spark, sf_dir, "documents")).select(
        F.lit("documents").alias("collection"), F.coalesce("source", F.lit("none")).alias("component_id"), "doc_id", "url", F.col("text").alias("content")
    )


def _index(spark: SparkSession, sf_dir: str) -> I.Index:
    """The index of the documents, a component per source: written once, in the shared folder, and opened from then on."""
    path = built_once(spark, "documents-index", f"{sf_dir}/documents.parquet", lambda at: I.write(I.build(_docs(spark, sf_dir), stored=True), at))
    return I.open_index(spark, path)


def _whole(spark: SparkSession, sf_dir: str) -> I.Index:
    """The same index as one component."""
    return _index(spark, sf_dir).as_component("0")


def _files_index(spark: SparkSession, sf_dir: str) -> I.Index:
    """The index of the saved files, a collection of one component."""

    def build(at: str) -> None:
        files = spread(_table(spark, sf_dir, "content_metadata")).where("doc_uri IS NOT NULL").select(F.col("doc_uri").alias("url"), "content").distinct()
        I.write(I.build(files.withColumn("collection", F.lit("files")), stored=True), at)

    return I.open_index(spark, built_once(spark, "files-index", f"{sf_dir}/content_metadata.parquet", build))


def _dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted: the documents in Russian."""
    own = _table(spark, sf_dir, "documents").where("lang = 'ru'")
    return own.select(F.lit("documents").alias("collection"), F.lit("0").alias("component_id"), "doc_id")


def tokenize_terms(spark, d):
    return _docs(spark, d).select(F.explode(T.tokens(F.col("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def doc_lengths(spark, d):
    return _whole(spark, d).docs.select("doc_id", "doc_len")


def postings(spark, d):
    return _whole(spark, d).postings.select("term", "doc_id", "tf")


def term_dictionary(spark, d):
    return _index(spark, d).terms.select("component_id", "term", "doc_freq")


def corpus_stats(spark, d):
    return _index(spark, d).stats.select("component_id", "num_docs", "total_doc_len")


def index_reply(spark, d):
    """What building the index of all documents as one component replies, but for the time it took."""
    got = I.write(I.build(_docs(spark, d).withColumn("component_id", F.lit("0")), stored=True), f"{session_dir(spark)}/index-{uuid.uuid4().hex}")
    return spark.createDataFrame([got[:2]], "num_docs bigint, num_terms bigint")


def index_verify(spark, d):
    """A sound index has no violations; this one was broken for the records of some languages in ways each check finds."""
    index = _whole(spark, d)
    lang = _table(spark, d, "documents").select("doc_id", "lang")
    of = lambda df, x: df.join(lang.where(F.col("lang") == x).select("doc_id"), "doc_id", "left_semi").select(df.columns)
    but = lambda df, x: df.join(lang.where(F.col("lang") == x).select("doc_id"), "doc_id", "left_anti").select(df.columns)
    posts = index.postings
    empty = of(index.docs, "en").select(*I.KEYS, F.lit("").alias("term"), "doc_id", F.lit(1).alias("tf"), "doc_len")
    broken = but(posts, "de").unionByName(of(posts, "fr")).unionByName(of(posts, "de").withColumn("tf", F.lit(0))).unionByName(empty)
    docs = but(index.docs, "es").unionByName(of(index.docs, "ja"))
    return I.verify(index).withColumn("index", F.lit("sound")).unionByName(I.verify(I.Index(docs, broken, index.terms, index.stats)).withColumn("index", F.lit("broken")))


def index_dump(spark, d):
    return I.dump(_index(spark, d)).select("component_id", "term", "doc_id", "tf")


def _ranked(found):
    return found.select("component_id", "doc_id", "url", F.round("score", 6).alias("score"), "term_count")


def bm25_search(spark, d):
    return _ranked(S.bm25(_whole(spark, d), _QUERY))


def bm25_topk(spark, d):
    return S.scores(_whole(spark, d), _QUERY).orderBy(F.round("score", 6).desc(), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


def best_urls(spark, d):
    """The best 50 over all components by score, then the best of each url."""
    return S.best(_index(spark, d), "index", 50).select("url", F.round("score", 6).alias("score"))


def bm25_repeated_term(spark, d):
    return _ranked(S.bm25(_whole(spark, d), "frontier frontier"))


def bm25_floor_topk(spark, d):
    return S.component_top(S.bm25(_index(spark, d), "index"), 5).select("component_id", "doc_id", F.floor("score").alias("points"))


def multi_component_search(spark, d):
    return _ranked(S.bm25(_index(spark, d), _QUERY))


def global_stats_search(spark, d):
    return _ranked(S.bm25(_index(spark, d), _QUERY, global_stats=True))


def url_best(spark, d):
    return S.top(S.bm25(_index(spark, d), "index")).select("url", F.when(F.col("url").isNull(), F.col("doc_id")).alias("doc_id"), F.round("score", 6).alias("score"))


def search_with_tombstones(spark, d):
    return _ranked(S.bm25(_whole(spark, d), "index", _dead(spark, d)))


def search_after_deletion(spark, d):
    """What is left of a search once all urls of records in Russian are deleted, twice."""
    index = _index(spark, d)
    urls = _table(spark, d, "documents").where("lang = 'ru'").select("url")
    dead = mutation.delete_urls(index, urls, mutation.delete_urls(index, urls))
    return _ranked(S.bm25(index, "index", dead))


def scored_regex_exact_one(spark, d):
    return _ranked(S.bm25_pattern(_whole(spark, d), _PATTERN))


def unscored_all(spark, d):
    return S.all_terms(_whole(spark, d), _QUERY).select("doc_id", "url")


def unscored_regex(spark, d):
    return S.any_match(_whole(spark, d), "^(le|no)[a-z]*tu$").select("doc_id", "url")


def regex_term_scan(spark, d):
    return S.term_scan(_whole(spark, d), _PATTERN).select("term", "doc_freq")


def structured_and_or_sub(spark, d):
    return structured(_STRUCTURED, _whole(spark, d)).select("doc_id", "url")


def structured_components(spark, d):
    """The same over components: set operations on records of all of them."""
    return structured(_STRUCTURED, _index(spark, d)).select("component_id", "doc_id", "url")


def structured_collections(spark, d):
    """A query of two collections at once."""
    both = _index(spark, d).union(_files_index(spark, d))
    return structured("\\/ lantern\n\\/ -- ~ ^harb\n   -- quay", both).where("url IS NOT NULL").select("collection", "url").distinct()


def term_lookup(spark, d):
    return S.term_lookup(_index(spark, d), "frontier").select("component_id", "term", "doc_freq")


def doc_by_id(spark, d):
    least = _table(spark, d, "documents").agg(F.min("doc_id")).first()[0]
    return S.doc_by_id(_index(spark, d), least).select("component_id", "doc_id", "url", "doc_len")


def spelling_suggestions(spark, d):
    return spelling.suggestions(_whole(spark, d), "frontir Ladel quai", 2)


def spelling_grouped(spark, d):
    """Of the default distance, over all components, by distance."""
    found = spelling.grouped(spelling.suggestions(_index(spark, d), "frontir ladle Harbor"))
    return found.select("query_term", F.explode("suggestions").alias("dist", "terms")).select("query_term", "dist", F.array_join("terms", " ").alias("terms"))


def _status(spark, d, asked):
    index = _index(spark, d)
    dead = mutation.delete_urls(index, _table(spark, d, "documents").where("lang = 'ru'").select("url"))
    return mutation.status_histogram(index, asked.where("url IS NOT NULL").select("url"), dead).groupBy("status").agg(F.sum("components").alias("n"))


def doc_status(spark, d):
    """The urls of the records in Russian, which are deleted, and of those in Japanese, and all urls of the crawl: how
    often each state is met over urls and components."""
    own = _table(spark, d, "documents").where("lang IN ('ru', 'ja')").select("url")
    return _status(spark, d, own.unionByName(_table(spark, d, "input_docs").select("url")))


def doc_status_all(spark, d):
    """Which of all urls are in which state."""
    return _status(spark, d, _table(spark, d, "documents"))


def _halves(spark, d):
    """A component of some sources, and one of all documents whose doc_ids run the other way, so that they clash; with
    the tombstones of a's records in Russian and of b's in Japanese."""
    docs = _docs(spark, d).join(_table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    ends = _table(spark, d, "documents").agg(F.min("doc_id"), F.max("doc_id")).first()
    a = docs.where("component_id IN ('crawl', 'wiki', 'forum')").withColumn("component_id", F.lit("a"))
    b = docs.withColumn("component_id", F.lit("b")).withColumn("doc_id", F.lit(ends[0] + ends[1]) - F.col("doc_id"))
    dead = a.where("lang = 'ru'").unionByName(b.where("lang = 'ja'")).select(*I.KEYS, "doc_id")
    return I.build(a, stored=True), I.build(b, stored=True), dead


def merge_components(spark, d):
    a, b, dead = _halves(spark, d)
    m = mutation.merged(a, b, "documents", "m", dead)
    return m.postings.groupBy("term").agg(F.count("*").alias("doc_freq"), F.sum("tf").alias("occurrences"))


def merge_url_dedupe(spark, d):
    a, b, dead = _halves(spark, d)
    return mutation.merged(a, b, "documents", "m", dead).docs.select("url", "doc_len")


def merge_doc_ids(spark, d):
    """Every record of a merged component has an id of its own; those of a that b has too are new."""
    a, b, dead = _halves(spark, d)
    m = mutation.merged(a, b, "documents", "m", dead).docs
    old = _table(spark, d, "documents").select("doc_id", F.lit(1).alias("old"))
    return m.join(old, "doc_id", "left").agg(F.count("*").alias("records"), F.countDistinct("doc_id").alias("ids"), F.count_if(F.col("old").isNull()).alias("fresh"))


def merged_stats(spark, d):
    a, b, dead = _halves(spark, d)
    return mutation.merged(a, b, "documents", "m", dead).stats.select("component_id", "num_docs", "total_doc_len")


def collection_list(spark, d):
    docs = _table(spark, d, "components").select(F.col("collection_name").alias("collection"), "component_id", F.xxhash64("component_id").alias("doc_id"))
    return mutation.collections(I.Index(docs, docs)).select("collection", "components")


def fib_compaction_plan(spark, d):
    """The pair each collection of components would merge next."""
    pair = "struct<a:string,b:string>"

    @F.pandas_udf(pair)
    def plan(rows):
        import pandas as pd

        got = [choose([(int(r["n"]), r["id"]) for r in x]) for x in rows]
        return pd.DataFrame({"a": [g[0][1] if g else None for g in got], "b": [g[1][1] if g else None for g in got]})

    # components of a collection are few: compaction keeps their number logarithmic
    own = _table(spark, d, "components").groupBy("collection_name").agg(F.collect_list(F.struct(F.col("num_docs").alias("n"), F.col("component_id").alias("id"))).alias("parts"))
    return own.select("collection_name", plan("parts").alias("p")).select("collection_name", "p.a", "p.b")


def content_dedupe(spark, d):
    return crawl.unique_bodies(_table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "md5")


def url_hosts(spark, d):
    return _table(spark, d, "documents").select(U.host(F.col("url")).alias("host")).groupBy("host").agg(F.count("*").alias("n"))


def allowed_urls(spark, d):
    urls = _table(spark, d, "input_docs").select("url").distinct()
    return crawl.allowed(urls, [U.allowed_pattern("https://brackenfold.example"), U.allowed_pattern("https://www.zomufe.example")])


def host_schedule(spark, d):
    urls = _table(spark, d, "input_docs").select("url")
    return crawl.schedule(urls, "2024-01-01 00:00:00").select("host", "place", F.unix_micros("at").alias("at_micros")).groupBy("host").agg(F.max("place").alias("urls"), F.max("at_micros").alias("last_micros"))


def page_links(spark, d):
    pages = spread(_table(spark, d, "input_docs")).select("url", undone(F.col("content"), F.col("compression")).alias("html"))
    return crawl.page_links(pages).groupBy("page").agg(F.count("*").alias("n"))


def _made_pages(spark, d):
    """The documents as web pages: a head with a title and meta elements, links, and the text as it is."""
    docs = _table(spark, d, "documents").select("doc_id", "url", *(F.coalesce(c, F.lit("")).alias(c) for c in ("host", "source", "lang", "text")))
    made = (
        "<html><HEAD lang=x><title>\n{host} &amp; {source}</title><meta name=source content='{lang}'><meta content=\"{doc_id}\" name=\"id\"></head><body><title>no</title>"
        "<a href=\"/p/{doc_id}?a=1&amp;b=&#50;#f\">x</a><a data-href='no' class=y href=rel/{doc_id}>y</a>{text}</body></html>"
    )
    parts = [F.col(x[1:-1]) if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", made)]
    return docs.select("doc_id", "url", F.concat(*(p.cast("string") for p in parts)).alias("html"))


def document_links(spark, d):
    return crawl.page_links(_made_pages(spark, d).where("url IS NOT NULL")).select("page", "link")


def page_titles(spark, d):
    return _made_pages(spark, d).select("doc_id", H.title(F.col("html"), F.col("url")).alias("title"))


def page_meta(spark, d):
    return _made_pages(spark, d).select("doc_id", F.explode(H.meta_pairs(F.col("html"))).alias("name", "content"))


def result_display(spark, d):
    """Title and description of saved files, by their metadata."""
    rows = _table(spark, d, "content_metadata").select("doc_uri", F.col("metadata")["title"].alias("t"), F.col("metadata")["description"].alias("s")).distinct()
    meta = F.map_from_arrays(F.array(F.lit("uri"), F.lit("title"), F.lit("description")), F.array("doc_uri", "t", "s"))
    title, text, path = H.shown(meta)
    return rows.select(title.alias("title"), text.alias("description"), path.alias("path"))


def search_with_metadata(spark, d):
    index = _index(spark, d)
    docs = _docs(spark, d).where("url IS NOT NULL")
    meta = docs.groupBy(*I.KEYS, "url").agg(F.min_by("content", "doc_id").alias("content")).select(*I.KEYS, "url", H.metadata(F.col("content"), F.col("url")).alias("meta"))
    found = S.with_metadata(S.all_terms(index, "html").unionByName(S.all_terms(index, "title")).distinct(), meta)
    return found.select("doc_id", F.coalesce(F.col("meta")["title"], F.lit("Untitled")).alias("title"))


def cached_copy(spark, d):
    """The copy of the url that most records have, and of one that none has."""
    content = _docs(spark, d)
    most = content.where("url IS NOT NULL").groupBy("url").count().orderBy(F.col("count").desc(), F.col("url").desc()).first().url
    return S.cached_copy(content, most).unionByName(S.cached_copy(content, most + "/none"))


def doc_url_exists(spark, d):
    first = _docs(spark, d).agg(F.max("url")).first()[0]
    return S.docs_by_url(_whole(spark, d), first).select("doc_id", "url")


def num_docs(spark, d):
    return _whole(spark, d).stats.select("num_docs")


def url_escapes(spark, d):
    """Urls and texts on one line each, and back."""
    docs = _table(spark, d, "documents").where("text IS NOT NULL").withColumn("line", T.escaped(F.col("text")))
    return docs.select("doc_id", F.md5("line").alias("line"), (T.unescaped(F.col("line")) == F.col("text")).alias("same"))


def frontier_step(spark, d):
    """One step of a frontier in tables: blogs were asked just now, all other hosts are free."""
    waiting = _table(spark, d, "input_docs").select("url", U.host(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    hosts = waiting.select("host").distinct().select("host", F.when(F.col("host").startswith("blog."), 1_000_000).otherwise(0).cast("bigint").alias("free"))
    taken, left, kept = next_urls(waiting, hosts, 500_000)
    rows = taken.select(F.lit("taken").alias("what"), "host", "url", F.col("at").cast("bigint").alias("n"))
    return rows.unionByName(left.groupBy("host").agg(F.min("url").alias("url"), F.count("*").alias("n")).withColumn("what", F.lit("left"))).unionByName(kept.select(F.lit("host").alias("what"), "host", F.lit(None).cast("string").alias("url"), F.col("free").alias("n")))


def warc_round_trip(spark, d):
    """The documents written as WARC files, read back as records and made documents again."""
    at = f"{session_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(_docs(spark, d).select("url", "content"), at)
    good, _ = warc.to_docs(warc.read_warc(spark, at))
    return good.select("url", F.md5("content").alias("md5"))


def json_round_trip(spark, d):
    """The documents written as batches in JSON lines and read back."""
    at = f"{session_dir(spark)}/json-{uuid.uuid4().hex}"
    batch = F.struct(F.array(F.struct("url", "content")).alias("docs"))
    _docs(spark, d).select(F.to_json(batch).alias("value")).write.text(at)
    return D.json_batches(spark, at, lines=True).select("url", F.md5("content").alias("md5"))


def snapshot_fetch(spark, d):
    """The urls of the crawl, taken from the documents as a snapshot of pages."""
    urls = _table(spark, d, "input_docs").select("url").where("url IS NOT NULL").distinct()
    pages = _table(spark, d, "documents").where("url IS NOT NULL").groupBy("url").agg(F.min("text").alias("content"))
    urls = urls.unionByName(pages.select("url")).distinct()
    return D.from_snapshot(urls, pages).groupBy("error").agg(F.count("*").alias("n"), F.count("md5").alias("hashed"))


def file_cache(spark, d):
    rows = _table(spark, d, "content_metadata").select("doc_uri", "content", "written_at")
    return mutation.first_write_wins(None, rows, "doc_uri", "written_at").select("doc_uri", F.length("content").alias("n_chars"))


def file_cache_upsert(spark, d):
    """The web pages of the cache, then all files: what was there stays."""
    rows = _table(spark, d, "content_metadata").select("doc_uri", "content", "written_at")
    before = mutation.first_write_wins(None, rows.where("doc_uri LIKE '%.html'").withColumn("content", F.lit("kept")), "doc_uri", "written_at")
    return mutation.first_write_wins(before, rows, "doc_uri", "written_at").groupBy((F.col("content") == "kept").alias("kept")).agg(F.count("*").alias("n"))


def file_hashes(spark, d):
    return _table(spark, d, "content_metadata").where("content IS NOT NULL").select("doc_uri", hashing.file_hash(F.encode("content", "UTF-8")).alias("hash")).distinct()


def download_list(spark, d):
    paths = _table(spark, d, "content_metadata").select(F.col("doc_uri").alias("path")).distinct()
    have = paths.where("path LIKE '%.pdf'").select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return crawl.not_downloaded(paths, have).select("path", "command")


def wait_times(spark, d):
    e = _table(spark, d, "events")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return e.select("event_id", scoring.wait_micros(now, F.col("ts").cast("timestamp")).alias("wait"))


def collection_names(spark, d):
    c = _table(spark, d, "components").select("collection_name").distinct()
    return c.select("collection_name", T.valid_collection(F.col("collection_name")).alias("valid"))


_OWN = (
    tokenize_terms, doc_lengths, postings, term_dictionary, corpus_stats, index_reply, index_verify, index_dump, bm25_search, bm25_topk,
    best_urls, bm25_repeated_term, bm25_floor_topk, multi_component_search, global_stats_search, url_best, search_with_tombstones,
    search_after_deletion, scored_regex_exact_one, unscored_all, unscored_regex, regex_term_scan, structured_and_or_sub,
    structured_components, structured_collections, term_lookup, doc_by_id, spelling_suggestions, spelling_grouped, doc_status, doc_status_all,
    merge_components, merge_url_dedupe, merge_doc_ids, merged_stats, collection_list, fib_compaction_plan, content_dedupe, url_hosts,
    allowed_urls, host_schedule, page_links, document_links, page_titles, page_meta, result_display, search_with_metadata, cached_copy,
    doc_url_exists, num_docs, url_escapes, frontier_step, warc_round_trip, json_round_trip, snapshot_fetch,
    file_cache, file_cache_upsert, file_hashes, download_list, wait_times, collection_names,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OWN}


def _tokens(of: str) -> str:
    """SQL for the terms of a text: a run in camel case gives its parts and the whole."""
    cut = "string_split(regexp_replace(w, '(\\p{Ll})(\\p{Lu})', '\\1 \\2', 'g'), ' ')"
    return f"flatten(list_transform(regexp_extract_all(coalesce({of}, ''), '\\p{{L}}+|\\p{{N}}+'), lambda w: CASE WHEN len({cut}) > 1 THEN list_transform(list_append({cut}, w), lambda p: lower(p)) ELSE [lower(w)] END))"


_TOK = f"""tok AS (SELECT doc_id, url, coalesce(source, 'none') AS source, lang, list_concat({_tokens('url')}, {_tokens('text')}) AS tokens FROM documents),
docs AS (SELECT *, len(tokens) AS doc_len FROM tok),
posts AS (SELECT source, doc_id, term, count(*) AS tf FROM (SELECT source, doc_id, unnest(tokens) AS term FROM tok) GROUP BY ALL)"""


def _bm25(terms: list[str], component: str = "'0'", where: str = "true", stats: str | None = None) -> str:
    """SQL of a ranked search; repeated terms count again."""
    given = ", ".join(f"('{t}')" for t in terms)
    by = stats or component
    return f"""WITH {_TOK}, q AS (SELECT term, count(*) AS times FROM (VALUES {given}) v(term) GROUP BY term),
d AS (SELECT *, {component} AS component_id, {by} AS s FROM docs),
p AS (SELECT posts.*, d.component_id, d.s, d.url, d.doc_len, d.lang FROM posts JOIN d USING (doc_id) WHERE term IN (SELECT term FROM q)),
st AS (SELECT s, count(*) AS n, sum(doc_len) AS total FROM d GROUP BY s),
df AS (SELECT s, term, count(*) AS df FROM p GROUP BY ALL),
found AS (SELECT p.component_id, p.doc_id, any_value(p.url) AS url, CAST(sum(q.times) AS INT) AS term_count,
sum(q.times * ln((st.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * (p.tf * 2.2::DOUBLE) / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (p.doc_len / (st.total // st.n)::DOUBLE)))) AS score
FROM p JOIN q USING (term) JOIN df ON df.s = p.s AND df.term = p.term JOIN st ON st.s = p.s WHERE {where}
GROUP BY p.component_id, p.doc_id HAVING sum(q.times) = {len(terms)})"""


_RANKED = "SELECT component_id, doc_id, url, round(score, 6) AS score, term_count FROM found"
_HAS = "SELECT doc_id FROM posts WHERE term = '{}'"
_MERGED = f"""WITH {_TOK}, ends AS (SELECT min(doc_id) + max(doc_id) AS e FROM documents),
both_ AS (SELECT doc_id AS src, doc_id, url, doc_len, 0 AS side FROM docs WHERE source IN ('crawl', 'wiki', 'forum') AND coalesce(lang, '') <> 'ru'
UNION ALL SELECT doc_id AS src, e - doc_id AS doc_id, url, doc_len, 1 AS side FROM docs, ends WHERE coalesce(lang, '') <> 'ja'),
kept AS (SELECT * FROM both_ QUALIFY coalesce(url, '') = '' OR row_number() OVER (PARTITION BY url ORDER BY side, doc_id) = 1)"""
_GONE = "gone AS (SELECT DISTINCT url FROM documents WHERE lang = 'ru' AND url <> '')"
_STATUS = """held AS (SELECT url, coalesce(source, 'none') AS c FROM documents WHERE url IS NOT NULL GROUP BY ALL),
every AS (SELECT count(DISTINCT coalesce(source, 'none')) AS n FROM documents),
one AS (SELECT a.url, count(h.c) AS held, any_value(g.url) IS NOT NULL AS gone FROM asked a LEFT JOIN held h USING (url) LEFT JOIN gone g ON g.url = a.url GROUP BY a.url),
st AS (SELECT 'MISSING' AS status, every.n - held AS n FROM one, every UNION ALL SELECT CASE WHEN gone THEN 'DELETED' ELSE 'PRESENT' END, held FROM one)
SELECT status, CAST(sum(n) AS BIGINT) AS n FROM st GROUP BY status HAVING sum(n) > 0"""
_BROKEN = """p AS (SELECT posts.*, d.lang FROM posts JOIN docs d USING (doc_id)),
n AS (SELECT (SELECT count(*) FROM p WHERE lang = 'fr') AS twice, (SELECT count(*) FROM p WHERE lang = 'de') AS zero, (SELECT count(*) FROM docs WHERE lang = 'en') AS empty,
(SELECT count(*) FROM docs WHERE lang = 'ja') AS again, (SELECT count(*) FROM p WHERE lang = 'es') AS lost,
(SELECT count(*) FROM docs WHERE lang = 'en' OR lang IN ('fr', 'de') AND doc_len > 0) AS lens,
(SELECT count(DISTINCT term) FROM p WHERE lang = 'fr') + (SELECT least(1, count(*)) FROM docs WHERE lang = 'en') AS freqs)
SELECT unnest(['posting repeated', 'frequency not positive', 'term empty', 'record repeated', 'posting of no record', 'length is not the sum of frequencies', 'document frequency is not the number of postings']) AS "check",
unnest([twice, zero, empty, again, lost, lens, freqs]) AS violations, 'broken' AS index FROM n"""
_FIB = """RECURSIVE fib(a, b) AS (SELECT 1::BIGINT, 2::BIGINT UNION ALL SELECT b, a + b FROM fib WHERE b < 1000000000000000),
c AS (SELECT collection_name AS g, num_docs AS n, component_id AS id, num_docs IN (SELECT a FROM fib) AS ok FROM components),
big AS (SELECT g, max(n) AS n, max_by(id, (n, id)) AS id FROM c WHERE NOT ok GROUP BY g),
gap AS (SELECT g, n, id, (SELECT min(a) FROM fib WHERE a > big.n) - n AS gap FROM big),
filler AS (SELECT gap.g, min_by(c.id, c.id) AS a, any_value(gap.id) AS b FROM gap JOIN c ON c.g = gap.g AND c.id <> gap.id AND c.n = gap.gap GROUP BY gap.g),
rest AS (SELECT c.g, c.n, c.id, gap.gap, lead(c.n) OVER w AS n2, lead(c.id) OVER w AS id2, row_number() OVER w AS k FROM c LEFT JOIN gap ON gap.g = c.g WHERE gap.id IS NULL OR c.id <> gap.id WINDOW w AS (PARTITION BY c.g ORDER BY c.n, c.id)),
side AS (SELECT g, max_by(id, (n + n2, k)) AS a, max_by(id2, (n + n2, k)) AS b FROM rest WHERE gap IS NOT NULL AND n + n2 <= gap GROUP BY g),
whole AS (SELECT g, max_by(id, (n + n2, -k)) AS a, max_by(id2, (n + n2, -k)) AS b FROM rest WHERE gap IS NULL AND n + n2 IN (SELECT a FROM fib) GROUP BY g)
SELECT x.g AS collection_name, coalesce(f.a, s.a, w.a) AS a, coalesce(f.b, s.b, w.b) AS b FROM (SELECT DISTINCT g FROM c) x LEFT JOIN filler f USING (g) LEFT JOIN side s USING (g) LEFT JOIN whole w USING (g)"""
_HEAD = "regexp_extract({}, '(?is)<head\\b[^>]*>(.*?)(?:</head>|<body\\b|$)', 1)"
_TITLE = f"trim(regexp_extract({_HEAD}, '(?is)<title\\b[^>]*>(.*?)</title>', 1))"


_SETS = f"""WITH {_TOK}, hits AS (({_HAS.format('lantern')}) UNION (({_HAS.format('honey')}) INTERSECT (({_HAS.format('oven')}) UNION SELECT doc_id FROM posts WHERE regexp_matches(term, '^ladle')))
UNION (({_HAS.format('quay')}) EXCEPT ({_HAS.format('harbour')}))) """


def _near(words: list[str], distance: int) -> str:
    """Words have no characters beyond ASCII, so that any of a term is as far from theirs as a control is: so bytes may
    stand for characters."""
    given = ", ".join(f"('{w}')" for w in words)
    far = "levenshtein(q, regexp_replace(term, '[^ -~]', chr(1), 'g'))"
    return f"WITH {_TOK}, v AS (SELECT DISTINCT term FROM posts) SELECT q AS query_term, CAST({far} AS INT) AS dist, term AS suggestion FROM v, (VALUES {given}) a(q) WHERE {far} <= {distance}"


def oracle_sql() -> dict[str, str]:
    host = "lower(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), ''))"
    return {
        "tokenize_terms": f"SELECT term, count(*) AS n FROM (SELECT unnest({_tokens('text')}) AS term FROM documents) GROUP BY term",
        "doc_lengths": f"WITH {_TOK} SELECT doc_id, doc_len FROM docs",
        "postings": f"WITH {_TOK} SELECT term, doc_id, tf FROM posts",
        "term_dictionary": f"WITH {_TOK} SELECT source AS component_id, term, count(*) AS doc_freq FROM posts GROUP BY ALL",
        "corpus_stats": f"WITH {_TOK} SELECT source AS component_id, count(*) AS num_docs, CAST(sum(doc_len) AS BIGINT) AS total_doc_len FROM docs GROUP BY ALL",
        "index_reply": f"WITH {_TOK} SELECT (SELECT count(*) FROM docs) AS num_docs, (SELECT count(DISTINCT term) FROM posts) AS num_terms",
        "index_verify": f"WITH {_TOK}, " + _BROKEN + """ UNION ALL SELECT unnest(['posting repeated', 'frequency not positive', 'term empty', 'record repeated', 'posting of no record', 'length is not the sum of frequencies', 'document frequency is not the number of postings']), 0, 'sound'""",
        "index_dump": f"WITH {_TOK} SELECT source AS component_id, term, doc_id, tf FROM posts",
        "bm25_search": _bm25(["frontier", "index"]) + _RANKED,
        "bm25_topk": _bm25(["frontier", "index"]) + "SELECT doc_id, round(score, 6) AS score FROM found ORDER BY round(score, 6) DESC, doc_id LIMIT 10",
        "bm25_repeated_term": _bm25(["frontier", "frontier"]) + _RANKED,
        "bm25_floor_topk": _bm25(["index"], "source") + "SELECT component_id, doc_id, CAST(floor(score) AS BIGINT) AS points FROM found QUALIFY row_number() OVER (PARTITION BY component_id ORDER BY floor(score) DESC, doc_id) <= 5",
        "multi_component_search": _bm25(["frontier", "index"], "source") + _RANKED,
        "global_stats_search": _bm25(["frontier", "index"], "source", stats="'all'") + _RANKED,
        "url_best": _bm25(["index"], "source") + "SELECT url, CASE WHEN url IS NULL THEN doc_id END AS doc_id, round(max(score), 6) AS score FROM found GROUP BY ALL",
        "best_urls": _bm25(["index"], "source") + ", best AS (SELECT * FROM found ORDER BY score DESC, component_id, doc_id LIMIT 50) SELECT url, round(max(score), 6) AS score FROM best GROUP BY url, CASE WHEN url IS NULL THEN doc_id END",
        "search_after_deletion": _bm25(["index"], "source").replace("WITH ", f"WITH {_GONE}, ", 1) + _RANKED + " WHERE url IS NULL OR url NOT IN (SELECT url FROM gone)",
        "search_with_tombstones": _bm25(["index"], where="coalesce(p.lang, '') <> 'ru'") + _RANKED,
        "scored_regex_exact_one": _bm25(["index"]).split(", q AS")[0] + """, d AS (SELECT * FROM docs), p AS (SELECT * FROM posts WHERE regexp_matches(term, '^frost')),
st AS (SELECT count(*) AS n, sum(doc_len) AS total FROM d), df AS (SELECT term, count(*) AS df FROM p GROUP BY ALL)
SELECT '0' AS component_id, d.doc_id, any_value(d.url) AS url, CAST(1 AS INT) AS term_count,
round(sum(ln((st.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * (p.tf * 2.2::DOUBLE) / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (d.doc_len / (st.total // st.n)::DOUBLE)))), 6) AS score
FROM p JOIN d USING (doc_id) JOIN df USING (term), st GROUP BY d.doc_id HAVING count(*) = 1""",
        "unscored_all": f"WITH {_TOK} SELECT doc_id, url FROM docs WHERE doc_id IN ({_HAS.format('frontier')}) AND doc_id IN ({_HAS.format('index')})",
        "unscored_regex": f"WITH {_TOK} SELECT doc_id, url FROM docs WHERE doc_id IN (SELECT doc_id FROM posts WHERE regexp_matches(term, '^(le|no)[a-z]*tu$'))",
        "regex_term_scan": f"WITH {_TOK} SELECT term, count(*) AS doc_freq FROM posts WHERE regexp_matches(term, '^frost') GROUP BY term",
        "structured_and_or_sub": _SETS + "SELECT doc_id, url FROM docs WHERE doc_id IN (SELECT doc_id FROM hits)",
        "structured_components": _SETS + "SELECT source AS component_id, doc_id, url FROM docs WHERE doc_id IN (SELECT doc_id FROM hits)",
        "structured_collections": f"""WITH {_TOK}, all_ AS (SELECT 'documents' AS collection, url, tokens, doc_id AS k FROM tok UNION ALL SELECT 'files', doc_uri, list_concat({_tokens('doc_uri')}, {_tokens('content')}), row_number() OVER () FROM (SELECT DISTINCT doc_uri, content FROM content_metadata WHERE doc_uri IS NOT NULL))
SELECT DISTINCT collection, url FROM all_ WHERE url IS NOT NULL AND (list_contains(tokens, 'lantern') OR len(list_filter(tokens, lambda t: t LIKE 'harb%')) > 0 AND NOT list_contains(tokens, 'quay'))""",
        "term_lookup": f"WITH {_TOK} SELECT source AS component_id, term, count(*) AS doc_freq FROM posts WHERE term = 'frontier' GROUP BY ALL",
        "doc_by_id": f"WITH {_TOK} SELECT source AS component_id, doc_id, url, doc_len FROM docs WHERE doc_id = (SELECT min(doc_id) FROM documents)",
        "spelling_suggestions": _near(["frontir", "ladel", "quai"], 2),
        "spelling_grouped": f"SELECT query_term, dist, string_agg(suggestion, ' ' ORDER BY suggestion) AS terms FROM ({_near(['frontir', 'ladle', 'harbor'], 1)}) GROUP BY ALL",
        "doc_status": f"WITH {_GONE}, asked AS (SELECT url FROM documents WHERE url IS NOT NULL AND lang IN ('ru', 'ja') UNION SELECT url FROM input_docs WHERE url IS NOT NULL), {_STATUS}",
        "doc_status_all": f"WITH {_GONE}, asked AS (SELECT DISTINCT url FROM documents WHERE url IS NOT NULL), {_STATUS}",
        "merge_components": _MERGED + "SELECT term, count(*) AS doc_freq, CAST(sum(tf) AS BIGINT) AS occurrences FROM kept JOIN posts ON posts.doc_id = kept.src GROUP BY term",
        "merge_url_dedupe": _MERGED + "SELECT url, doc_len FROM kept",
        "merge_doc_ids": _MERGED + "SELECT count(*) AS records, count(*) AS ids, count(*) FILTER (side = 0 AND doc_id IN (SELECT doc_id FROM kept WHERE side = 1)) AS fresh FROM kept",
        "merged_stats": _MERGED + "SELECT 'm' AS component_id, count(*) AS num_docs, CAST(sum(doc_len) AS BIGINT) AS total_doc_len FROM kept",
        "collection_list": "SELECT collection_name AS collection, count(DISTINCT component_id) AS components FROM components GROUP BY ALL",
        "fib_compaction_plan": f"WITH {_FIB}",
        "content_dedupe": "SELECT min(doc_id) AS doc_id, md5(text) AS md5 FROM documents WHERE text IS NOT NULL GROUP BY md5(text)",
        "url_hosts": f"SELECT {host} AS host, count(*) AS n FROM documents GROUP BY ALL",
        "allowed_urls": "SELECT DISTINCT url FROM input_docs WHERE regexp_matches(url, '^https://(?:[^./?#]+\\.)?brackenfold\\.example') OR regexp_matches(url, '^https://(?:[^./?#]+\\.)zomufe\\.example')",
        "host_schedule": f"SELECT {host} AS host, count(DISTINCT url) AS urls, 1704067200000000 + (count(DISTINCT url) - 1) * 400000 AS last_micros FROM input_docs WHERE {host} IS NOT NULL GROUP BY ALL",
        "page_titles": "SELECT doc_id, trim(coalesce(host, '') || ' & ' || coalesce(source, '')) AS title FROM documents",
        "document_links": """WITH r AS (SELECT url AS page, '/p/' || doc_id || '?a=1&b=2' AS ref FROM documents UNION ALL SELECT url, 'rel/' || doc_id FROM documents
UNION ALL SELECT url, regexp_replace(unnest(regexp_extract_all(text, '(?s)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*"([^"]*)"', 1)), '#.*$', '') FROM documents),
f AS (SELECT page, ref, regexp_extract(page, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) AS origin, regexp_replace(regexp_extract(page, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/$', '') AS path FROM r WHERE page IS NOT NULL)
SELECT DISTINCT page, CASE WHEN regexp_matches(ref, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+') THEN ref WHEN ref LIKE '/%' THEN origin || ref ELSE origin || path || '/' || ref END AS link FROM f WHERE origin <> ''""",
        "page_meta": "SELECT doc_id, 'source' AS name, lang AS content FROM documents WHERE lang <> '' UNION ALL SELECT doc_id, 'id', CAST(doc_id AS VARCHAR) FROM documents",
        "result_display": "SELECT DISTINCT coalesce(metadata['title'], 'Untitled') AS title, coalesce(metadata['description'], 'No description') AS description, regexp_replace(doc_uri, '^.*//', '') AS path FROM content_metadata",
        "search_with_metadata": f"""WITH {_TOK}, first_ AS (SELECT coalesce(source, 'none') AS source, url, min_by(text, doc_id) AS text FROM documents WHERE url IS NOT NULL GROUP BY ALL)
SELECT d.doc_id, CASE WHEN {_TITLE.format('u.text')} <> '' THEN {_TITLE.format('u.text')} ELSE 'Untitled' END AS title FROM docs d LEFT JOIN first_ u ON u.source = d.source AND u.url = d.url WHERE d.doc_id IN ({_HAS.format('html')}) OR d.doc_id IN ({_HAS.format('title')})""",
        "cached_copy": """WITH most AS (SELECT url FROM documents WHERE url IS NOT NULL GROUP BY url ORDER BY count(*) DESC, url DESC LIMIT 1)
SELECT url, coalesce((SELECT text FROM documents d WHERE d.url = most.url ORDER BY coalesce(source, 'none'), text NULLS FIRST LIMIT 1), '{not found!}') AS content FROM most UNION ALL SELECT url || '/none', '{not found!}' FROM most""",
        "doc_url_exists": "SELECT doc_id, url FROM documents WHERE url = (SELECT max(url) FROM documents)",
        "num_docs": "SELECT count(*) AS num_docs FROM documents",
        "url_escapes": "SELECT doc_id, md5(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')) AS line, true AS same FROM documents WHERE text IS NOT NULL",
        "frontier_step": f"""WITH w AS (SELECT DISTINCT url, {host} AS host FROM input_docs WHERE {host} IS NOT NULL), h AS (SELECT host, min(url) AS url, count(*) AS n, host LIKE 'blog.%' AS busy FROM w GROUP BY host),
lefts AS (SELECT w.* FROM w JOIN h USING (host) WHERE h.busy OR w.url <> h.url)
SELECT 'taken' AS what, host, url, 500000 AS n FROM h WHERE NOT busy UNION ALL SELECT 'left', host, min(url), count(*) FROM lefts GROUP BY host
UNION ALL SELECT 'host', host, NULL, CASE WHEN busy THEN 1000000 ELSE 900000 END FROM h WHERE busy OR n > 1""",
        "warc_round_trip": "SELECT url, md5(coalesce(text, '')) AS md5 FROM documents WHERE url IS NOT NULL",
        "json_round_trip": "SELECT url, md5(text) AS md5 FROM documents",
        "snapshot_fetch": """WITH p AS (SELECT url, min(text) AS content FROM documents WHERE url IS NOT NULL GROUP BY url), u AS (SELECT url FROM input_docs WHERE url IS NOT NULL UNION SELECT url FROM p)
SELECT CASE WHEN content IS NULL THEN 'not in the snapshot' END AS error, count(*) AS n, count(content) AS hashed FROM u LEFT JOIN p USING (url) GROUP BY ALL""",
        "file_cache": "SELECT doc_uri, any_value(length(content)) AS n_chars FROM content_metadata WHERE doc_uri IS NOT NULL GROUP BY doc_uri",
        "file_cache_upsert": "SELECT k AS kept, count(*) AS n FROM (SELECT DISTINCT doc_uri, CASE WHEN doc_uri LIKE '%.html' THEN true WHEN content IS NULL THEN NULL ELSE false END AS k FROM content_metadata WHERE doc_uri IS NOT NULL) GROUP BY k",
        "download_list": "SELECT DISTINCT doc_uri AS path, 'wget -c ' || doc_uri AS command FROM content_metadata WHERE doc_uri NOT LIKE '%.pdf'",
        "wait_times": "SELECT event_id, CASE WHEN epoch_us(ts) > 1704067200000000 THEN epoch_us(ts) - 1704067200000000 END AS wait FROM events",
        "collection_names": "SELECT DISTINCT collection_name, regexp_full_match(collection_name, '[\\p{L}\\p{N}-]*') AS valid FROM components",
    }
