"""The engine over a folder: collections of components, as the services use it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import html as H
from lodestack.operators import index as I
from lodestack.operators import mutation as M
from lodestack.operators import search as S
from lodestack.operators import spelling
from lodestack.operators.tables import Files, written
from lodestack.plans.compaction import choose
from lodestack.plans.manifest import Busy, Manifest
from lodestack.plans.structured import structured
from lodestack.sources import docs as D
from lodestack.sources import warc

_CONTENT = "url string, content string, component_id string"
_META = "url string, meta map<string,string>, component_id string"
_TOMBSTONES = "doc_id bigint, component_id string"
_SCHEMAS = {name: s.replace(" collection string,", "") for name, s in I.SCHEMAS.items()} | {"content": _CONTENT, "metadata": _META, "tombstones": _TOMBSTONES}


class SearchEngine:
    """Tables under root, each with a folder per component: docs, postings, terms, stats, content, metadata, tombstones.

    The folder is a path every executor reaches, on any file system of Spark's. A component is never changed. Which
    components there are, and of which collection, is in the manifest: adding, merging, moving and dropping are one new
    version of it, so that a reader sees all of a change or nothing. Files of components that were retired go when others
    are; until then what was opened before stays readable.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest, self.files = Manifest(spark, self.root), Files(spark)

    # tables

    def _live(self, collection: str | list[str] | None = None) -> dict[str, dict]:
        names = [collection] if isinstance(collection, str) else collection
        state = self.manifest.read()[1]["components"]
        return {i: c for i, c in state.items() if names is None or c["collection"] in names}

    def _table(self, name: str, live: dict[str, dict]) -> DataFrame:
        """The rows of the components, with their collections. Only their folders are listed and read."""
        at = [f"{self.root}/{name}/component_id={i}" for i, c in live.items() if name != "tombstones" or c["deletes"]]
        schema = _SCHEMAS[name]
        df = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*at) if at else self.spark.createDataFrame([], schema)
        of = F.create_map(*(F.lit(x) for i, c in live.items() for x in (i, c["collection"]))) if live else None
        return df.withColumn("collection", F.lit(None).cast("string") if of is None else of[F.col("component_id")])

    def index(self, collection: str | list[str] | None = None) -> I.Index:
        live = self._live(collection)
        return I.Index(*(self._table(name, live) for name in I.SCHEMAS))

    def tombstones(self, collection: str | list[str] | None = None) -> DataFrame:
        return self._table("tombstones", self._live(collection)).select(*I.KEYS, "doc_id")

    def _metadata(self, collection) -> DataFrame:
        return self._table("metadata", self._live(collection))

    def _put(self, component: str, index: I.Index, content: DataFrame, metadata: DataFrame) -> I.Reply:
        """Writes a component's tables; nothing is visible before it is in the manifest."""
        part = f"{self.root}/_part/{component}"
        got = I.write(index, part)
        if got.num_docs:
            for name in I.SCHEMAS:
                # an index lies in collection=.../component_id=...; a store is keyed by component
                here = f"{part}/{name}/{next(n for n in self.files.names(f'{part}/{name}') if '=' in n)}/component_id={component}"
                self.files.place(here, f"{self.root}/{name}/component_id={component}")
            content.write.parquet(f"{self.root}/content/component_id={component}")
            metadata.write.parquet(f"{self.root}/metadata/component_id={component}")
        self.files.delete(part)
        return got

    def _vacuum(self, before: dict) -> None:
        """Deletes the files of the components that were already retired when the last change was made."""
        for i in before["retired"]:
            for name in _SCHEMAS:
                self.files.delete(f"{self.root}/{name}/component_id={i}")

    def _change(self, change: Callable[[dict], dict | None], retire: list[str] = ()) -> dict | None:
        before: dict = {}

        def apply(state: dict) -> dict | None:
            before.clear()
            before.update(retired=[i for i in state["retired"] if i not in retire])
            new = change(state)
            if new is not None and retire:
                new["retired"] = list(retire)
            return new

        got = self.manifest.commit(apply)
        if got is not None and retire:
            self._vacuum(before)
        return got

    # indexing

    def index_docs(self, collection: str, docs: DataFrame, compact: bool = True, component: str | None = None) -> tuple[int, int, int]:
        """Indexes (url, content) as one component and merges at most two components; gives the numbers of records and
        terms and the milliseconds it took. A component given by name is written once: asked for again, it is left."""
        if not all(c.isalnum() or c == "-" for c in collection):
            raise ValueError(f"not a collection name: {collection}")
        new = component or str(uuid.uuid4())
        state = self.manifest.read()[1]
        if new in state["components"] or new in state.get("known", []):
            return I.Reply(0, 0, 0)
        for name in _SCHEMAS:  # of a writer that broke off
            self.files.delete(f"{self.root}/{name}/component_id={new}")
        docs = docs.select("url", "content")
        own = docs.withColumn("collection", F.lit(collection)).withColumn("component_id", F.lit(new))
        got = self._put(new, I.build(own, stored=True), docs, docs.select("url", H.metadata(F.col("content"), F.col("url")).alias("meta")))
        if not got.num_docs:
            return got

        def add(s: dict) -> dict:
            s["components"][new] = {"collection": collection, "size": got.num_docs, "deletes": 0}
            if component:
                s["known"] = (s.get("known", []) + [component])[-100:]  # a stream repeats its last batch only
            return s

        self._change(add)
        if compact:
            self.compact(collection)
        return got

    def index_url_lines(self, collection: str, lines: str | DataFrame, fetch=None, snapshot: DataFrame | None = None, per_url: bool = False) -> dict[str, DataFrame]:
        """Fetches the urls of the lines (text, or a table of urls) and indexes what could be had; {"success": (url),
        "failure": (url, error)}. All pages become one component, or with per_url each one its own, as for a short list.
        With a snapshot (url, content), pages are taken from it."""
        urls = lines if isinstance(lines, DataFrame) else self.spark.createDataFrame([(x.strip(),) for x in lines.splitlines() if x.strip()], "url string")
        urls = urls.select(F.trim("url").alias("url")).where("url <> ''").distinct()
        good = F.col("url").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+")
        got = D.from_snapshot(urls.where(good), snapshot) if snapshot is not None else D.fetched(urls.where(good), fetch)
        bad = urls.where(~good).select("url", F.lit(None).cast("string").alias("content"), F.lit("not a url").alias("error"))
        got = written(got.select("url", "content", "error").unionByName(bad), "fetched-lines")
        whole = got.where("error IS NULL")
        if per_url:
            for r in whole.select("url").toLocalIterator():
                self.index_docs(collection, whole.where(F.col("url") == r.url))
        else:
            self.index_docs(collection, whole)
        return {"success": whole.select("url"), "failure": got.where("error IS NOT NULL").select("url", "error")}

    def index_local_files(self, collection: str, paths: list[str] | str) -> tuple[int, int, int]:
        return self.index_docs(collection, D.local_files(self.spark, paths))

    def index_git(self, collection: str, repository: str) -> tuple[int, int, int]:
        return self.index_docs(collection, D.git_files(self.spark, repository))

    def index_warc(self, collection: str, path: str) -> tuple[I.Reply, DataFrame]:
        """Indexes the responses of WARC files; the reply, and what was left out (path, url, reason)."""
        good, bad = warc.to_docs(warc.read_warc(self.spark, path))
        return self.index_docs(collection, good), bad

    def index_json(self, collection: str, path: str) -> tuple[int, int, int]:
        return self.index_docs(collection, D.json_batches(self.spark, path))

    def index_cbor(self, collection: str, path: str) -> tuple[int, int, int]:
        return self.index_docs(collection, D.cbor_batches(self.spark, path))

    # components

    def components(self, collection: str) -> list[tuple[int, str]]:
        """(size, id) of the components; their number is kept small by compaction."""
        return [(c["size"], i) for i, c in self._live(collection).items()]

    def compact(self, collection: str) -> bool:
        """Merges the two components that are chosen, if any. Both are locked meanwhile; a pair someone else works on is
        left to them. If records of the pair were deleted while it was merged, nothing is changed."""
        pair = choose(self.components(collection))
        if not pair:
            return False
        ids = [c for _, c in pair]
        try:
            held = self.manifest.lock(ids)
        except Busy:
            return False
        try:
            live = self._live()
            if any(i not in live for i in ids):
                return False
            own = [{i: live[i]} for i in ids]
            a, b = (I.Index(*(self._table(name, x) for name in I.SCHEMAS)) for x in own)
            new = str(uuid.uuid4())
            merged = M.merged(a, b, collection, new, self._table("tombstones", own[0] | own[1]))
            docs = written(merged.docs, "merged-docs")
            merged = I.Index(docs, merged.postings)
            kept = docs.select("url")
            content, meta = (M.first_of_each(*(self._table(name, x).drop(*I.KEYS) for x in own)).join(kept, "url", "left_semi") for name in ("content", "metadata"))
            got = self._put(new, merged, content, meta)

            def swap(s: dict) -> dict | None:
                now = s["components"]
                if any(now.get(i) != live[i] for i in ids):
                    return None
                to = now[ids[0]]["collection"]
                for i in ids:
                    del now[i]
                if got.num_docs:
                    now[new] = {"collection": to, "size": got.num_docs, "deletes": 0}
                return s

            if self._change(swap, retire=ids) is None:
                for name in _SCHEMAS:
                    self.files.delete(f"{self.root}/{name}/component_id={new}")
                return False
            return True
        finally:
            self.manifest.unlock(held)

    def merge_into(self, target: str, source: str) -> None:
        """Moves the components of a collection into another, one compaction after each."""
        for _, c in sorted(self.components(source)):

            def move(s: dict, c: str = c) -> dict | None:
                if c not in s["components"]:
                    return None
                s["components"][c]["collection"] = target
                return s

            self._change(move)
            self.compact(target)

    def collections(self) -> list[str]:
        return sorted({c["collection"] for c in self._live().values()})

    def collection_dir(self, collection: str) -> list[str]:
        """The folders of a collection's components."""
        return [f"{self.root}/docs/component_id={i}" for i in self._live(collection)]

    def delete_collection(self, collection: str) -> None:
        gone = list(self._live(collection))

        def drop(s: dict) -> dict:
            s["components"] = {i: c for i, c in s["components"].items() if i not in gone}
            return s

        if gone:
            self._change(drop, retire=gone)

    # queries

    def query(self, collection: str | list[str], q: str, n: int | None = None) -> DataFrame:
        """The best n by score and url, with metadata; urls and metadata are joined to what is left."""
        best = S.best(self.index(collection), q, n, self.tombstones(collection))
        return S.with_metadata(best, self._metadata(collection)).orderBy(F.col("score").desc(), "url")

    def unscored(self, collection: str | list[str], q: str, pattern: bool = False) -> DataFrame:
        find = S.any_match if pattern else S.all_terms
        return find(self.index(collection), q, self.tombstones(collection))

    def structured_query(self, collection: str | list[str], text: str) -> DataFrame:
        return structured(text, self.index(collection), self.tombstones(collection), self._metadata(collection))

    def spelling(self, collection: str, s: str, distance: int = 1) -> DataFrame:
        return spelling.suggestions(self.index(collection), s, distance)

    def term(self, collection: str, term: str) -> DataFrame:
        return S.term_lookup(self.index(collection), term)

    def doc(self, collection: str, doc_id: int) -> DataFrame:
        return S.doc_by_id(self.index(collection), doc_id)

    def doc_url_exists(self, collection: str, url: str) -> bool:
        return bool(S.docs_by_url(self.index(collection), url).head(1))

    def dump(self, collection: str) -> DataFrame:
        return I.dump(self.index(collection))

    def cached(self, collection: str, url: str) -> str:
        return S.cached_copy(self._table("content", self._live(collection)), url).first().content

    def num_docs(self, collection: str) -> int:
        return sum(n for n, _ in self.components(collection))

    def delete_doc(self, collection: str, url: str) -> None:
        self.delete_docs(collection, self.spark.createDataFrame([(url,)], "url string"))

    def delete_docs(self, collection: str, urls: DataFrame) -> None:
        """Marks the records of urls (url) as deleted. If a component was merged away meanwhile, it is done again."""
        for _ in range(20):
            live = self._live(collection)
            old = self._table("tombstones", live).select(*I.KEYS, "doc_id")
            index = I.Index(*(self._table(name, live) for name in ("docs", "postings")))
            new = written(M.delete_urls(index, urls).join(old, [*I.KEYS, "doc_id"], "left_anti").drop("collection"), "tombstones")
            touched = [r.component_id for r in new.select("component_id").distinct().collect()]  # components are few
            if not touched:
                return
            new.write.mode("append").partitionBy("component_id").parquet(f"{self.root}/tombstones")

            def count(s: dict, touched: list[str] = touched) -> dict | None:
                if any(i not in s["components"] for i in touched):
                    return None
                for i in touched:
                    s["components"][i]["deletes"] += 1
                return s

            if self._change(count) is not None:
                return
        raise Busy("the collection keeps changing")

    def is_doc_deleted(self, collection: str, url: str) -> dict[str, int]:
        asked = self.spark.createDataFrame([(url,)], "url string")
        rows = M.status_counts(M.status(self.index(collection), asked, self.tombstones(collection))).collect()  # three statuses
        return {r.status: r.components for r in rows}

    def diagnostics(self) -> str:
        live = self._live()
        return json.dumps({"components": {c: sum(x["collection"] == c for x in live.values()) for c in self.collections()}, "locked": self.manifest.locked()})

    def verify(self, collection: str) -> DataFrame:
        return I.verify(self.index(collection))
