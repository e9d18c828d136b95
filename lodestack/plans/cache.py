"""The file cache over a folder: what was extracted of files, and their hashes, kept once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.hashing import file_hash
from lodestack.operators import mutation as M
from lodestack.operators.tables import Files, written
from lodestack.sources.docs import extracted

_CONTENT = "doc_uri string, content string, metadata map<string,string>"
_HASH = "doc_uri string, hash int"


class FileCache:
    """Tables content_metadata and hash under root, in parts that are only added to. The first write of a file counts:
    parts are numbered as they come, and of two parts with the same file the earlier one is read."""

    def __init__(self, spark: SparkSession, root: str, extract: Callable | None = None):
        self.spark, self.root, self.extract_with = spark, root.rstrip("/"), extract
        self.files = Files(spark)

    def _table(self, name: str, schema: str) -> DataFrame:
        parts = [n for n in self.files.names(f"{self.root}/{name}") if n.startswith("part=")]
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema + ", part string").option("basePath", f"{self.root}/{name}").parquet(*(f"{self.root}/{name}/{p}" for p in parts))
        return rows.groupBy("doc_uri").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "part")), "part").alias("r")).select("r.*")

    def content(self) -> DataFrame:
        return self._table("content_metadata", _CONTENT)

    def hashes(self) -> DataFrame:
        return self._table("hash", _HASH)

    def extract(self, path: str) -> DataFrame:
        """(doc_uri, content, metadata) of files; nothing is kept."""
        return extracted(self.spark, path, self.extract_with)

    def check_file(self, uri: str) -> DataFrame:
        """(doc_uri, content, metadata, hash) of what is known of a file: no row of one that isn't there."""
        return self.content().where(F.col("doc_uri") == uri).join(self.hashes(), "doc_uri", "left")

    def ingest(self, path: str) -> DataFrame:
        """(doc_uri, cached, content) of files: extracts and keeps those that aren't there yet; a file that is there keeps
        what it has, and isn't read again."""
        names = self.spark.read.format("binaryFile").load(path).select("path")
        uri = F.when(F.col("path").startswith("file://"), F.col("path")).otherwise(F.regexp_replace("path", "^file:", "file://"))
        asked = written(names.select("path", uri.alias("doc_uri")), "asked-files")
        new = asked.join(self.content().select("doc_uri"), "doc_uri", "left_anti")
        paths = [r.path for r in new.select("path").collect()]  # names of files that one call asks for
        if paths:
            part = f"part={len(self.files.names(f'{self.root}/content_metadata')):09d}-{uuid.uuid4().hex}"
            rows = M.first_write_wins(None, extracted(self.spark, paths, self.extract_with))
            rows.write.parquet(f"{self.root}/content_metadata/{part}")
            files = self.spark.read.format("binaryFile").load(paths).select("path", "content")
            files.select(uri.alias("doc_uri"), file_hash(F.col("content")).alias("hash")).write.parquet(f"{self.root}/hash/{part}")
        fresh = new.select("doc_uri", F.lit(False).alias("cached"))
        got = asked.select("doc_uri").join(fresh, "doc_uri", "left").join(self.content(), "doc_uri")
        return got.select("doc_uri", F.coalesce("cached", F.lit(True)).alias("cached"), "content")

    def ingest_or_get(self, path: str) -> DataFrame:
        """(doc_uri, content) of files, extracted now or before."""
        return self.ingest(path).select("doc_uri", "content")

    def ingest_file(self, path: str) -> DataFrame:
        """(doc_uri, reply) of files: "already done" or the content that was extracted."""
        return self.ingest(path).select("doc_uri", F.when(F.col("cached"), "already done").otherwise(F.col("content")).alias("reply"))
