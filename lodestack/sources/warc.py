"""WARC 1.0 files: record parser and writer, a data source, records to documents."""

from __future__ import annotations

import fnmatch
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The line ends, and the headers that say how a body is kept.
END = b"\r\n"
COMPRESSION, LENGTH, PLAIN_LENGTH = "Compression-Mode", "Content-Length", "Uncompressed-Content-Length"
PACKED, NOT_PACKED = "contentonly", "none"
#: Records that are handed on together.
BATCH = 128

SCHEMA = "path string, version string, headers map<string,string>, body binary, compressed boolean, error string"


class WarcError(ValueError):
    pass


def records(stream: io.BufferedIOBase) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(version, headers, body) of each record: a version line, at least one header line with a value, a blank line, a body
    of Content-Length bytes, two line ends. Headers keep their order; of one given twice the last counts."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/") or not line.endswith(END):
            raise WarcError(f"no version line: {line[:40]!r}")
        version, headers = line[5:].strip().decode("ascii"), {}
        while (line := stream.readline()) not in (END, b""):
            name, sep, value = line.rstrip(b"\r\n").partition(b":")
            if not sep or not name or not value.strip():
                raise WarcError(f"no header: {line[:40]!r}")
            headers[name.decode("utf-8")] = value.strip().decode("utf-8")
        if not headers:
            raise WarcError("a record without headers")
        try:
            n = int(headers[LENGTH])
        except (KeyError, ValueError) as e:
            raise WarcError("a record without length") from e
        body = stream.read(n)
        if len(body) < n or stream.read(4) != END + END:
            raise WarcError("a body cut short")
        yield version, headers, body


def record_bytes(headers: dict[str, str], body: bytes, version: str = "1.0") -> bytes:
    own = {**headers, LENGTH: str(len(body))}
    lines = [f"WARC/{version}".encode(), *(f"{k}: {v}".encode() for k, v in own.items())]
    return END.join(lines) + END + END + body + END + END


def is_packed(headers: dict[str, str]) -> bool:
    return headers.get(COMPRESSION, NOT_PACKED) != NOT_PACKED


def compress(headers: dict[str, str], body: bytes) -> tuple[dict[str, str], bytes]:
    if is_packed(headers):
        return headers, body
    packed = zlib.compress(body)
    return {**headers, COMPRESSION: PACKED, PLAIN_LENGTH: str(len(body)), LENGTH: str(len(packed))}, packed


def decompress(headers: dict[str, str], body: bytes) -> tuple[dict[str, str], bytes]:
    if not is_packed(headers):
        return headers, body
    plain = zlib.decompress(body)
    return {k: v for k, v in headers.items() if k not in (COMPRESSION, PLAIN_LENGTH)} | {LENGTH: str(len(plain))}, plain


def _file_system(path: str):
    """The file system of a path and the path in it; what Spark calls s3a is s3 here."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))


def _names(path: str) -> list[str]:
    """The files of a path: a file, all WARC files below a folder, or those whose names match a pattern."""
    from pyarrow import fs

    store, at = _file_system(path)
    head, _, tail = at.rpartition("/")
    if "*" in tail or "?" in tail:
        found = store.get_file_info(fs.FileSelector(head))
        return sorted(f.path for f in found if f.is_file and fnmatch.fnmatch(f.base_name, tail))
    info = store.get_file_info(at)
    if info.is_file:
        return [at]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz")))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, version, headers, body, compressed, error) of the records of files, plain or gzip, which are read as streams:
    a record at a time is in memory. Where a file can't be read on, its last row has the error; the rows before it stay."""
    register(spark)
    return spark.read.format("warc").load(path)


def _batch(rows):
    kinds = [pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.bool_(), pa.string()]
    names = ["path", "version", "headers", "body", "compressed", "error"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def responses(entries: DataFrame) -> DataFrame:
    return entries.where("headers['WARC-Type'] = 'response'")


def to_docs(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, rejects): (url, content) of the responses with a target and a UTF-8 body; (path, url, reason) of the others."""

    def run(batches):
        for batch in batches:
            out = []
            for headers, body in zip(batch["headers"].to_pylist(), batch["body"].to_pylist()):
                own = dict(headers or ())
                try:
                    out.append((decompress(own, body or b"")[1].decode("utf-8"), None))
                except (zlib.error, UnicodeDecodeError) as e:
                    out.append((None, type(e).__name__))
            text, bad = zip(*out) if out else ((), ())
            yield pa.record_batch([batch["path"], batch["url"], batch["kind"], batch["error"], pa.array(text, pa.string()), pa.array(bad, pa.string())], names=["path", "url", "kind", "error", "content", "bad"])

    rows = entries.select("path", F.col("headers")["WARC-Target-URI"].alias("url"), F.col("headers")["WARC-Type"].alias("kind"), "error", "headers", "body")
    rows = rows.mapInArrow(run, "path string, url string, kind string, error string, content string, bad string")
    reason = F.coalesce("error", F.when(~F.col("kind").eqNullSafe("response"), "not a response"), F.when(F.col("url").isNull(), "no target"), "bad")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason IS NULL").select("url", "content"), rows.where("reason IS NOT NULL").select("path", "url", "reason")


def recoded(entries: DataFrame, packed: bool) -> DataFrame:
    """The entries with all bodies compressed, or none."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, version, headers, body, error in zip(*(batch[c].to_pylist() for c in ("path", "version", "headers", "body", "error"))):
                if headers is not None:
                    own, body = (compress if packed else decompress)(dict(headers), body)
                    headers = list(own.items())
                rows.append((path, version, headers, body, packed if headers is not None else None, error))
            if rows:
                yield _batch(rows)

    return entries.mapInArrow(run, SCHEMA)


def write_warc(docs: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z", own_ids: bool = False, packed: bool = True) -> None:
    """Writes (url, content) as files of response records beside those that are there, one per partition, each to its name
    at once when it is whole. A record's id is its url, or with own_ids, as a crawler writes them, a UUID of url and body."""
    call = uuid.uuid4().hex[:12]

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, at = _file_system(path)
        store.create_dir(at)
        name = f"{at}/part-{call}-{task.partitionId():05d}.warc"
        part, n = f"{name}.{task.taskAttemptId()}.tmp", 0
        with store.open_output_stream(part) as f:
            for batch in batches:
                for url, content in zip(batch["url"].to_pylist(), batch["content"].to_pylist()):
                    body = (content or "").encode("utf-8")
                    mark = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, url + hashlib.md5(body).hexdigest())}>" if own_ids else f"<{url}>"
                    headers = {"WARC-Record-ID": mark, "WARC-Type": "response", "WARC-Target-URI": url, "WARC-Date": date}
                    f.write(record_bytes(*(compress(headers, body) if packed else (headers, body))))
                    n += 1
        store.move(part, name)
        yield pa.record_batch([pa.array([name]), pa.array([n])], names=["name", "n"])

    docs.select("url", "content").where("url IS NOT NULL").mapInArrow(run, "name string, n bigint").count()


def posted(entries: DataFrame, post, size: int = 1) -> DataFrame:
    """(url, error) after posting the records that have a target and a UTF-8 body."""
    from lodestack.sources.docs import post_each

    return post_each(to_docs(entries)[0], post, size)


class WarcSource(DataSource):
    """spark.read.format("warc"): a row per record of the files of a folder, a partition per file."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"])


class WarcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(n) for n in _names(self.path)]

    def read(self, partition):
        name, rows, error = partition.value, [], None
        store, _ = _file_system(self.path)
        with store.open_input_stream(name, compression=None) as raw:
            f = io.BufferedReader(gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw, 1 << 20)
            try:
                for version, headers, body in records(f):
                    rows.append((name, version, list(headers.items()), body, is_packed(headers), None))
                    if len(rows) == BATCH:
                        yield _batch(rows)
                        rows = []
            except (WarcError, OSError, EOFError, UnicodeDecodeError, zlib.error) as e:
                error = str(e)
        if error:
            rows.append((name, None, None, None, None, error))
        if rows:
            yield _batch(rows)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
