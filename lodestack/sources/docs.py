"""Documents from JSON, lists of urls, files, repositories, job descriptions; reports and posts."""

from __future__ import annotations

import json
import os
import struct
import subprocess
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "docs array<struct<url:string, content:string>>"
# What the file crawler takes, and what counts as a page.
EXTENSIONS = (".hs", ".ts", ".css")
PAGE_TYPES = ("text/html", "text/html; charset=utf-8", "text/html;charset=utf-8", "text/html; charset=UTF-8", "text/html;charset=UTF-8", 'text/html; charset="utf-8"')
TIMEOUT, AT_ONCE = 10, 10


def json_batches(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(url, content) of files of {"docs": [{"url", "content"}]}, one to a file or, with lines, to a line."""
    return spark.read.schema(BATCH).json(path, multiLine=not lines).select(F.inline("docs"))


def cbor_batches(spark: SparkSession, path: str) -> DataFrame:
    """(url, content, compression) of files that each hold an array of documents in CBOR, as maps or as arrays of their
    three fields. ValueError of what is no such file."""

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch["content"].to_pylist():
                for d in read_cbor(data):
                    rows.append((d.get("url"), d.get("content"), d.get("compression")) if isinstance(d, dict) else tuple(d))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.record_batch([pa.array(c, pa.string()) for c in cols], names=["url", "content", "compression"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "url string, content string, compression string")


def read_cbor(data: bytes):
    """The one value of CBOR data (RFC 8949): numbers, strings, arrays, maps, of given or open length, tags left aside."""
    value, at = _cbor(data, 0)
    if at != len(data):
        raise ValueError("more than one CBOR value")
    return value


_BREAK = object()


def _cbor(data: bytes, at: int):
    if at >= len(data):
        raise ValueError("CBOR cut short")
    kind, low = data[at] >> 5, data[at] & 31
    at += 1
    n, open_ = low, low == 31
    if 24 <= low < 28:
        size = 1 << (low - 24)
        n, at = int.from_bytes(data[at : at + size]), at + size
        if at > len(data):
            raise ValueError("CBOR cut short")
    elif 28 <= low < 31:
        raise ValueError("not CBOR")
    if kind == 0 or kind == 1:
        return (n if kind == 0 else -1 - n), at
    if kind in (2, 3):
        parts = []
        while open_:
            part, at = _cbor(data, at)
            if part is _BREAK:
                break
            parts.append(part if isinstance(part, bytes) else part.encode())
        if not open_:
            parts, at = [data[at : at + n]], at + n
            if at > len(data):
                raise ValueError("CBOR cut short")
        whole = b"".join(parts)
        return (whole if kind == 2 else whole.decode("utf-8")), at
    if kind in (4, 5):
        items = []
        while open_ or len(items) < n * (kind - 3):
            x, at = _cbor(data, at)
            if x is _BREAK:
                break
            items.append(x)
        return (items if kind == 4 else dict(zip(items[::2], items[1::2]))), at
    if kind == 6:
        return _cbor(data, at)
    if low == 31:
        return _BREAK, at
    if 25 <= low <= 27:
        return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[low], data[at - (1 << (low - 24)) : at])[0], at
    return {20: False, 21: True}.get(n), at


def url_lines(spark: SparkSession, path: str) -> DataFrame:
    """(url) of the lines of text files, trimmed, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")


def fetched(urls: DataFrame, fetch: Callable[[str], tuple[str | None, str | None]] | None = None) -> DataFrame:
    """(url, content, error, md5) of urls (url): AT_ONCE at a time in each task. `fetch` gives (content, error) of a url;
    the usual one takes pages that answer with success and a page's type within TIMEOUT seconds."""
    get = fetch or _fetch

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(AT_ONCE) as pool:
            for batch in batches:
                got = list(pool.map(get, batch["url"].to_pylist()))
                yield pa.record_batch([batch["url"], pa.array([c for c, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=["url", "content", "error"])

    return urls.select("url").mapInArrow(run, "url string, content string, error string").withColumn("md5", F.md5("content"))


def _fetch(url: str) -> tuple[str | None, str | None]:
    import urllib.request

    try:
        with urllib.request.urlopen(url, timeout=TIMEOUT) as r:
            kind = r.headers.get("Content-Type", "")
            return (r.read().decode("utf-8"), None) if kind in PAGE_TYPES else (None, f"type {kind}")
    except Exception as e:  # noqa: BLE001 - whatever a fetch fails of is its result
        return None, str(e)


def from_snapshot(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """As fetched, from a table of pages (url, content)."""
    found = urls.select("url").distinct().join(pages.select("url", "content"), "url", "left")
    return found.withColumn("error", F.when(F.col("content").isNull(), "not in the snapshot")).withColumn("md5", F.md5("content"))


def local_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(url, content) of files: url is the path, bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.regexp_replace("path", "^file:", "").alias("url"), F.decode("content", "UTF-8").alias("content"))


def git_files(spark: SparkSession, repository: str) -> DataFrame:
    """The files a repository keeps. ValueError if it is none."""
    if not os.path.isdir(f"{repository}/.git"):
        raise ValueError(f"no repository: {repository}")
    names = subprocess.run(["git", "-C", repository, "ls-files", "-z"], capture_output=True, check=True, text=True).stdout.split("\0")
    return local_files(spark, [f"{repository}/{n}" for n in names if n])


def crawled_files(spark: SparkSession, root: str, host: str, skip: tuple[str, ...] = (), extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(url, content) of the files below root of these extensions, outside the folders to skip, that are UTF-8. A url is
    file://host/path, with ? for characters that aren't ASCII."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    wanted = path.rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")
    for folder in skip:
        wanted = wanted & ~path.contains(f"/{folder}/")
    strict = F.expr("is_valid_utf8(CAST(content AS STRING))")
    return files.where(wanted & strict).select(F.concat(F.lit(f"file://{host}"), F.regexp_replace(path, r"[^\x00-\x7F]", "?")).alias("url"), F.col("content").cast("string").alias("content"))


def crawl_jobs(text: str) -> list[dict]:
    """Jobs {actions: [{action, param}], seedUrls, maxPages} of a description in YAML (if its library is there) or JSON."""
    try:
        import yaml

        read = yaml.safe_load(text)
    except ImportError:
        read = json.loads(text)
    return [{"actions": j.get("actions") or [], "seedUrls": j.get("seedUrls") or [], "maxPages": j.get("maxPages")} for j in (read or {}).get("jobs", [])]


def write_reports(errors: DataFrame, path: str) -> None:
    """One JSON object per line, behind what is there."""
    errors.write.mode("append").json(path)


def post_each(docs: DataFrame, post: Callable[[dict], None], size: int = 1) -> DataFrame:
    """(url, error) after posting (url, content), `size` at a time; of a post that fails all its records have the error."""

    def run(batches):
        for batch in batches:
            rows, errors = list(zip(batch["url"].to_pylist(), batch["content"].to_pylist())), []
            for at in range(0, len(rows), size):
                part, error = rows[at : at + size], None
                try:
                    post({"docs": [{"url": u, "content": c} for u, c in part]})
                except Exception as e:  # noqa: BLE001 - reported to the caller, row by row
                    error = str(e)
                errors += [error] * len(part)
            yield pa.record_batch([batch["url"], pa.array(errors, pa.string())], names=["url", "error"])

    return docs.select("url", "content").mapInArrow(run, "url string, error string")


def extracted(spark: SparkSession, path: str | list[str], extract: Callable[[str, bytes], tuple[str | None, dict[str, str]]] | None = None) -> DataFrame:
    """(doc_uri, content, metadata) of files, by a function of name and bytes. The usual one takes text in UTF-8, pages and
    the zipped XML of office documents; anything else has null content and says so in its metadata."""
    read = extract or _plain

    def run(batches):
        for batch in batches:
            names = batch["path"].to_pylist()
            got = [read(n, b) for n, b in zip(names, batch["content"].to_pylist())]
            meta = pa.array([list(m.items()) for _, m in got], pa.map_(pa.string(), pa.string()))
            yield pa.record_batch([pa.array([n.replace("file:", "file://", 1) if not n.startswith("file://") else n for n in names]), pa.array([t for t, _ in got], pa.string()), meta], names=["doc_uri", "content", "metadata"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "doc_uri string, content string, metadata map<string,string>")


def _plain(name: str, data: bytes) -> tuple[str | None, dict[str, str]]:
    import mimetypes
    import zipfile

    kind = mimetypes.guess_type(name)[0] or "application/octet-stream"
    about = {"resourceName": name.rsplit("/", 1)[-1], "Content-Type": kind}
    if data[:4] == b"PK\3\4":
        try:
            return _packed_text(data), about
        except (zipfile.BadZipFile, KeyError, ValueError) as e:
            return None, about | {"error": str(e)}
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None, about | {"error": "not UTF-8"}
    if kind == "text/html":
        page = _Page()
        page.feed(text)  # of broken markup what can be read is kept
        return "\n".join(page.lines), about | page.about
    return text, about


class _Page(HTMLParser):
    """The visible text of a page by lines, and its title and meta pairs."""

    def __init__(self):
        super().__init__()
        self.lines, self.about, self.inside = [], {}, []

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == "meta" and own.get("name") and own.get("content"):
            self.about.setdefault(own["name"], own["content"])
        elif tag in ("script", "style", "title"):
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in self.inside:
            self.inside.remove(tag)

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and "title" in self.inside:
            self.about.setdefault("title", text)
        elif text and not self.inside:
            self.lines.append(text)


# Where documents in zip archives keep their text, and the elements that end a line of it.
_PARTS, _LINE_ENDS = ("word/document.xml", "content.xml", "ppt/slides/", "xl/sharedStrings.xml"), ("p", "h", "si", "br")


def _packed_text(data: bytes) -> str:
    """The text of a document that is a zip archive of XML files."""
    import io
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.startswith(_PARTS) and n.endswith(".xml")]
        if not names:
            raise ValueError("no document")
        out = []
        for n in sorted(names):
            try:
                for event, e in ElementTree.iterparse(io.BytesIO(z.read(n))):
                    out += [e.text or ""] + (["\n"] if e.tag.rsplit("}", 1)[-1] in _LINE_ENDS else [])
            except ElementTree.ParseError:  # what was read before it is kept
                pass
    return "".join(out).strip()
