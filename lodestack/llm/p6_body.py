"""Problem 6: the main body of pages, by the vote of a host's pages on the paths of their containers.

A container of a page with tags is addressed by the tags and classes it lies in, a line of a page without tags by its
generalised form: no list of phrases says what a frame holds. What a host's pages, or those of all hosts, say again and
again beside ever other text is frame, and so is what lies on paths that hold hardly any running text.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, decoded_all, mixed, words_of, written
from .p3_lookalikes import INVISIBLE, _LATIN
from .p4_encoding import reread_all

#: A path loses if at most this share of its lines is running text or a short line of its own; on a host, the vote of all
#: hosts counts as this many lines more.
LOSING, PRIOR = 0.3, 5
#: A form repeats on a host, or in the whole collection, if the lower bound of its share of the pages is at least this;
#: and if the pages that hold it have different text in at least this share of cases, so that copies of a page and small
#: edits of it don't make its lines a frame.
ON_HOST, ANYWHERE, APART = 0.02, 5e-4, 0.4
#: A repeated short line that stands alone between running text in this share of cases may be a heading; a line of a
#: repeated lead (before a colon, or of two words before a list) is frame only if in fewer than this it stands so.
HEADING, LEAD = 0.3, 0.5
#: Words up to which a line has a form that is counted over all hosts; characters from which on a line is running text.
FORM_WORDS, LONG = 25, 160
#: Forms and paths up to which they are broadcast (8 bytes each); beyond, they are joined to the records by a shuffle.
BROADCAST_KEYS = 2_000_000

_TAG = re.compile("<[^<>]*>|＜[^＜＞]*＞")
_NAME = re.compile(r"<\s*(/?)\s*([a-zA-Z0-9]+)[^<>]*?(?:class\s*=\s*[\"']?([^\"'<>]*))?[\"']?\s*>")
_DIGITS = re.compile(r"\d+(?:[.,]\d+)*")
_BULLET = re.compile(r"(?:[-*•·–]|\d+[.)])\s+\S|[│├└|]|```| {4}\S")
_ENDS = re.compile(r"[.!?…:;。！？][”\"»’')]*$")
_BRACKETS = re.compile(r"(?:\[[^\[\]]{1,30}\]\s*){2,}$")
_SPACED = re.compile(r"\S {2,}\S")
_PAGE = re.compile(r"[-–—]? ?#(?: ?/ ?#)? ?[-–—]?$")
_SEPARATED = re.compile(" [|»·•/>] |｜|\\S  +\\S")
_CAPITALS = re.compile("(?<!\\S)[A-ZÀ-ÖØ-ÞΑ-ΩЀ-Я]\\S*")
_BEFORE_COLON = re.compile(r"(.{2,40}?)\s?(?::|—|：) ?\S")
_FOLD = {ord(a): b for a, b in _LATIN.items()} | {ord(c): None for c in INVISIBLE}
_FOLDED = re.compile("[" + "".join(map(re.escape, map(chr, _FOLD))) + "]")
FRAME, SHORT, TEXT, ALONE = range(4)


def folded(line: str) -> str:
    """A line without what can't be seen, width and script of letters; read again where it was wrongly decoded."""
    if line.isascii():
        return line.lower()
    line = unicodedata.normalize("NFKC", reread_all(line))
    return (unicodedata.normalize("NFC", line.translate(_FOLD)) if _FOLDED.search(line) else line).lower()


def _own_tags(line: str) -> list[tuple[str, str]]:
    """(end mark, label) of each tag of a line; a label is the tag and its first class, # for numbers."""
    found = _NAME.findall(unicodedata.normalize("NFKC", line).translate(_FOLD) if not line.isascii() else line)
    return [(close, name.lower() + ("." + _DIGITS.sub("#", own[0]) if cls and (own := cls.split()) else "")) for close, name, cls in found]


def paths_of(lines: list[str]) -> list[str]:
    """The generalised path of each line: the containers that are opened on a line before it and closed on it or behind
    it, from the outside, then up to three tags of its own. "" for a line in no container."""
    tags = [_own_tags(x) if "<" in x or "＜" in x else [] for x in lines]
    opened: list[tuple[str, int]] = []
    around: list[list[tuple[int, str]]] = [[] for _ in lines]
    for n, own in enumerate(tags):
        for close, label in own:
            if not close:
                opened.append((label, n))
                continue
            name = label.split(".")[0]
            for k in range(len(opened) - 1, -1, -1):
                if opened[k][0].split(".")[0] == name:
                    if (at := opened[k][1]) < n:
                        for i in range(at + 1, n + 1):
                            around[i].append((at, opened[k][0]))
                    del opened[k:]
                    break
    out = []
    for outer, own in zip(around, tags):
        inner = []
        for close, label in own:
            if close or len(inner) == 3:
                break
            inner.append(label)
        path = [label for _, label in sorted(outer)][-4:] + inner
        out.append(">".join(path) if path else "?" if own else "")
    return out


def brand_of(host: str | None) -> str:
    labels = (host or "").split(".")
    return labels[-2].split("-")[0].lower() if len(labels) > 1 else ""


def kind_of(text: str) -> tuple[int, str]:
    """What a line looks like by its separators, punctuation and length, and its form: its folded text with # for
    numbers. Rows of links are frame, sentences, list items and long lines text, what is left is short."""
    form = _DIGITS.sub("#", folded(text))
    if len(text) > LONG:
        return TEXT, form
    if _PAGE.fullmatch(form):
        return FRAME, form
    if _BULLET.match(text):
        return TEXT, form
    if text[0] == "[" and _BRACKETS.match(form):
        return FRAME, form
    n = form.count(" ") + 1
    ends = bool(_ENDS.search(form))
    if not ends or "»" in form:
        if _SEPARATED.search(form):
            seps = form.count(" | ") + form.count("｜") + form.count(" » ")
            steps = form.count(" > ") + form.count(" / ")
            if seps or steps + form.count(" · ") + form.count(" • ") + len(_SPACED.findall(form)) >= 2 or steps and n > 5:
                return FRAME, form
        if "…" in form:
            return FRAME, form
    if ends and (n >= 5 or len(form) >= 12 and ord(max(form)) > 0x3000):
        return TEXT, form
    return (TEXT if n > 14 or len(form) > 110 else SHORT), form


def _anywhere(text: str, form: str) -> str:
    """The form with * for names, that is for words with a capital; the form itself where little would be left."""
    if (n := text.count(" ") + 1) > FORM_WORDS:
        return ""
    masked, k = _CAPITALS.subn("*", text)
    if not k or 2 * k > n or n == 1 or n == 2 and text[0].isupper():
        return form
    return _DIGITS.sub("#", folded(masked))


def _key(what: str, form: str, scope: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(what + form, scope) - (1 << 63)


def lines_of(content: str, host: str | None) -> list[tuple[int, int, int, int, int, int, int]]:
    """(number, kind, key on the host, key anywhere, key of its lead, path on the host, path anywhere) of each line that
    isn't blank; a key is 0 where there is none."""
    scope = xxhash.xxh3_64_intdigest(host or "")
    brand = brand_of(host)
    lines = content.split("\n")
    paths = paths_of(lines) if "<" in content or "＜" in content else [""] * len(lines)
    out, forms, kinds = [], [], []
    for n, (line, path) in enumerate(zip(lines, paths)):
        if not line or line.isspace():
            continue
        text = (_TAG.sub("", line) if path else line).strip()
        kind, form = kind_of(text) if text else (FRAME, "")
        h = g = p = 0
        if text:
            if len(brand) > 2:
                form = form.replace(brand, "@")
            h = _key("H", form, scope)
            any_ = _anywhere(text, form)
            g = _key("G", any_) if any_ else 0
            if kind == SHORT:
                lead = _BEFORE_COLON.match(form)
                if lead:
                    p = _key("P", lead[1])
                elif "," in form or "、" in form:
                    p = _key("L", " ".join(form.split(" ")[:2]))
        kinds.append(kind)
        forms.append(form if kind == SHORT and not path else None)
        out.append((n, h, g, p, _key("T", path, scope) if path else 0, _key("U", path) if path else 0))
    met: dict[str, int] = {}
    for f in forms:
        if f is not None:
            met[f] = met.get(f, 0) + 1
    # what a printed page repeats on every sheet
    kinds = [FRAME if f is not None and met[f] > 1 else k for k, f in zip(kinds, forms)]
    last = len(kinds) - 1
    return [
        (n, ALONE if k == SHORT and 0 < i < last and kinds[i - 1] == TEXT == kinds[i + 1] else k, *more)
        for i, (k, (n, *more)) in enumerate(zip(kinds, out))
    ]


_FIELDS = ("nos", "kinds", "hosts", "anys", "leads", "paths", "overs")
_LINES = "nos array<int>, kinds array<tinyint>, " + ", ".join(f"{f} array<bigint>" for f in _FIELDS[2:])
_KINDS = (pa.int32(), pa.int8(), *[pa.int64()] * 5)
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def prints(texts: list[str]) -> np.ndarray:
    """A print of each text by two MinHash values of its runs of three words: mostly alike for texts that share most of
    their wording, different for others. Texts of under three words have that of their first character."""
    out = np.zeros(len(texts), np.int64)
    for lo, hi in chunks(texts):
        h, row = words_of(texts[lo:hi])
        own = np.fromiter((ord(t[0]) if t else 0 for t in texts[lo:hi]), np.int64, hi - lo)
        n = len(h) - 2
        if n > 0:
            run = mixed(mixed(h[:n] * np.uint64(3) + h[1 : n + 1]) * np.uint64(5) + h[2 : n + 2])
            whole = row[:n] == row[2 : n + 2]
            run, of = run[whole], row[:n][whole]
            if len(of):
                first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                both = mixed(np.minimum.reduceat(mixed(run * _SEEDS[0]), first)) ^ np.minimum.reduceat(mixed(run * _SEEDS[1]), first)
                own[of[first]] = both.view(np.int64)
        out[lo:hi] = own
    return out


def _records(docs: DataFrame) -> DataFrame:
    """docs: (tab, rec_key, host, content, compression)."""
    return docs.select("tab", "rec_key", "host", "content", "compression").where("rec_key IS NOT NULL AND content IS NOT NULL")


def _laid(texts: list[str], hosts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each text's lines begin (and one more), and the fields of all lines."""
    got = [lines_of(t, h) for t, h in zip(texts, hosts)]
    cut = np.concatenate(([0], np.cumsum([len(x) for x in got]))).astype(np.int32)
    flat = list(zip(*(line for x in got for line in x))) or [()] * len(_FIELDS)
    return cut, [np.array(c, k.to_pandas_dtype()) for c, k in zip(flat, _KINDS)]


def features(docs: DataFrame) -> DataFrame:
    """(tab, rec_key, host, print, fields of the lines) of each record: what the votes and the extraction read instead of
    the texts."""

    def run(batches):
        for batch in batches:
            texts, hosts = decoded_all(batch["content"].to_pylist(), batch["compression"].to_pylist()), batch["host"].to_pylist()
            cut, fields = _laid(texts, hosts)
            own = pa.array([xxhash.xxh3_64_intdigest(h or "") - (1 << 63) for h in hosts], pa.int64())
            lists = [pa.ListArray.from_arrays(cut, pa.array(f)) for f in fields]
            yield pa.record_batch([batch["tab"], batch["rec_key"], own, pa.array(prints(texts)), *lists], names=["tab", "rec_key", "host", "print", *_FIELDS])

    return _records(docs).mapInArrow(run, f"tab string, rec_key string, host bigint, print bigint, {_LINES}")


def _often(n, of, share: float):
    """Whether the lower bound of a count's share is at least `share`: no form of few pages repeats, however few there are."""
    return n - F.sqrt(3 * n) >= F.lit(share) * of


def losing(lines: DataFrame) -> DataFrame:
    """(key, what) of the features of a collection: what = 'line' for repeated forms, 'heading' for those of them that may
    be headings, 'lead' for repeated leads, 'path' for losing paths."""
    pages = lines.groupBy("host").agg(F.count("*").alias("pages"))
    total = lines.count()
    alone = "transform(kinds, k -> k = 3)"
    zipped = lambda *cols: F.inline(F.arrays_zip(*(F.expr(c).alias(n) for n, c in cols)))
    # a row per form of a page; counts first, which are combined before the shuffle, so that the forms of single pages,
    # which are most of all, are put aside by eight bytes each
    keys = lambda c: F.explode(F.array_distinct(F.expr(c))).alias("key")
    counted = lines.select(keys("concat(hosts, anys, leads)")).where("key <> 0").groupBy("key").agg(F.count("*").alias("n"))
    many = written(counted.where(_often(F.col("n"), F.lit(0), 0.0) & (F.col("n") > 3)).select("key"), "repeated-forms")
    each = lambda c, level: lines.select("host", "print", F.lit(level).alias("level"), zipped(("key", c), ("alone", alone))).where("key <> 0")
    rows = each("hosts", 0).unionByName(each("anys", 1)).unionByName(each("leads", 2)).join(many, "key", "left_semi")
    met = rows.groupBy("key", "level").agg(
        F.count("*").alias("n"), F.approx_count_distinct("print", 0.1).alias("d"), F.avg(F.col("alone").cast("double")).alias("alone"), F.min("host").alias("host")
    ).where(F.col("d") >= APART * F.col("n"))
    met = met.join(pages, "host")
    often = F.when(F.col("level") == 0, _often(F.col("n"), F.col("pages"), ON_HOST)).otherwise(_often(F.col("n"), F.lit(total), ANYWHERE))
    what = F.when(F.col("level") == 2, F.when(F.col("alone") < LEAD, "lead")).when(F.col("alone") >= HEADING, "heading").otherwise("line")
    forms = met.where(often).select("key", what.alias("what")).where("what IS NOT NULL")
    # of each path the share of running text and of different short lines
    on = lines.select(zipped(("key", "paths"), ("over", "overs"), ("kind", "kinds"), ("form", "anys"))).where("key <> 0")
    short = F.when(F.col("kind").isin(SHORT, ALONE), F.col("form"))
    votes = [F.count("*").alias("n"), F.sum((F.col("kind") == TEXT).cast("int")).alias("text"), F.approx_count_distinct(short, 0.1).alias("own")]
    score = F.least(F.lit(1.0), (F.col("text") + F.col("own")) / F.col("n"))
    over = on.groupBy("over").agg(*votes).select("over", score.alias("prior"))
    here = on.groupBy("key", "over").agg(*votes).join(over, "over")
    loses = (score * F.col("n") + PRIOR * F.col("prior")) / (F.col("n") + PRIOR) <= LOSING
    return written(forms.unionByName(here.where(loses).select("key", F.lit("path").alias("what"))), "losing")


def _outside(cut: np.ndarray, fields: list[np.ndarray], lost: dict[str, np.ndarray]) -> np.ndarray:
    """Which lines don't belong to the main body.

    A line of a losing path, of a repeated form or of a repeated lead is frame; a short line of no repeated form is a
    title or a heading. A short line of a repeated one is a heading only if the form may be one, and where it stands
    between two lines of the body. The only line of a record is its body.
    """
    _, kinds, hosts, anys, leads, paths, _ = fields
    kinds = kinds.copy()
    short = (kinds == SHORT) | (kinds == ALONE)
    kinds[np.isin(paths, lost["path"]) | short & np.isin(leads, lost["lead"])] = FRAME
    head = np.isin(hosts, lost["heading"]) | np.isin(anys, lost["heading"])
    again = head | np.isin(hosts, lost["line"]) | np.isin(anys, lost["line"])
    short = (kinds == SHORT) | (kinds == ALONE)
    body = ((kinds == TEXT) | short) & ~again
    beside = np.zeros(len(kinds), bool)
    beside[1:-1] = body[:-2] & body[2:]
    beside[cut[:-1][cut[:-1] < len(kinds)]] = False
    beside[cut[1:][cut[1:] > 0] - 1] = False
    size = np.diff(cut)
    return ~(body | short & head & beside | np.repeat(size == 1, size))


_WHATS = ("line", "heading", "lead", "path")


def _lost(keys: np.ndarray, whats: np.ndarray) -> dict[str, np.ndarray]:
    return {w: np.sort(keys[whats == w]) for w in _WHATS}


def _with_lost(rows: DataFrame, lines: DataFrame, lost: DataFrame) -> DataFrame:
    """The rows (tab, rec_key, ...) with the losing keys each of their records holds, and what they are, by joins."""
    met = lines.select("tab", "rec_key", F.explode(F.expr("array_distinct(concat(hosts, anys, leads, paths))")).alias("key")).join(lost, "key")
    met = met.groupBy("tab", "rec_key").agg(F.collect_set(F.struct("key", "what")).alias("l"))
    own = met.select("tab", "rec_key", F.col("l.key").alias("lost_keys"), F.col("l.what").alias("lost_whats"))
    return rows.join(own, ["tab", "rec_key"], "left")


def _taken(rows: DataFrame, lines: DataFrame, lost: DataFrame, run_with, schema: str) -> DataFrame:
    """Runs run_with(batch, losing keys) over rows: keys are broadcast if they are few enough, else joined."""
    if lost.count() <= BROADCAST_KEYS:
        got = lost.toPandas()
        shared = rows.sparkSession.sparkContext.broadcast(_lost(got["key"].to_numpy(np.int64), got["what"].to_numpy(object)))

        def run(batches):
            for batch in batches:
                yield run_with(batch, shared.value)

        return rows.mapInArrow(run, schema)

    def joined(batches):
        for batch in batches:
            keys, whats = (batch[c].flatten() for c in ("lost_keys", "lost_whats"))
            yield run_with(batch, _lost(keys.to_numpy(zero_copy_only=False).astype(np.int64), whats.to_numpy(zero_copy_only=False)))

    return _with_lost(rows, lines, lost).mapInArrow(joined, schema)


def frame_lines(docs: DataFrame) -> DataFrame:
    """(tab, rec_key, line_no) of every line outside the main body of each record (tab, rec_key, host, content,
    compression). Lines are numbered from 0 and split at line feeds only; blank lines are never given. Null contents and
    null keys give nothing, a repeated record gives its rows once. A null host votes with the other null hosts."""
    lines = written(features(docs), "line-features")

    def run(batch, lost):
        cut = batch["nos"].offsets.to_numpy()
        fields = [batch[f].values.to_numpy(zero_copy_only=False) for f in _FIELDS]
        out = _outside(cut - cut[0], [f[cut[0] : cut[-1]] for f in fields], lost)
        row = pa.array(np.repeat(np.arange(len(cut) - 1), np.diff(cut))[out])
        return pa.record_batch([batch["tab"].take(row), batch["rec_key"].take(row), pa.array(fields[0][cut[0] : cut[-1]][out])], names=["tab", "rec_key", "line_no"])

    return _taken(lines, lines, losing(lines), run, "tab string, rec_key string, line_no int").distinct()


def main_bodies(docs: DataFrame) -> DataFrame:
    """(tab, rec_key, body): each record's content without the lines outside its main body, which are found and taken out
    in one pass over the texts. Of repeated records one is given, found by keys and prints alone."""
    lines = written(features(docs), "line-features")

    def run(batch, lost):
        texts = decoded_all(batch["content"].to_pylist(), batch["compression"].to_pylist())
        cut, fields = _laid(texts, batch["host"].to_pylist())
        out, at = _outside(cut, fields, lost), cut.tolist()
        bodies = []
        for k, text in enumerate(texts):
            drop = set(fields[0][at[k] : at[k + 1]][out[at[k] : at[k + 1]]].tolist())
            bodies.append("\n".join(x for n, x in enumerate(text.split("\n")) if n not in drop) if drop else text)
        mark = pa.array([xxhash.xxh3_64_intdigest(b.encode("utf-8", "surrogatepass")) - (1 << 63) for b in bodies], pa.int64())
        return pa.record_batch([batch["tab"], batch["rec_key"], pa.array(bodies, pa.string()), mark], names=["tab", "rec_key", "body", "mark"])

    found = _taken(_records(docs), lines, losing(lines), run, "tab string, rec_key string, body string, mark bigint")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "bodies")
    # rows are dropped by a join with those that repeat another, which are few: texts are not shuffled
    kept = F.min("row").over(W.partitionBy("tab", "rec_key", "mark"))
    again = found.select("tab", "rec_key", "mark", "row").withColumn("kept", kept).where("row <> kept").select("row")
    return found.join(again, "row", "left_anti").select("tab", "rec_key", "body")
