"""Problem 5: pages of repeated keywords, links and product lines rather than sentences."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PointTable, chunks, decoded_all, laid_out, written
from .p4_encoding import reread_all

#: Bytes of a block whose compression is measured; a shorter rest is measured with the block before it.
BLOCK = 1024
#: Robust deviations by which a page's most redundant block must lie beyond blocks of its language and length.
EXTREME = 1.5
#: Share of a page's visible characters in punctuated sentences under which extreme redundancy is confirmed as stuffing.
SENTENCES = 0.55
#: Words of a sentence, or characters where words are not spaced.
SENTENCE_WORDS, SENTENCE_CHARS = 5, 8
#: Share of function words from which on a page counts as written in their language.
WRITTEN = 0.04
#: Letters from which on a word is long.
LONG_WORD = 4
# The commonest function words of languages in Latin letters.
FUNCTION_WORDS = {
    "de": "der die das und ein eine kein in den dem von zu mit auf für ist nicht sich auch jeder dieser unser",
    "en": "the of and to a an in is that it for on as with by this our every at each their",
    "es": "el la los las de y que en un una se del por con para su este cada",
    "fr": "le la les de des et un une en que est du dans pour au par notre cette chaque",
}
#: Text in Latin letters whose language doesn't show is held against all text in Latin letters.
UNKNOWN = "latin"

_TAG = re.compile(r"<[^<>]*>")
_HAS_LINK = re.compile(r"://|www\.|\.[a-z]{2,}/")
_LINK = re.compile(r"\(?(?:see )?(?<!\S)(?:\(see )?\(?(?:[a-z]+://|www\.|[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}/)[^\s<>]*?\)?(?=[.,;:]?(?:\s|$))", re.I)
_STOP = re.compile(r"[.!?…:;](?=[\s”\"»)]|$)|[。！？\n]")
_WIDE = re.compile("[！-～]")
_ADDRESS = re.compile(r"(?:[a-z]+://|www\.)[^\s<>\"')]*|[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}/[^\s<>\"')]*", re.I)
_PHRASE = re.compile("[^.!?…;,。！？、|»>·•#\n]*[.!?…;,。！？、|»>·•#\n]?")
_CJK, _CYRILLIC, _LETTER = re.compile("[぀-ヿ㐀-鿿]"), re.compile("[Ѐ-ӿ]"), re.compile(r"[^\W\d_]")


_WORDS_OF = {name: words.split() for name, words in FUNCTION_WORDS.items()}


def script(text: str) -> str:
    """The script of most letters of the whole text (without tags)."""
    if text.isascii():
        return "latin"
    cjk, cyrillic = len(_CJK.findall(text)), len(_CYRILLIC.findall(text))
    if not cjk and not cyrillic:
        return "latin"
    most = max(1, len(_LETTER.findall(text)))
    return "cjk" if cjk > 0.2 * most else "cyrillic" if cyrillic > 0.3 * most else "latin"


def language(text: str, kind: str) -> str:
    """The script of a text without tags, or for Latin letters the language whose function words stand in it; the script
    where none does."""
    if kind != "latin":
        return kind
    words = text.lower().split()
    met = Counter(words).get
    own = {name: sum(met(w, 0) for w in those) for name, those in _WORDS_OF.items()}
    best = max(own, key=lambda k: (own[k], k))
    return best if own[best] >= max(1, WRITTEN * len(words)) else UNKNOWN


def readable(text: str) -> str:
    """The text in letters of usual width, with what reads as UTF-8 by its bytes read as such."""
    if text.isascii():
        return text
    return reread_all(unicodedata.normalize("NFKC", text) if _WIDE.search(text) else text)


def sentence_share(text: str) -> float:
    """The share of the visible characters of a page without tags, links aside, that stand in sentences: runs that begin with no
    small letter, end with sentence punctuation and are long enough for one."""
    if "/" in text and _HAS_LINK.search(text) or "www." in text:
        text = _LINK.sub("", text)
    inside = at = 0
    for m in _STOP.finditer(text):
        end = m.end()
        stop = text[end - 1]
        if stop != "\n":
            run = text[at:end]
            if stop in "。！？":
                inside += len(run) if len(run) >= SENTENCE_CHARS else 0
            elif (n := len(words := run.split())) >= SENTENCE_WORDS and not words[0][0].islower():
                inside += sum(map(len, words)) if n else 0
        at = end
    return inside / max(1, len(text) - text.count(" ") - text.count("\n"))


def blocks_of(text: str) -> list[tuple[int, str]]:
    """(bytes, text) of each block; no byte is in two blocks, a character cut in two is in none."""
    raw = text.encode("utf-8", "surrogatepass")
    cuts = list(range(0, max(1, len(raw) - BLOCK // 2), BLOCK)) + [len(raw)]
    return [(b - a, raw[a:b].decode("utf-8", "ignore")) for a, b in zip(cuts, cuts[1:]) if b > a]


_OTHER, _LONG, _DIGIT, _IDEOGRAM = range(4)
_kind = PointTable(lambda c: _IDEOGRAM if "\u30a0" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or c == "々" else _DIGIT if c.isdigit() else _LONG if c.isalpha() and not "\u3040" <= c <= "\u309f" else _OTHER)
_SIGN = np.array([0, ord("w"), ord("0"), ord("K")], np.uint32)


def skeletons(blocks: list[str]) -> list[str]:
    """Of each block a text with one sign for each address, long word, number and run of Chinese characters; short words,
    which tie sentences together, stay. Cut into phrases and sorted, so that lists of ever new words are as redundant as
    repeated ones, in whatever order they stand."""
    plain = []
    for b in blocks:
        if "/" in b and _HAS_LINK.search(b):
            b = _ADDRESS.sub("U", b)
        plain.append(_TAG.sub(lambda m: " " if m.group()[1] == "/" else "\n", b) if "<" in b else b)
    out: list[str] = []
    for lo, hi in chunks(plain):
        points, _, ends = laid_out(plain[lo:hi])
        points = points.copy()
        points[ends] = 2
        kind = _kind.of(points).astype(np.int8)
        joins = (points[1:-1] == 46) | (points[1:-1] == 44)
        kind[1:-1][joins & (kind[:-2] == _DIGIT) & (kind[2:] == _DIGIT)] = _DIGIT
        first = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        size = np.diff(np.append(first, len(kind)))
        own = kind[first]
        shrunk = (own == _DIGIT) | (own == _IDEOGRAM) | (own == _LONG) & (size >= LONG_WORD)
        keep = np.repeat(~shrunk, size)
        points[first[shrunk]] = _SIGN[own[shrunk]]
        keep[first[shrunk]] = True
        short = points[keep].tobytes().decode("utf-32-le", "surrogatepass").lower()
        out += ["\1".join(sorted(p for x in _PHRASE.findall(t) if len(p := x.strip()) > 1)) for t in short.split("\2")[:-1]]
    return out


def _deflated(text: str) -> int:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return len(c.compress(text.encode("utf-8", "surrogatepass"))) + len(c.flush())


def block_ratios(texts: list[str]) -> list[list[tuple[int, float, float]]]:
    """(length class, compressed share of the block, compressed share of its skeleton) of each block of each text; a
    length class is half a power of two."""
    cut = [blocks_of(t.replace("\2", " ")) for t in texts]
    bones = iter(skeletons([b for own in cut for _, b in own]))
    return [[(int(2 * math.log2(n + 1)), _deflated(b.lower()) / n, _deflated(next(bones)) / n) for n, b in own] for own in cut]


_FEATURES = "input_id bigint, language string, script string, share double, blocks array<struct<size:int, plain:double, bones:double>>"


def features(docs: DataFrame) -> DataFrame:
    """(input_id, language, script, share, blocks) of every content that isn't blank."""

    def run(batches):
        for batch in batches:
            own = [(i, readable(t)) for i, t in zip(batch["input_id"].to_pylist(), decoded_all(batch["content"].to_pylist(), batch["compression"].to_pylist())) if t and not t.isspace()]
            rows = []
            for (i, text), ratios in zip(own, block_ratios([t for _, t in own])):
                bare = _TAG.sub(" ", text) if "<" in text else text
                kind = script(bare)
                blocks = [{"size": k, "plain": p, "bones": q} for k, p, q in ratios]
                rows.append({"input_id": i, "language": language(bare, kind), "script": kind, "share": sentence_share(bare), "blocks": blocks})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return docs.select("input_id", "content", "compression").where("input_id IS NOT NULL AND content IS NOT NULL").mapInArrow(run, _FEATURES)


_SCHEMA = pa.schema([
    ("input_id", pa.int64()), ("language", pa.string()), ("script", pa.string()), ("share", pa.float64()),
    ("blocks", pa.list_(pa.struct([("size", pa.int32()), ("plain", pa.float64()), ("bones", pa.float64())]))),
])


def scored(docs: DataFrame) -> DataFrame:
    """(input_id, language, share, redundancy, stuffed) of each page.

    Redundancy is how many robust deviations the page's most redundant block lies below the median of blocks of its
    language and length in the whole collection, by the compression of the block itself or of its skeleton; deviations
    are those of the less redundant half, which stuffed pages don't widen. A page is stuffed if its redundancy is extreme
    and the share of it in punctuated sentences, measured on the whole page, is low. Null and blank contents are no
    pages; of a repeated input_id the lowest share and the highest redundancy count.
    """
    own = written(features(docs), "page-features")
    blocks = own.select("input_id", "language", "script", F.explode("blocks").alias("b")).select("input_id", "language", "script", "b.*")
    at = lambda c: F.percentile_approx(c, [0.5, 0.75], 1000).alias(c)
    # a few languages and scripts, some sixty length classes
    pooled = F.explode(F.array_distinct(F.array("language", "script"))).alias("of")
    known = blocks.where((F.col("language") != UNKNOWN)).select(pooled, "size", "plain", "bones")
    norms = known.groupBy("of", "size").agg(at("plain"), at("bones"))
    norms = norms.select(F.col("of").alias("language"), F.col("size").alias("near"), F.col("plain").alias("p"), F.col("bones").alias("q"))
    # of a length without a norm, the nearest that has one
    met = blocks.select("language", "size").distinct().join(F.broadcast(norms), "language")
    nearest = F.min_by(F.struct("p", "q"), F.struct(F.abs(F.col("size") - F.col("near")), -F.col("near"))).alias("n")
    norms = met.groupBy("language", "size").agg(nearest).select("language", "size", "n.*")
    far = lambda q, x, least: (q[0] - x) / F.greatest(F.lit(least), (q[1] - q[0]) / 0.6745)
    z = F.greatest(far(F.col("p"), F.col("plain"), 0.01), far(F.col("q"), F.col("bones"), 0.003))
    most = blocks.join(F.broadcast(norms), ["language", "size"], "left").groupBy("input_id").agg(F.max(F.coalesce(z, F.lit(0.0))).alias("redundancy"))
    share = own.groupBy("input_id").agg(F.min("share").alias("share"), F.min("language").alias("language"))
    both = share.join(most, "input_id")
    return both.select("input_id", "language", "share", "redundancy", ((F.col("redundancy") >= EXTREME) & (F.col("share") < SENTENCES)).alias("stuffed"))
