"""Problem 8: token ids of a whole corpus by a byte-level BPE of the public tokenizers.

The vocabulary file is a parameter; nothing of it is kept here. Texts are split into pieces without a regular
expression: the pattern's rules are read off arrays of code point classes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import PointTable, _grown, chunks, laid_out, mixed

TOKENIZERS = "/opt/tokenizers"
#: Pieces whose ids a worker keeps; when full, it starts anew.
CACHE = 500_000

# The code points of Unicode's White_Space, and the endings the pattern splits off after an apostrophe.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ENDINGS_1, ENDINGS_2 = "stmd", ("re", "ve", "ll")

LETTER, NUMBER, SPACE, OTHER, END = 0, 1, 2, 3, 4
_CLASS_OF = {"L": LETTER, "N": NUMBER}
_class = PointTable(lambda c: SPACE if c in SPACES else _CLASS_OF.get(unicodedata.category(c)[0], OTHER))


def piece_starts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces of the texts begin in their common layout; whether each is a piece (else an end mark); begin and
    end of each text.

    A piece begins where the class changes. A single blank before another class belongs to what follows it; of a longer
    run of spaces the last one stands alone, or is that blank. An apostrophe that begins a piece takes one of the
    endings with it.

    Read as an automaton, a code point's transition function is constant but for what its class and those of its
    neighbours fix: whatever the state before, the state after two code points is the same. Composed functions of an
    associative scan are thus constant after two steps, and the scan closes there: comparing neighbouring classes over
    whole arrays is all of it that is left.
    """
    points, begins, ends = laid_out(texts)
    cls = _class.of(points).astype(np.int8)
    cls[ends] = END
    n = len(cls)
    before = np.empty(n, np.int8)
    before[0], before[1:] = END, cls[:-1]
    after = np.empty(n, np.int8)
    after[-1], after[:-1] = END, cls[1:]
    edge = (cls != before) | (before == END)
    blank = np.zeros(n, bool)
    blank[1:] = points[:-1] == 32
    blank &= before == SPACE
    word = cls <= NUMBER
    word |= cls == OTHER
    start = edge & ~(word & blank)
    start |= (cls == SPACE) & (after != SPACE) & (after != END)
    start |= cls == END
    quotes = np.flatnonzero(start & (points == 39) & (after == LETTER))
    if len(quotes):
        near = np.zeros((3, len(quotes)), np.uint32)
        for k in (1, 2):
            at = np.minimum(quotes + k, n - 1)
            near[k] = np.where(cls[at] == LETTER, points[at], 0)
        one = np.isin(near[1], [ord(c) for c in ENDINGS_1])
        two = np.zeros(len(quotes), bool)
        for e in ENDINGS_2:
            two |= (near[1] == ord(e[0])) & (near[2] == ord(e[1]))
        cut = np.where(one, 2, np.where(two, 3, 0))
        at, cut = quotes[cut > 0], cut[cut > 0]
        start[at + 1] = False
        start[at + cut] = True
    at = np.flatnonzero(start)
    return at, cls[at] != END, begins, ends


class Encoder:
    """Ids of texts by the ranks of a .tiktoken file; keeps the ids of pieces it has met."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.cache: dict[str, list[int]] = {}

    def of_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        if (rank := self.ranks.get(raw)) is not None:
            return [rank]
        return self._merged(raw)

    def _merged(self, raw: bytes) -> list[int]:
        """Merges the pair of least rank, the first of equals, until none is left. A heap over a linked list, so that a
        piece of any length takes n log n steps."""
        ranks, n = self.ranks, len(raw)
        part: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = right[i]
            if part[i] is None or j < 0 or part[i] + part[j] != joined:
                continue
            part[i], part[j], right[i] = joined, None, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (r := ranks.get(part[k] + part[right[k]])) is not None:
                    heapq.heappush(heap, (r, k, part[k] + part[right[k]]))
        return [ranks[p] for p in part if p is not None]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row; how many each text has; first character of each id's piece in its text, and which
        id within its piece it is. The last two locate every token for decoding."""
        at, is_piece, begins, _ = piece_starts(texts)
        whole = "\n".join(texts) + "\n"
        points, _, _ = laid_out(texts)
        starts, stops = at[is_piece], np.append(at[1:], len(points))[is_piece]
        # pieces that are alike in a chunk are looked up once
        power, inverse = _grown(len(points) + 1)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=total[1:])
        prints = mixed((total[stops] - total[starts]) * inverse[starts]) ^ (stops - starts).astype(np.uint64)
        _, first, which = np.unique(prints, return_index=True, return_inverse=True)
        cache, of_piece = self.cache, self.of_piece
        got: list[list[int]] = []
        for a, b in zip(starts[first].tolist(), stops[first].tolist()):
            piece = whole[a:b]
            ids = cache.get(piece)
            if ids is None:
                if len(cache) >= CACHE:
                    cache.clear()
                ids = cache[piece] = of_piece(piece)
            got.append(ids)
        each = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((x for g in got for x in g), np.int32, int(each.sum()))
        sizes = each[which]
        ends = np.cumsum(sizes)
        row = np.searchsorted(begins, starts, "right") - 1
        from_ = (np.cumsum(each) - each)[which]
        ids = flat[np.repeat(from_ - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        counts = np.bincount(row, weights=sizes, minlength=len(texts)).astype(np.int64)
        offset = np.repeat(starts - begins[row], sizes)
        place = np.arange(len(ids)) - np.repeat(ends - sizes, sizes)
        return ids, counts, offset.astype(np.int32), place.astype(np.int32)


_encoders: dict[str, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """The encoder of a vocabulary, made once in a process."""
    mark = hashlib.md5(data).hexdigest()
    if mark not in _encoders:
        _encoders.clear()
        _encoders[mark] = Encoder(data)
    return _encoders[mark]


def vocabulary(name: str, folder: str | None = None) -> bytes:
    """The file of a public tokenizer, a megabyte or two, read by the driver."""
    with open(tokenizer_path(name, folder), "rb") as f:
        return f.read()


def tokenizer_path(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("LODESTACK_TOKENIZERS", TOKENIZERS), f"{name}.tiktoken")


def encoded(docs: DataFrame, text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None, key: str = "doc_id", counts_only: bool = False) -> DataFrame:
    """(key, ids, offsets), or (key, n_tokens) with counts_only: a row for each row of docs.

    offsets has, for each id, the first character of the piece it belongs to. Null and empty texts have the empty list
    and 0 tokens. Texts of any length are encoded whole; strings of special tokens are ordinary text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(name, folder))
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        enc = encoder(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            for lo, hi in chunks(texts):
                ids, counts, offset, _ = enc.encode(texts[lo:hi])
                keys = batch["key"].slice(lo, hi - lo)
                if counts_only:
                    yield pa.record_batch([keys, pa.array(counts)], names=[key, "n_tokens"])
                    continue
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids, offset)]
                yield pa.record_batch([keys, *lists], names=[key, "ids", "offsets"])

    out = f"{key} {kind}, " + ("n_tokens bigint" if counts_only else "ids array<int>, offsets array<int>")
    return docs.selectExpr(f"{key} AS key", f"{text} AS text").mapInArrow(run, out)


def decoded_text(ids: list[int], name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """The text of a list of ids."""
    enc = encoder(vocabulary(name, folder))
    if not hasattr(enc, "bytes_of"):
        enc.bytes_of = {b: a for a, b in enc.ranks.items()}
    return b"".join(enc.bytes_of[i] for i in ids).decode("utf-8")
