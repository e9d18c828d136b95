"""Problem 4: text decoded with the wrong character encoding, found by corpus statistics of adjacent characters."""

from __future__ import annotations

import codecs
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, decoded_all, laid_out
from .p3_lookalikes import skeleton_is_ascii

#: What a pair must exceed, as a share of all records, to count. The pairs that do are at most (pairs of a record) /
#: LEAST_SHARE.
LEAST_SHARE = 1e-4
#: A pair of a lower strength is improbable. Gain of an improbable pair and price of any other in a run's score.
STRONG, GAIN, PRICE = 8.0, 6, 1
#: How much stronger, on average over its pairs, restored text must be than what it replaces; strength it must reach.
BETTER, ENOUGH = 2.0, 5.0
#: Words whose originals a worker keeps; when full, it starts anew.
CACHE = 200_000

# Encodings that text is wrongly read with, and those it may have been written in.
WRONG = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp1250", "cp866")
CYRILLIC = ("cp1251", "koi8_r", "cp866")
LETTERS_HIGH = ("cp1251", "koi8_r", "cp1250", "cp866")  # their letters are first bytes of UTF-8
RIGHT = {
    "cp1252": ("cp1251", "koi8_r", "cp866", "mac_roman", "cp850", "cp932", "euc_jp"),
    "latin-1": ("cp1251", "koi8_r", "cp866", "cp850", "cp932", "euc_jp"),
    "mac_roman": ("cp1252", "cp1251", "cp932"),
    "cp437": ("cp1252", "cp866", "cp1251"),
    "cp850": ("cp1252", "cp866", "cp1251"),
    "cp1251": ("koi8_r", "cp866", "cp1252", "cp932"),
    "koi8_r": ("cp1251", "cp866", "cp1252"),
    "cp1250": ("cp1252",),
    "cp866": ("cp1251", "koi8_r", "cp1252"),
}
# Words after which a run on its own is spoken of, not read.
QUOTING = ("sequence", "character", "characters", "string", "bytes", "letters", "symbol", "symbols", "zeichenfolge", "zeichen", "séquence", "caractère", "caractères", "secuencia", "carácter", "caracteres", "последовательность", "символ", "символы", "文字列", "文字")


def _byte_table(wrong: str) -> dict[str, int]:
    """The byte of each character of an encoding; bytes it leaves undefined are read as the control of the same number."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(wrong)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


_BYTES = {w: _byte_table(w) for w in WRONG}


def _class(wrong: str, lo: int, hi: int) -> str:
    own = _BYTES[wrong]
    return "[" + "".join(re.escape(c) for c, b in own.items() if lo <= b <= hi and ord(c) > 127) + "]"


def _utf8_pattern(wrong: str) -> re.Pattern:
    more = _class(wrong, 0x80, 0xBF)
    return re.compile("(?:" + "|".join(f"{_class(wrong, lo, hi)}{more}{{{k}}}" for lo, hi, k in ((0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3))) + ")+")


_UTF8 = {w: _utf8_pattern(w) for w in WRONG}


def reread(text: str, wrong: str, right: str) -> str | None:
    """The text as it is read in `right` if it was read in `wrong`; None if it can't have been."""
    own = _BYTES[wrong]
    try:
        return codecs.decode(bytes(own[c] for c in text), right)
    except (KeyError, UnicodeDecodeError):
        return None


_ODD = re.compile("[ÃÂâÐÑãåäçèéæï√‚├Γ╨╤][^\\x00-\\x7f]")


def reread_all(text: str) -> str:
    """The text with all its sequences that read as UTF-8 by their bytes in one of the commonest WRONG encodings read so."""
    if not _ODD.search(text):
        return text
    for wrong in ("cp1252", "latin-1", "mac_roman", "cp437"):
        if _UTF8[wrong].search(text):
            return _UTF8[wrong].sub(lambda m: reread(m.group(), wrong, "utf-8") or m.group(), text)  # noqa: B023
    return text


_byte_arrays: dict[str, np.ndarray] = {}


def _byte_array(wrong: str) -> np.ndarray:
    """The byte of each code point beyond ASCII in an encoding, 0 for those it hasn't."""
    if wrong not in _byte_arrays:
        out = np.zeros(0x110000, np.uint8)
        for c, b in _BYTES[wrong].items():
            if ord(c) > 127:
                out[ord(c)] = b
        _byte_arrays[wrong] = out
    return _byte_arrays[wrong]


def misread(points: np.ndarray) -> np.ndarray:
    """Whether each character is a replacement character or stands in a sequence that reads as UTF-8 by its bytes in a
    WRONG encoding; of Cyrillic encodings, whose sound words have such sequences, in two of them in a row at least."""
    at = np.flatnonzero(points > 127)
    own, n = points[at], len(at)
    joined = np.zeros(n + 4, bool)  # the next character beyond ASCII is the next of the text
    joined[: max(0, n - 1)] = at[1:] == at[:-1] + 1
    bad = own == 0xFFFD
    for wrong in WRONG:
        b = _byte_array(wrong)[own]
        if not (b >= 0xC2).any():
            continue
        more = np.zeros(n + 5, bool)
        more[:n] = (b >= 0x80) & (b < 0xC0)
        one = joined & more[1:]
        two = one[:-1] & one[1:]
        three = two[:-1] & one[2:]
        begins = [np.flatnonzero((b >= lo) & (b < hi) & more_[:n]) for lo, hi, more_ in ((0xC2, 0xE0, one), (0xE0, 0xF0, two), (0xF0, 0xF5, three))]
        if wrong in CYRILLIC:
            first, kept = np.zeros(n + 5, bool), np.zeros(n + 5, bool)
            first[np.concatenate(begins)] = True
            for k, i in enumerate(begins, 2):
                i = i[joined[i + k - 1] & first[i + k]]
                kept[i] = kept[i + k] = True
            begins = [i[kept[i]] for i in begins]
        for k, i in enumerate(begins, 2):
            for d in range(k):
                bad[i + d] = True
    out = np.zeros(len(points), bool)
    out[at] = bad
    return out


def pair_counts(docs: DataFrame, key: str = "input_id") -> DataFrame:
    """(pair, docs) of every pair of adjacent characters of which one is not ASCII: in how many contents it occurs. A pair
    is the left code point times 2**21 plus the right one. Counts are combined per batch before they are shuffled.

    A pair with a misread character is no evidence: however many records are wrongly decoded alike, theirs stay weak."""

    def run(batches):
        for batch in batches:
            texts = [t for t in decoded_all(batch["content"].to_pylist(), batch["compression"].to_pylist()) if t and not t.isascii()]
            for lo, hi in chunks(texts):
                points, _, ends = laid_out(texts[lo:hi])
                at, keys = _pairs(points)
                odd = misread(points)
                sound = ~(odd[at] | odd[at + 1])
                at, keys = at[sound], keys[sound]
                doc = np.searchsorted(ends, at).astype(np.uint64)
                keys, doc = _unique_by(keys, doc)
                got, n = np.unique(keys, return_counts=True)
                yield pa.record_batch([pa.array(got.astype(np.int64)), pa.array(n)], names=["pair", "docs"])

    part = docs.select("content", "compression").where("content IS NOT NULL").mapInArrow(run, "pair bigint, docs bigint")
    return part.groupBy("pair").agg(F.sum("docs").alias("docs"))


def _pairs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pairs with a character beyond ASCII begin, and the pairs. Line ends are blanks here."""
    points = np.where(points == 10, 32, points)
    high = points > 127
    at = np.flatnonzero(high[:-1] | high[1:])
    return at, (points[at].astype(np.uint64) << np.uint64(21)) | points[at + 1].astype(np.uint64)


def _unique_by(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((doc << np.uint64(42)) | keys)
    return both & np.uint64((1 << 42) - 1), both >> np.uint64(42)


class PairModel:
    """Strength of a pair: log2 of its part of the corpus's mutual information between left and right character, for
    10,000 records; a pair counts a bit at least, however common its characters are. Of its records only those count that
    are surely more than LEAST_SHARE of all, so that strength rises from 0 without a step, in collections of any size."""

    def __init__(self, pairs: np.ndarray, docs: np.ndarray, n_docs: int):
        sure = docs - np.sqrt(3.0 * docs) - LEAST_SHARE * n_docs
        pairs, sure = pairs[sure > 0], sure[sure > 0]
        order = np.argsort(pairs)
        self.pairs = pairs[order].astype(np.int64)
        self.fixed: dict[str, str | None] = {}
        n = sure[order].astype(float)
        total = max(1.0, n.sum())
        left, right = self.pairs >> 21, self.pairs & ((1 << 21) - 1)
        by_left = np.bincount(left, weights=n, minlength=1) if len(left) else np.zeros(1)
        by_right = np.bincount(right, weights=n, minlength=1) if len(right) else np.zeros(1)
        info = np.log2(n * total / (by_left[left] * by_right[right])) if len(left) else n
        self.strength = np.log2(1 + n * np.maximum(1, info) * 10_000 / max(1, n_docs)).astype(np.float32)

    @classmethod
    def of(cls, docs: DataFrame) -> PairModel:
        n = docs.where("content IS NOT NULL").count()
        rows = pair_counts(docs).where(F.col("docs") - F.sqrt(3 * F.col("docs")) > LEAST_SHARE * n).toPandas()
        return cls(rows["pair"].to_numpy(np.int64), rows["docs"].to_numpy(np.int64), n)

    def of_pairs(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(self.pairs, keys.astype(np.int64)), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys.astype(np.int64), self.strength[at], 0)

    def met(self, before: str, c: str, after: str) -> bool:
        """Whether a character is met in the corpus next to either of its neighbours."""
        points = np.frombuffer(f"{before or ' '}{c}{after or ' '}".encode("utf-32-le", "surrogatepass"), np.uint32)
        return bool(self.of_pairs(_pairs(points)[1]).max(initial=0) > 0)

    def of_word(self, word: str) -> tuple[float, float]:
        """Mean and least strength of the pairs beyond ASCII of a word between blanks; of none, that of a strong pair."""
        points = np.frombuffer(f" {word} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        own = self.of_pairs(_pairs(points)[1])
        return (float(own.mean()), float(own.min())) if len(own) else (STRONG, STRONG)


def best_segments(at: list[int]) -> list[tuple[int, int]]:
    """The maximum-scoring segments of a row of characters: improbable pairs at `at` gain, all others cost.

    With every gain alike, two neighbouring segments join exactly where the gap between them costs less than either
    scores.
    """
    out: list[list[int]] = []  # begin, end, score
    for i in at:
        own = [i, i + 1, GAIN]
        while out and (gap := (own[0] - out[-1][1]) * PRICE) < min(own[2], out[-1][2]):
            last = out.pop()
            own = [last[0], own[1], last[2] + own[2] - max(0, gap)]
        out.append(own)
    return [(a, b) for a, b, _ in out]


def _quoted(text: str, a: int, b: int) -> bool:
    """Whether a piece stands on its own and the words before it say that it is spoken of."""
    before, after = text[max(0, a - 40) : a], text[b : b + 1]
    if before[-1:] in "(\"'“”„«‘[" and before and after in ")\"'“”»’]" and after:
        return True
    if (before and not before[-1].isspace()) or (after and not after.isspace() and after not in ".,;:!?"):
        return False
    words = before.split()
    return bool(words) and words[-1].lower().strip(":,") in QUOTING


def broken_places(text: str, runs: list[tuple[int, int]], model: PairModel) -> list[tuple[int, int, str | None]]:
    """(begin, end, original or None) of the wrongly decoded places of a text, looked for in the words of its improbable
    runs. A replacement character in a word can't be restored. An inverse mapping between two encodings of single bytes
    is believed only if it restores two different words of the text."""
    out: list[tuple[int, int, str | None]] = []
    bytewise: dict[tuple[str, str], list[tuple[int, int, str]]] = {}
    upto = 0
    for a, b in runs:
        a, b = max(upto, a), min(len(text), b + 1)
        while a > upto and text[a - 1] not in " \t\n\r":
            a -= 1
        while b < len(text) and text[b] not in " \t\n\r":
            b += 1
        upto = max(upto, b)
        for word in _WORD.finditer(text, a, b):
            w, at = word.group(), word.start()
            if w.isascii():
                continue
            if "\ufffd" in w:
                out += [(at + m.start(), at + m.end(), None) for m in _LOST.finditer(w) if not _quoted(text, at + m.start(), at + m.end())]
                continue
            for mapping, fixed in _restored(w, model):
                if mapping[1] != "utf-8":
                    bytewise.setdefault(mapping, []).append((at, at + len(w), fixed))
                elif not _quoted(text, at, at + len(w)):
                    out.append((at, at + len(w), fixed))
    best = max(bytewise.values(), key=lambda v: len({x for *_, x in v}), default=[])
    if len({x for *_, x in best}) >= 2:
        out += best
    return sorted(out, key=lambda x: x[:2])


_WORD, _LOST = re.compile(r"[^ \t\n\r]+"), re.compile("\ufffd+")


def _restored(word: str, model: PairModel) -> list[tuple[tuple[str, str], str]]:
    """What the word may have been before it was wrongly decoded, by (wrong, right) encoding: the likeliest reading as
    UTF-8, else, or where that is unlikely, all that are much likelier than the word."""
    got = model.fixed.get(word)
    if got is not None:
        return got
    if len(model.fixed) >= CACHE:
        model.fixed.clear()
    raw = model.of_word(word)
    best, got = raw[0] - 1, []
    for wrong in WRONG:
        at, parts = 0, []
        for m in _UTF8[wrong].finditer(word):
            if wrong in LETTERS_HIGH and len(m.group()) < 4 and any(c.isspace() or unicodedata.category(c) == "Cf" for c in m.group()):
                continue  # a capital before a hard blank or soft hyphen
            if (x := reread(m.group(), wrong, "utf-8")) and _readable(x) and (len(x) > 1 or model.met(word[m.start() - 1 : m.start()], x, word[m.end() : m.end() + 1])):
                parts += [word[at : m.start()], x]
                at = m.end()
        least = best if wrong not in LETTERS_HIGH else max(best, raw[0] + BETTER)
        if parts and (mean := model.of_word(fixed := "".join(parts) + word[at:])[0]) > least:
            best, got = mean, [((wrong, "utf-8"), fixed)]
    if not got or best < ENOUGH:
        got = _bytewise(word, raw[0], model) or got
    model.fixed[word] = got
    return got


def _readable(fixed: str) -> bool:
    """Whether restored text has neither controls nor private or unassigned characters."""
    return all(unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs") for c in fixed)


def _bytewise(word: str, raw: float, model: PairModel) -> list[tuple[tuple[str, str], str]]:
    out = []
    high = [c for c in word if ord(c) > 127]
    if raw >= STRONG or sum(map(str.isalpha, word)) < 2 or all(skeleton_is_ascii(c) for c in high):
        return out
    for wrong, rights in RIGHT.items():
        own = _BYTES[wrong]
        if any(c not in own for c in high):
            continue
        for right in rights:
            if (fixed := reread(word, wrong, right)) is None or fixed.isascii() or not _readable(fixed):
                continue
            mean, least = model.of_word(fixed)
            if mean >= raw + BETTER and least >= ENOUGH:
                out.append(((wrong, right), fixed))
    return out


def improbable(docs: DataFrame, model: PairModel, restore: bool = False) -> DataFrame:
    """(input_id, places, restorable, content): each record whose content was wrongly decoded in at least one place, in
    how many, in how many of them the original is known, and, with restore, the content with these originals.

    Null and pure ASCII contents are sound. A repeated row of an input_id gives a repeated row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            ids = batch["input_id"].to_pylist()
            all_ = decoded_all(batch["content"].to_pylist(), batch["compression"].to_pylist())
            ids, texts = [i for i, t in zip(ids, all_) if t and not t.isascii()], [t for t in all_ if t and not t.isascii()]
            rows: list[tuple] = []
            for lo, hi in chunks(texts):
                points, begins, ends = laid_out(texts[lo:hi])
                at, keys = _pairs(points)
                at = at[own.of_pairs(keys) < STRONG]
                at = at[(points[at] > 127) | (points[np.minimum(at + 1, len(points) - 1)] > 127)]
                cut = np.searchsorted(at, begins).tolist() + [len(at)]
                for k in range(hi - lo):
                    weak = (at[cut[k] : cut[k + 1]] - begins[k]).tolist()
                    weak = [w for w in weak if w < len(texts[lo + k])]
                    if not weak:
                        continue
                    places = broken_places(texts[lo + k], best_segments(weak), own)
                    if places:
                        rows.append((ids[lo + k], len(places), sum(x is not None for *_, x in places), restored(texts[lo + k], places, own) if restore else None))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["input_id", "places", "restorable", "content"])

    return docs.select("input_id", "content", "compression").where("content IS NOT NULL").mapInArrow(run, "input_id bigint, places int, restorable int, content string")


def restored(text: str, places: list[tuple[int, int, str | None]], model: PairModel) -> str:
    """The text with the originals of its places; text that was wrongly decoded more than once is restored again."""
    at, parts = 0, []
    for a, b, x in places:
        if x is None or a < at:
            continue
        for _ in range(3):
            again = next((f for m, f in _restored(x, model) if m[1] == "utf-8"), None)
            if again is None:
                break
            x = again
        parts += [text[at:a], x]
        at = b
    return "".join(parts) + text[at:]
