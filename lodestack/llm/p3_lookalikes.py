"""Problem 3: visually identical text of different characters, brought to one form."""

from __future__ import annotations

import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, decoded_all, laid_out, written

# Letters that look like a Latin letter, after the confusable characters of Unicode TR 39: those of the
# alphabets that are written with Latin ones in everyday texts. Each line has the Latin letter and its look-alikes of the
# Cyrillic, Greek, Armenian and phonetic alphabets and the number forms. Letters of rarer scripts, styled mathematical
# letters and digits stay what they are: they are seen to differ.
LOOKALIKES = """
A А Α
B В Β
C С Ϲ Ⅽ
D Ⅾ
E Е Ε
G Ԍ
H Н Η
I І Ι Ӏ Ⅰ
J Ј Ϳ
K К Κ K
L Ⅼ
M М Μ Ⅿ
N Ν
O О Ο Օ
P Р Ρ
Q Ԛ
S Ѕ Տ
T Т Τ
V Ѵ Ⅴ
W Ԝ
X Х Χ Ⅹ
Y Ү Υ
Z Ζ
a а ɑ α
c с ϲ ⅽ
d ԁ ⅾ
e е
g ɡ ց
h һ հ
i і ⅰ ι
j ј ϳ
l ⅼ ӏ
m ⅿ
n ո
o о ο օ
p р ρ
q ԛ զ
s ѕ
u ս υ
v ѵ ν ⅴ
w ԝ
x х χ ⅹ
y у ү γ
z ᴢ
Å Å
Ω Ω
"""
# Spaces that look alike, and characters that can't be seen.
SPACES = " \u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufe0e\ufe0f\ufeff"
#: Kinds of compatibility that are a matter of width, of joined letters or of space, not of what is seen.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")

#: Rows of one form whose pairs are made in one task.
SPLIT = 1000

_LATIN = {other: line.split()[0] for line in LOOKALIKES.strip().splitlines() for other in line.split()[1:]}


def look(c: str) -> str:
    """What a character looks like: its decomposition, as far as only width, kind of space, joined letters and the
    storage of accents are undone, of Latin letters where there are such; nothing for what can't be seen."""
    if c in INVISIBLE:
        return ""
    if c in SPACES:
        return " "
    kind, _, rest = unicodedata.decomposition(c).partition(" ")
    joined = kind == "<compat>" and "LIGATURE" in unicodedata.name(c, "")
    if kind in SAME_LOOK or joined:
        return "".join(look(chr(int(x, 16))) for x in rest.split())
    return "".join(_LATIN.get(x, x) for x in unicodedata.normalize("NFD", c))


def skeleton_is_ascii(c: str) -> bool:
    """Whether a character beyond ASCII only looks like some of ASCII or like nothing."""
    return look(c).isascii()


class Lookalikes:
    """The classes of strings and code points of a corpus that look alike, and the rewriting of each to one of them.

    Every code point is joined with the string it looks like, and every string of a letter and an accent with what that
    looks like; joining is transitive. A class is represented by its most frequent member (a string counts as often as
    its rarest character, one with accents stored apart last; of equals, the lesser), so that texts keep their usual form.
    """

    def __init__(self, counts: dict[int, int]):
        freq = {chr(p): n for p, n in counts.items() if not 0xD800 <= p < 0xE000}
        self.parent: dict[str, str] = {}
        marks = [c for c in freq if unicodedata.combining(c)]
        for c in freq:
            self._join(c, look(c))
            if c.isalpha():
                for m in marks:
                    whole = "".join(map(look, c + m))
                    if len(joined := unicodedata.normalize("NFC", whole)) < len(whole):
                        self._join(c + m, joined)
        for c in [c for c in self.parent if len(c) == 1 and c not in freq]:
            freq[c] = 0
        groups: dict[str, list[str]] = {}
        for s in self.parent:
            groups.setdefault(self._root(s), []).append(s)
        self.rewrite: dict[str, str] = {}
        for group in groups.values():
            often = {s: 0 if any(map(unicodedata.combining, s)) else min((freq.get(c, 0) for c in s), default=1 << 62) for s in group}
            best = min(group, key=lambda s: (-often[s], len(s), s))
            self.rewrite |= {s: best for s in group if s != best and s}
        self.invisible = {ord(s): None for s, r in self.rewrite.items() if not r and len(s) == 1}
        self.ascii_moves = any(s.isascii() for s in self.rewrite)
        # what texts are looked through for: points that are rewritten by themselves, and marks that may make up a pattern
        self.points = {ord(s): r for s, r in self.rewrite.items() if len(s) == 1}
        self.marks = {ord(s[-1]) for s in self.rewrite if len(s) > 1}
        self.automaton = ahocorasick.Automaton()
        for s, r in self.rewrite.items():
            self.automaton.add_word(s, (len(s), r))
        if self.rewrite:
            self.automaton.make_automaton()

    def _root(self, s: str) -> str:
        while self.parent.setdefault(s, s) != s:
            self.parent[s] = self.parent[self.parent[s]]
            s = self.parent[s]
        return s

    def _join(self, a: str, b: str) -> None:
        self.parent[self._root(a)] = self._root(b)

    def form(self, text: str) -> str:
        """The text in its one consistent form: the longest pattern at each place is replaced, from left to right, once
        what can't be seen is gone; space at the ends is dropped."""
        if not self.rewrite or text.isascii() and not self.ascii_moves:
            return text.strip()
        if self.invisible:
            text = text.translate(self.invisible)
        at, parts = 0, []
        for end, (n, r) in self.automaton.iter_long(text):
            parts += (text[at : end + 1 - n], r)
            at = end + 1
        return ("".join(parts) + text[at:]).strip() if parts else text.strip()

    def forms(self, texts: list[str]) -> list[str]:
        """`form` of each text. Which texts hold a point that is rewritten, or a mark of a pattern of several, is read off
        arrays; the automaton runs over those with such a mark only, points by themselves are exchanged at once."""
        if not self.rewrite:
            return [t.strip() for t in texts]
        if not hasattr(self, "_class"):
            self._class = np.zeros(0x110000, np.int8)
            self._class[list(self.points)] = 1
            self._class[[m for m in self.marks]] = 2
        out = []
        for lo, hi in chunks(texts):
            points, begins, _ = laid_out(texts[lo:hi])
            most = np.maximum.reduceat(self._class[points], begins)
            for t, k in zip(texts[lo:hi], most.tolist()):
                out.append(self.form(t) if k == 2 else t.translate(self.points).strip() if k else t.strip())
        return out


def point_counts(*texts: DataFrame) -> DataFrame:
    """(point, n): how often each code point occurs in (text, compression) of the tables. At most as many rows as Unicode
    has code points, whatever the size of the corpus."""

    def run(batches):
        for batch in batches:
            own = [t for t in decoded_all(batch["text"].to_pylist(), batch["compression"].to_pylist()) if t]
            total = np.zeros(0x110000, np.int64)
            for lo, hi in chunks(own):
                points, _, _ = laid_out(own[lo:hi])
                n = np.bincount(points)
                total[: len(n)] += n
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["point", "n"])

    parts = [t.select("text", "compression").where("text IS NOT NULL").mapInArrow(run, "point bigint, n bigint") for t in texts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("point").agg(F.sum("n").alias("n"))


def lookalikes(*texts: DataFrame) -> Lookalikes:
    return Lookalikes({r.point: r.n for r in point_counts(*texts).toLocalIterator()})


def consistent(df: DataFrame, looks: Lookalikes, keep: list[str], as_prints: bool = False) -> DataFrame:
    """keep, text and form of (keep..., text, compression): the text after undoing its compression and its consistent form.

    Null texts give null. With as_prints, 128-bit prints stand for both, so that long texts need not be shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(looks)
    kinds = [(c, df.schema[c].dataType.simpleString()) for c in keep]
    out = "binary" if as_prints else "string"

    def run(batches):
        import xxhash

        own = shared.value
        for batch in batches:
            texts = decoded_all(batch["text"].to_pylist(), batch["compression"].to_pylist())
            there = own.forms([t for t in texts if t is not None])
            of = iter(there)
            forms = [None if t is None else next(of) for t in texts]
            if as_prints:
                texts, forms = ([None if t is None else xxhash.xxh3_128_digest(t.encode("utf-8")) for t in x] for x in (texts, forms))
            kind = pa.binary() if as_prints else pa.string()
            yield pa.record_batch([*(batch[c] for c in keep), pa.array(texts, kind), pa.array(forms, kind)], names=[*keep, "text", "form"])

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds) + f", text {out}, form {out}"
    return df.select(*keep, "text", "compression").mapInArrow(run, schema)


def same_look(forms: DataFrame, within: str, key: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: entries of one `within` whose texts differ but have the same form.

    forms: (within, key, text, form). Null texts and null `within` are in no pair; a repeated row counts once. Only the
    rows of forms that hold different texts, found by one aggregation, are joined.
    """
    rows = forms.where(F.col("text").isNotNull() & F.col(within).isNotNull() & F.col(key).isNotNull())
    rows = rows.select(F.xxhash64(within, "form").alias("h"), F.xxhash64("text").alias("t"), within, key, "text", "form")
    rows = written(rows, "forms")
    mixed = rows.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    # a form of many rows is split: one side of the join by a hash of its key, the other side goes to all splits
    mixed = mixed.select("h", F.ceil(F.col("n") / SPLIT).cast("int").alias("splits"))
    few = written(rows.join(mixed, "h").distinct(), "same-look")
    a, b = (few.select("h", "splits", *(F.col(c).alias(f"{s}_{i}") for i, c in enumerate((within, key, "text", "form")))) for s in "ab")
    a = a.withColumn("split", F.pmod(F.xxhash64("a_1"), F.col("splits")).cast("int"))
    b = b.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("splits")
    same = (F.col("a_0") == F.col("b_0")) & (F.col("a_3") == F.col("b_3")) & (F.col("a_2") != F.col("b_2"))
    pairs = a.join(b, ["h", "split"]).where(same & (F.col("a_1") < F.col("b_1")))
    return pairs.select(F.col("a_1").alias("id_a"), F.col("b_1").alias("id_b")).distinct()
