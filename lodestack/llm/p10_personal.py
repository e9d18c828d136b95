"""Problem 10: personal information in free text.

Numbers, addresses of mail and of streets are found by their forms. Whether a word is part of a name is decided by how
many bits it discloses of a person, by its co-occurrence, over the whole corpus, with words that stand where given names
stand and with addresses of mail. Words that disclose a person without being part of a found piece are taken out of the
clean text as well.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PointTable, _grown, chunks, laid_out, mixed, written

#: Bits that a word must disclose of a person to count as a surname; at most so many of them by its place alone, since a
#: fixed phrase has that as well, and by the variety before it and addresses alone, since common nouns have these.
DISCLOSURE, PLACE, VARIETY = 7.1, 5.6, 2.0
#: Shares of the words of running text that stand where a surname stands, and that are held by addresses of mail: what a
#: word must exceed. They are fixed, so that texts full of names don't hide them.
SLOTS, MAILS = 0.01, 0.001
#: Surnames with the same ending of ENDING letters that make the ending one of surnames; different surnames behind a word
#: that make it a given name.
ENDING, ALIKE, BEHIND = 4, 3, 3
#: A term that stands with one person in this share of its occurrences, and in so many records at least, discloses them.
REVEALING, RECORDS = 0.5, 3
#: Bits by which it must stand with them more often than chance.
TERM_BITS = 3.0
#: Words that are broadcast at most (8 bytes each); beyond, they are joined to the records by a shuffle.
BROADCAST_WORDS = 2_000_000

_DASH = "[-‐‑‒–]"
_SEP = r"(?:[ .\xa0/]|[-‐‑‒–])"
# Forms of addresses, numbers and streets.
EMAIL = re.compile(
    r"(?<![\w.+-])[^\W_][\w.+-]*(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?|\sat\s)"
    r"(?:[^\W_][\w-]*(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s))+[^\W\d_]{2,}(?![\w@])", re.I,
)
PHONE = re.compile(
    rf"(?<![\w+#/.-])(?<!\d:)(?:"
    rf"(?:\+|00)[1-9]\d{{0,2}}{_SEP}?(?:\(0?\d{{1,4}}\)|\d{{1,5}})(?:{_SEP}?\d{{2,5}}){{1,5}}"
    rf"|1{_DASH}\d{{3}}{_DASH}\d{{3}}{_DASH}\d{{4}}"
    rf"|(?:\(\d{{3}}\) ?|\d{{3}}[. ]|\d{{3}}{_DASH})\d{{3}}[-‐‑. ]\d{{4}}"
    rf"|0[1-9](?:[ .\xa0]\d\d){{4}}"
    rf"|0\d{{2,4}}/\d{{5,9}}|0\d{{2,4}}[ /\xa0]\d{{3,5}}(?:[ \xa0]\d{{3,4}})?"
    rf"|[679]\d\d(?:[ \xa0]?\d{{3}}){{2}}|[679]\d\d(?:[ \xa0]\d\d){{3}}"
    rf")(?![\w/]|[-‐‑.:]\d)"
)
IDENTITY = re.compile(
    rf"(?<![\w#/.-])(?<!\d:)(?:\d{{3}}({_DASH}|[ \xa0])\d\d\1\d{{4}}|[A-Z]{{2}}[ \xa0]?\d\d[ \xa0]?\d\d[ \xa0]?\d\d[ \xa0]?[A-D]|\d{{8}}{_DASH}?[A-Z]"
    rf"|\d{{3}} ?{_DASH} ?\d{{7}} ?{_DASH} ?\d|[A-Z]{{2}}\d{{7}})(?![\w/]|[-‐‑.:]\d)"
)
_NAME = r"[A-ZÀ-ÖØ-Þ][\w’'-]*"
ADDRESS = re.compile(
    rf"(?<![\w.,#-])\d{{1,4}} ?[a-zA-Z]?\b,?\s{{1,2}}(?:{_NAME}\s{{1,2}}){{1,3}}(?:Street|Road|Lane|Row|Square|Terrace|Close|Avenue|Ave|Drive|Way|Court|Place|Gardens|Crescent|Hill|Park|Walk|Mews|St|Rd|Dr|Ln|Blvd|Boulevard)\b(?! View)"
    rf"|\b[A-ZÄÖÜ][\wäöüß-]+?(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring)\s\d{{1,4}}[a-z]?\b(?![.,]\d)"
    rf"|(?<![\w.,#-])\d{{1,4}} ?(?:[a-z]|bis|ter)?\b,?\s(?:rue|avenue|boulevard|place|chemin|allée|quai|impasse|route|cours)\s(?:(?:de la|des|du|de|aux)\s|de l[’']|d[’'])?{_NAME}"
    rf"|\b(?:Calle|Avenida|Plaza|Paseo|Camino|Carretera|C/|Via|Viale|Piazza)\s(?:(?:de la|de los|de las|del|de|della|dei)\s)?{_NAME}(?:\s{_NAME})?,?\s\d{{1,4}}[a-z]?\b"
    rf"|\b(?:ул\.|улица|проспект|пр\.|переулок)\s[А-ЯЁ][\w-]+(?:\s[А-ЯЁ][\w-]+)?,?\s(?:д\.\s?)?\d{{1,4}} ?[а-я]?\b"
)
# Words before or after a number that say it is none of a person's.
NO_NUMBER_BEFORE = re.compile(r"(?:offset|size|checksum|commit|isbn|issn|doi|build|version|ticket|run|total|length|segment|score|page|bytes|port|sha\d*|md5|rev|revision|#)[ :=.]*$", re.I)
NO_NUMBER_AFTER = re.compile(r"\s*(?:bytes|in segment|kb|mb|ms|%)", re.I)
# Titles and other words with a capital that are no given name.
NO_GIVEN = frozenset("""
dr mr mrs ms miss prof sir herr frau fräulein doktor professor m mme mlle monsieur madame sr sra srta don doña señor señora г-н г-жа dott ing
the a an and or by to from with for of in on at this that our their every each another present excused signed according dear hello hi thanks colleague
der die das ein eine kein unser jeder dieser und oder von für mit an laut gemäß kollege kollegin liebe lieber hallo danke
le la les un une des et ou de par pour avec selon cette chaque notre merci bonjour cher chère
el los las una y o por para con según gracias hola querido querida cada nuestra este
и или от для с по этот каждый любой наш весь спасибо привет
phone tel mobil fax name owner author reporter from reply-to subject date host storm ferry package
""".split())

_TOKEN = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*")
_HINT = re.compile("Street|Road|Lane|Row|Square|Terrace|Close|Ave|Drive|Way|Court|Place|Gardens|Crescent|Hill|Park|Walk|Mews|St\\b|Rd|Dr|Ln|Blvd|Boulevard|straße|strasse|str\\.|weg|gasse|platz|allee|ufer|damm|ring\\s|rue\\s|avenue|boulevard|place\\s|chemin|allée|quai|impasse|route|cours\\s|Calle|Avenida|Plaza|Paseo|Camino|Carretera|C/|Via|Piazza|ул|пр|переулок")
_DIGITS = re.compile(r"\d+")
#: Characters around a number in which its street is looked for; of streets whose names are longer still, the end counts.
STREET = 160


def plain(word: str) -> str:
    """A word in small letters without accents."""
    return word.lower() if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def found_form(piece: str) -> str:
    return "".join(c for c in piece.lower() if c.isalnum())


_LOCAL = re.compile(r"[\w.+-]")


def _emails(text: str):
    """Addresses of mail: looked for where an @, or an "at" between blanks or in brackets, has a name before it."""
    anchors = [m.start() for m in re.finditer("@", text)] if "@" in text else []
    low = text.lower() if "dot" in text or "DOT" in text or "Dot" in text or "at]" in text or "at)" in text or " at " in text else ""
    at = low.find("at")
    while at >= 0:
        if at and low[at - 1] in " \t\n\xa0[({" and low[at + 2 : at + 3] in (" ", "\t", "\n", "\xa0", "]", ")", "}"):
            anchors.append(at)
        at = low.find("at", at + 2)
    upto = 0
    for at in sorted(anchors):
        k = at
        while k > upto and text[k - 1] in " \t\n\xa0[({":
            k -= 1
        begin = k
        while begin > upto and _LOCAL.match(text[begin - 1]):
            begin -= 1
        if begin < k and (m := EMAIL.match(text, begin)) and m.end() > at:
            yield m
            upto = m.end()


def _windows(spans: list[tuple[int, int]], around: int, end: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in spans:
        a, b = max(0, a - around), min(end, b + around)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def numbers_and_addresses(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of what is found by its form, from left to right; of two that overlap the first kind counts."""
    out = [(*m.span(), "email") for m in _emails(text)]
    runs = [m.span() for m in _DIGITS.finditer(text)]
    if not runs:
        return out
    rest = _masked(text, out, "@") if out else text
    taken = [x[:2] for x in out]

    def found(form: re.Pattern, windows: list[tuple[int, int]], kind: str) -> None:
        for lo, hi in windows:
            for m in form.finditer(rest, lo, hi):
                a, b = m.span()
                if any(a < y and x < b for x, y in taken):
                    continue
                if kind != "address":
                    if NO_NUMBER_BEFORE.search(text, max(0, a - 16), a) or NO_NUMBER_AFTER.match(text, b):
                        continue
                    if kind == "phone" and not 7 <= sum(map(str.isdigit, m.group())) <= 15:
                        continue
                taken.append((a, b))
                out.append((a, b, kind))

    short = _windows([(a, b) for a, b in runs if b - a <= 4], STREET, len(text))
    short = [w for w in short if _HINT.search(text, *w)]
    if short:
        found(ADDRESS, short, "address")
        rest = _masked(text, sorted(out), "@")
    # numbers whose digits, few characters apart, are as many as those of the shortest form
    groups: list[list[int]] = []
    for a, b in runs:
        if groups and a - groups[-1][1] <= 4:
            groups[-1][1] = b
            groups[-1][2] += b - a
        else:
            groups.append([a, b, b - a])
    long = [(a, b) for a, b, n in groups if n >= 6]
    if long:
        near = _windows(long, 8, len(text))
        found(IDENTITY, near, "id")
        rest = _masked(text, sorted(out), "@")
        found(PHONE, near, "phone")
    return sorted(out)


def _masked(text: str, spans: list[tuple[int, int, str]], mark: str = "0") -> str:
    parts, at = [], 0
    for a, b, _ in spans:
        parts += [text[at:a], mark * (b - a)]
        at = b
    return "".join(parts) + text[at:]


def _capital(w: str) -> bool:
    return w[0].isupper() and len(w) > 1


def _plain_point(c: str) -> int:
    own = [x for x in unicodedata.normalize("NFD", c.lower()) if not unicodedata.combining(x)]
    return ord(own[0]) if own else ord(c)


_alpha = PointTable(lambda c: c.isalpha())
_upper = PointTable(lambda c: c.isupper())
_plains = np.zeros(0x110000, np.uint32)


def _plain_points(points: np.ndarray) -> np.ndarray:
    """The points of small letters without accents; worked out when a point is first met."""
    got = _plains[points]
    if not got.all():
        for p in np.unique(points[got == 0]).tolist():
            _plains[p] = _plain_point(chr(p)) or 1
        got = _plains[points]
    return got.astype(np.uint64)


class Words:
    """The words of texts laid out in arrays: begin and end in their texts, row of the text; print of each in small letters
    without accents, and of its last ENDING letters (0 of a word that is hardly longer); whether it begins with a capital,
    is none of a person's given names, and the print of the capital word or initial right before it (0 if there is none)."""

    def __init__(self, texts: list[str], spans: list[list[tuple[int, int, str]]]):
        points, begins, ends = laid_out(texts)
        points = points.copy()
        for a0, own in zip(begins.tolist(), spans):
            for a, b, _ in own:
                points[a0 + a : a0 + b] = 48
        letter = _alpha.of(points) == 1
        quote = np.flatnonzero((points == 39) | (points == 0x2019))
        quote = quote[(quote > 0) & (quote < len(points) - 1)]
        letter[quote[letter[quote - 1] & letter[quote + 1]]] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], letter.view(np.int8), [0]))))
        b, e = edge[0::2], edge[1::2]
        power, inverse = _grown(len(points) + 1)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mixed(_plain_points(points) + np.uint64(1)) * power[: len(points)], out=total[1:])
        part = lambda x, y: mixed((total[y] - total[x]) * inverse[x]).view(np.int64)
        self.row = np.searchsorted(ends, b)
        self.begin, self.end = b - begins[self.row], e - begins[self.row]
        self.print, size = part(b, e), e - b
        self.size = size
        self.ending = np.where(size > ENDING + 1, part(np.maximum(e - ENDING, b), e), 0)
        self.capital = _upper.of(points[b]) == 1
        self.no_given = np.isin(self.print, _no_given())
        self.before = np.zeros(len(b), np.int64)
        if len(b) > 1:
            gap = b[1:] - e[:-1]
            first, second = points[np.minimum(e[:-1], len(points) - 1)], points[np.minimum(e[:-1] + 1, len(points) - 1)]
            blank = (first == 32) | (first == 160)
            near = (gap == 1) & (blank | (first == 45)) | (gap == 2) & ((first == 32) & (second == 32) | (first == 46) & (second == 32) & (size[:-1] == 1))
            near &= (self.row[1:] == self.row[:-1]) & self.capital[:-1] & ~self.no_given[:-1]
            self.before[1:][near] = self.print[:-1][near]


_no_given_prints: list[np.ndarray] = []


def prints_of(words: list[str]) -> np.ndarray:
    """The prints of single words."""
    return Words(words, [[] for _ in words]).print if words else np.zeros(0, np.int64)


def _no_given() -> np.ndarray:
    if not _no_given_prints:
        _no_given_prints.append(np.zeros(0, np.int64))
        _no_given_prints[0] = np.unique(prints_of(sorted(w for w in NO_GIVEN if w.isalpha())))
    return _no_given_prints[0]


_STATISTICS = "word bigint, before bigint, ending bigint, size int, small bigint, capital bigint, mail bigint"


def statistics(docs: DataFrame) -> DataFrame:
    """(word, before, ending, size, small, capital, mail): counts of each word in small letters, with a capital (by the
    capital word before it, 0 for none), and inside addresses of mail. Counted per batch before anything is shuffled."""

    def run(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            for lo, hi in chunks(texts):
                own = texts[lo:hi]
                spans = [numbers_and_addresses(t) for t in own]
                w = Words(own, spans)
                ok = w.size >= 2
                word, before, cap = w.print[ok], np.where(w.capital, w.before, 0)[ok], w.capital[ok]
                key = np.stack([word, before], axis=1)
                _, at, back = np.unique(mixed(word.view(np.uint64) * np.uint64(3) + before.view(np.uint64)), return_index=True, return_inverse=True)
                n = len(at)
                caps, smalls = (np.bincount(back, weights=x, minlength=n).astype(np.int64) for x in (cap, ~cap))
                cols = [key[at, 0], key[at, 1], w.ending[ok][at], w.size[ok][at], smalls, caps, np.zeros(n, np.int64)]
                parts = [p for t, x in zip(own, spans) for p in _mail_parts(t, x)]
                if parts:
                    m, k = np.unique(prints_of(parts), return_counts=True)
                    z = np.zeros(len(m), np.int64)
                    cols = [np.concatenate(x) for x in zip(cols, [m, z, z, z, z, z, k])]
                kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3
                yield pa.record_batch([pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(cols, kinds)], names=["word", "before", "ending", "size", "small", "capital", "mail"])

    part = docs.select("text").where("text IS NOT NULL").mapInArrow(run, _STATISTICS)
    return part.groupBy("word", "before").agg(F.max("ending").alias("ending"), F.max("size").alias("size"), *(F.sum(c).alias(c) for c in ("small", "capital", "mail")))


def _mail_parts(text: str, spans: list[tuple[int, int, str]]) -> list[str]:
    """The words of the addresses' local parts, each once an address, and what is left of them behind an initial."""
    out = []
    for a, b, kind in spans:
        if kind == "email":
            own = set(re.findall(r"[^\W\d_]{4,}", plain(re.split(r"@|\s|\[|\(", text[a:b])[0])))
            out += sorted(own | {p[1:] for p in own if len(p) > 5})
    return out


def disclosures(counts: DataFrame) -> DataFrame:
    """(word, ending, bits, occurrences) of the words that stand behind a capital: the bits of a person each discloses.

    The sum of three: how much likelier than any word it stands where a surname stands, right behind a capital word or an
    initial, PLACE at most; how many bits its left neighbours differ by, which are many before a surname and the same before the second
    word of a fixed phrase; and, if addresses of mail hold it, how much likelier than any word it does so.
    """
    c = F.when(F.col("before") != 0, F.col("capital").cast("double")).otherwise(0.0)
    words = counts.groupBy("word").agg(
        F.max("ending").alias("ending"), F.max("size").alias("size"), F.sum(F.col("small") + F.col("capital")).alias("occurrences"), F.sum("mail").alias("mail"),
        F.sum(c).alias("pairs"), F.sum(F.when(c > 0, c * F.log2(c)).otherwise(0.0)).alias("x"),
    ).where("pairs > 0")
    pairs, occ = F.col("pairs"), F.col("occurrences")
    place = F.least(F.lit(PLACE), F.log2((pairs + 0.5) / (occ + 1) / F.lit(SLOTS)))
    varied = F.log2(pairs) - F.col("x") / pairs
    in_mail = F.when(F.col("mail") > 0, F.greatest(F.lit(0.0), F.log2(F.col("mail") / (F.col("mail") + occ) / F.lit(MAILS)))).otherwise(0.0)
    return words.select("word", "ending", "size", "occurrences", (place + F.least(F.lit(VARIETY), varied + in_mail)).alias("bits"))


class Names:
    """The words that, by the corpus, are surnames, endings of surnames and given names, as a table (word, what)."""

    def __init__(self, known: DataFrame, counts: DataFrame):
        self.known, self.counts = known, counts

    @classmethod
    def of(cls, docs: DataFrame) -> Names:
        counts = written(statistics(docs), "name-statistics")
        own = disclosures(counts).where((F.col("bits") >= DISCLOSURE) & (F.col("size") >= 2)).select("word", "ending", F.lit("surname").alias("what"))
        surnames = written(own, "surnames")
        ends = surnames.where("ending <> 0").groupBy("ending").agg(F.count("*").alias("n")).where(F.col("n") >= ALIKE).select(F.col("ending").alias("word"), F.lit("ending").alias("what"))
        first = counts.where("before <> 0 AND capital > 0").join(surnames.select("word"), "word", "left_semi").groupBy("before").agg(F.count("*").alias("n"))
        givens = first.where(F.col("n") >= BEHIND).select(F.col("before").alias("word"), F.lit("given").alias("what"))
        return cls(written(surnames.select("word", "what").unionByName(ends).unionByName(givens), "name-words"), counts)


class _Known:
    """What is known of the words of a batch."""

    def __init__(self, words: np.ndarray, whats: np.ndarray):
        self.surnames, self.endings, self.givens = (np.sort(words[whats == w]) for w in ("surname", "ending", "given"))
        self.terms = np.sort(words[whats == "term"])

    def flags(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        exact = np.isin(w.print, self.surnames) & (w.size >= 2)
        return exact, exact | np.isin(w.ending, self.endings) & (w.ending != 0), np.isin(w.print, self.givens) & (w.size > 2)


def names(text: str, tokens: list[tuple[int, int, bool, bool, bool, bool]]) -> list[tuple[int, int]]:
    """(begin, end) of each given name or initial with a surname. tokens: (begin, end, exact surname, surname or of an
    ending of surnames, given name, none of a person's given names) of each word."""
    out: list[tuple[int, int]] = []
    last = -1
    word = lambda i: text[tokens[i][0] : tokens[i][1]]

    def gap(i: int) -> str:
        return text[tokens[i][1] : tokens[i + 1][0]]

    def near(i: int) -> bool:
        """Whether the word after token i stands right behind it, or behind its full stop if it is an initial."""
        g = gap(i)
        return bool(_NEAR.fullmatch(g)) and (g.strip(" \xa0\n") != "." or tokens[i][1] - tokens[i][0] == 1)

    for i, (a, b, exact, surname, _, _) in enumerate(tokens):
        if i <= last or not surname:
            continue
        w = text[a:b]
        upper, caps = w[0].isupper(), w.isupper()
        j, k = i, i
        while k + 1 < len(tokens) and gap(k) == "-" and tokens[k + 1][3]:  # a double name
            k += 1
        while j and gap(j - 1) == "-" and j - 1 > last:
            j -= 1
        first = None
        p = j - 1
        if p > last and near(p):
            v = word(p)
            if len(v) == 1 and v.isupper() and gap(p).startswith("."):
                first = p
                q = p - 1
                if q > last and near(q) and len(word(q)) > 1 and word(q)[0].isupper() and not tokens[q][5] and "\n" not in gap(q):
                    first = q
            elif len(v) > 1 and not tokens[p][5] and (v[0].isupper() if upper else True) and (upper or v.islower()):
                first = p
                q = p - 1
                while q > last and gap(q) == "-" and word(q)[0].isupper():
                    first, q = q, q - 1
                if not upper and not tokens[p][4] and (len(v) < 3 or not exact):
                    first = None
        if first is not None:
            out.append((tokens[first][0], tokens[k][1]))
            last = k
        elif k + 1 < len(tokens) and re.fullmatch(r",[ \xa0]", gap(k)) and (caps or _begins(text, tokens[j][0])) and _capital(word(k + 1)) and not tokens[k + 1][5] and not (
            k + 2 < len(tokens) and near(k + 1) and tokens[k + 2][3] and word(k + 2)[0].isupper()
        ):
            out.append((tokens[j][0], tokens[k + 1][1]))
            last = k + 1
    return out


_NEAR = re.compile(r"[ \xa0]{1,2}|\.[ \xa0]{0,2}|[ \xa0]?\n[ \xa0]?")


def _begins(text: str, a: int) -> bool:
    return a == 0 or text[a - 1] == "\n"


def _found(texts: list[str], known: _Known) -> tuple[list[list[tuple[int, int, str]]], Words, np.ndarray]:
    """The pieces of each text, the words of all of them, and which of these are surnames by themselves."""
    spans = [numbers_and_addresses(t) for t in texts]
    w = Words(texts, spans)
    exact, surname, given = known.flags(w)
    cut = np.searchsorted(w.row, np.arange(len(texts) + 1))
    # only texts that hold a surname are looked at word by word
    for k in np.unique(w.row[surname]).tolist():
        at = slice(cut[k], cut[k + 1])
        tokens = list(zip(*(x[at].tolist() for x in (w.begin, w.end, exact, surname, given, w.no_given))))
        spans[k] = sorted(spans[k] + [(a, b, "name") for a, b in names(texts[k], tokens)])
    return spans, w, exact


def replaced(text: str, spans: list[tuple[int, int, str]], more: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder for each piece, and for each word of `more` outside them."""
    own = [x for x in more if not any(x[0] < b and a < x[1] for a, b, _ in spans)]
    parts, at = [], 0
    for a, b, kind in sorted(spans + own):
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(parts) + text[at:]


_KINDS = pa.list_(pa.struct([("kind", pa.string()), ("found", pa.string())]))


def _by_words(docs: DataFrame, known: DataFrame, run_with, schema: str) -> DataFrame:
    """Runs run_with(batch, what is known) over docs (key, text): words are broadcast if they are few enough, else joined
    to the records that hold them."""
    if known.count() <= BROADCAST_WORDS:
        got = known.toPandas()
        shared = docs.sparkSession.sparkContext.broadcast(_Known(got["word"].to_numpy(np.int64), got["what"].to_numpy(object)))

        def run(batches):
            for batch in batches:
                yield run_with(batch, shared.value)

        return docs.mapInArrow(run, schema)
    kind = docs.schema["key"].dataType.simpleString()

    def words(batches):
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            w = Words(texts, [[] for _ in texts])
            row, own = np.concatenate((w.row, w.row)), np.concatenate((w.print, w.ending))
            keep = np.unique(np.stack([row, own], axis=1), axis=0)
            yield pa.record_batch([batch["key"].take(pa.array(keep[:, 0])), pa.array(keep[:, 1])], names=["key", "word"])

    met = docs.select("key", "text").mapInArrow(words, f"key {kind}, word bigint").join(known, "word").groupBy("key").agg(F.collect_set(F.struct("word", "what")).alias("k"))
    rows = docs.join(met.select("key", F.col("k.word").alias("own_words"), F.col("k.what").alias("own_whats")), "key", "left")

    def joined(batches):
        for batch in batches:
            own, whats = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("own_words", "own_whats"))
            yield run_with(batch, _Known(own.astype(np.int64), whats))

    return rows.mapInArrow(joined, schema)


def personal(docs: DataFrame, known: Names, key: str = "doc_id", terms: DataFrame | None = None, clean: bool = True) -> DataFrame:
    """(key, found, clean): the pieces (kind, found) of each text and the text with placeholders in their stead; without
    clean, null for the text. A null text has no pieces and a null clean text; an empty one is itself. In the clean text
    surnames that stand alone and the revealing `terms` (word) are replaced too."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    words = known.known if terms is None else known.known.unionByName(terms.select("word", F.lit("term").alias("what")))

    def run(batch, own):
        texts = batch["text"].to_pylist()
        found, cleaned = [], []
        for lo, hi in chunks([t or "" for t in texts]):
            part = [t or "" for t in texts[lo:hi]]
            spans, w, exact = _found(part, own)
            found += [[{"kind": k, "found": f} for a, b, k in x if (f := found_form(t[a:b]))] for t, x in zip(part, spans)]
            if not clean:
                continue
            alone = np.where(exact & w.capital, 1, np.where(np.isin(w.print, own.terms), 2, 0))
            more: list[list] = [[] for _ in part]
            for i in np.flatnonzero(alone).tolist():
                more[w.row[i]].append((int(w.begin[i]), int(w.end[i]), "name" if alone[i] == 1 else "term"))
            cleaned += [t if t is None else replaced(t, x, m) for t, x, m in zip(texts[lo:hi], spans, more)]
        cleaned = cleaned if clean else [None] * len(texts)
        return pa.record_batch([batch["key"], pa.array(found, _KINDS), pa.array(cleaned, pa.string())], names=[key, "found", "clean"])

    rows = docs.select(F.col(key).alias("key"), "text")
    return _by_words(rows, words, run, f"{key} {kind}, found array<struct<kind:string, found:string>>, clean string")


def revealing(docs: DataFrame, known: Names) -> DataFrame:
    """(word) of the terms that disclose a person: by the records of the corpus, a term with a capital or a figure's word
    that stands with one and the same name in REVEALING of its occurrences, in RECORDS records or more, and by TERM_BITS
    bits likelier than chance."""

    def run(batch, own):
        texts = [t or "" for t in batch["text"].to_pylist()]
        out: list[list[np.ndarray]] = [[], []]
        for lo, hi in chunks(texts):
            part = texts[lo:hi]
            spans, w, exact = _found(part, own)
            who = [(k, found_form(t[a:b])) for k, (t, x) in enumerate(zip(part, spans)) for a, b, kind in x if kind == "name"]
            if not who:
                continue
            rows, person = np.array([k for k, _ in who]), prints_of([p if p.isalpha() else "x" for _, p in who])
            inside = np.zeros(len(w.print), bool)
            cut = np.searchsorted(w.row, np.arange(len(part) + 1))
            for k in np.unique(rows).tolist():
                for a, b, _ in spans[k]:
                    at = slice(cut[k], cut[k + 1])
                    inside[at] |= (w.begin[at] < b) & (w.end[at] > a)
            term = w.capital & ~inside & ~exact & (w.size > 2)
            for k, p in zip(rows.tolist(), person.tolist()):
                at = slice(cut[k], cut[k + 1])
                mine = np.unique(w.print[at][term[at]])
                out[0].append(mine)
                out[1].append(np.full(len(mine), p))
        cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.record_batch([pa.array(c.astype(np.int64)) for c in cols], names=["word", "person"])

    n = docs.count()
    rows = docs.select(F.col(docs.columns[0]).alias("key"), "text")
    both = written(_by_words(rows, known.known, run, "word bigint, person bigint").groupBy("word", "person").agg(F.count("*").alias("n")), "terms-and-persons")
    persons = both.groupBy("person").agg(F.max("n").alias("records"))
    terms = known.counts.groupBy("word").agg(F.sum(F.col("small") + F.col("capital")).alias("occurrences"))
    bits = F.log2(F.col("n") * F.lit(float(max(1, n))) / (F.col("occurrences") * F.col("records")))
    met = both.where(F.col("n") >= RECORDS).join(terms, "word").join(persons, "person")
    return written(met.where((F.col("n") >= REVEALING * F.col("occurrences")) & (bits >= TERM_BITS)).select("word").distinct(), "revealing-terms")
