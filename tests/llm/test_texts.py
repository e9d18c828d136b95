import base64
import unicodedata
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestack.llm import common
from lodestack.llm import p3_lookalikes as P3
from lodestack.llm import p4_encoding as P4
from lodestack.llm import p5_stuffed as P5
from lodestack.llm import p6_body as P6

GERMAN = "Während die müde Fähre früh über die Brücke führt, öffnet der Gärtner die Tür. Die Übung zählt für jeden Schlüssel. "
PLAIN = "The quiet harbour keeps a ledger — a café near the old bridge opens early. Every keeper “counts” the boats at noon. "


def test_contents_are_undone():
    packed = base64.b64encode(zlib.compress("ä".encode())).decode()
    assert [common.decoded(*x) for x in ((packed, " ZLIB"), (packed, None), ("plain", "zlib"), (None, "zlib"), ("", "zlib"), (packed, "none"))] == ["ä", packed, "plain", None, "", packed]


def test_shingles_by_brute_force():
    texts = ["a b c d", "", "one two", "ÄÖ ü_1 x-y z9 a b c", "a b c a b c a b c", "word " * 5000]
    sets, first, words = common.shingles_of(texts, 3)
    import re

    for i, t in enumerate(texts):
        w = re.findall(r"[^\W_]+", t)
        assert words[i] == len(w) and first[i + 1] - first[i] == len(set(zip(w, w[1:], w[2:])))
    assert set(sets[first[0] : first[1]]) & set(sets[first[4] : first[5]])


FORMS = [
    ("ｆｕｌｌ", "full"), ("café", "café"), ("so​ft­", "soft"), ("a b　c", "a b c"), (" ends \n", "ends"), ("ﬁne", "fine"),
    ("ѕрасе", "space"), ("diﬁ́cil", "difícil"), ("ｓрa⁠ce", "space"),
]


def looks_of(texts):
    from collections import Counter

    return P3.Lookalikes(dict(Counter(ord(c) for t in texts for c in t)))


def test_same_look_has_one_form():
    corpus = [t for pair in FORMS for t in pair] * 2 + ["aeiou cps full café fine space difícil"] * 9 + ["Cafe", "cafe", "x²"]
    looks = looks_of(corpus)
    for a, b in FORMS:
        assert looks.form(a) == looks.form(b) == b
    for a, b in (("cafe", "café"), ("Cafe", "cafe"), ("x2", "x²"), ("a1", "a2")):
        assert looks.form(a) != looks.form(b)
    rebuilt = {t: unicodedata.normalize("NFC", "".join(map(P3.look, t))).strip() for t in corpus}
    assert all((looks.form(a) == looks.form(b)) == (rebuilt[a] == rebuilt[b]) for a in corpus for b in corpus)
    assert all(looks.form(looks.form(t)) == looks.form(t) for t in corpus)


def test_forms_of_many_are_those_of_each():
    corpus = [t for pair in FORMS for t in pair] * 2 + ["aeiou cps full café fine space difícil", "наш сор", "", "x" * 3000 + "é"] * 9
    for own in (corpus, ["сор"] * 9 + ["cop"]):
        looks = looks_of(own)
        assert looks.forms(own) == [looks.form(t) for t in own]
    assert looks_of([]).forms([" a "]) == ["a"]


def test_frequent_member_represents_its_class():
    looks = looks_of(["сор"] * 9 + ["cop"])
    assert looks.form("cop") == "сор"


def test_same_look_of_many_rows(spark, monkeypatch):
    rows = [("c", i, "ab" if i % 2 else "аb") for i in range(40)]
    df = spark.createDataFrame(rows, "component_id string, term_id bigint, text string").withColumn("compression", F.lit(None).cast("string"))
    forms = P3.consistent(df, P3.lookalikes(df), ["component_id", "term_id"])
    monkeypatch.setattr(P3, "SPLIT", 3)
    assert {tuple(r) for r in P3.same_look(forms, "component_id", "term_id").collect()} == {(a, b) for a in range(40) for b in range(a + 1, 40) if (a + b) % 2}


def test_same_look_pairs(spark):
    rows = [("c", 1, "ab"), ("c", 2, "аb"), ("c", 2, "аb"), ("c", 3, "ab"), ("d", 4, "ab"), ("c", 5, None), (None, 6, "ab"), ("c", 7, "AB"), ("c", 8, "")]
    df = spark.createDataFrame(rows, "component_id string, term_id bigint, text string").withColumn("compression", F.lit(None).cast("string")).withColumn("form", F.lit("clash"))
    looks = P3.lookalikes(df)
    for prints in (False, True):
        forms = P3.consistent(df, looks, ["component_id", "term_id"], prints)
        assert {tuple(r) for r in P3.same_look(forms, "component_id", "term_id").collect()} == {(1, 2), (2, 3)}
    empty = df.where("false")
    assert P3.same_look(P3.consistent(empty, P3.lookalikes(empty), ["component_id", "term_id"]), "component_id", "term_id").count() == 0


def test_contents_and_terms_have_one_form(spark, tmp_path):
    from lodestack.llm import queries

    packed = base64.b64encode(zlib.compress("ｆｕｌｌ ѕрасе".encode())).decode()
    docs = [(1, "u", "full space " * 9, None), (2, "u", packed, "ZLIB"), (3, None, "so\u200bft ", None), (4, "v", None, "zlib"), (5, "v", "", None), (6, "v", "plain", "zlib")]
    spark.createDataFrame(docs, "input_id bigint, url string, content string, compression string").write.parquet(str(tmp_path / "input_docs.parquet"))
    spark.createDataFrame([(1, "c", "ѕрасе"), (2, "c", "space")], "term_id bigint, component_id string, term string").write.parquet(str(tmp_path / "terms.parquet"))
    got = {r.input_id: r.form for r in queries.queries()["p3_contents"](spark, str(tmp_path)).collect()}
    assert got == {1: ("full space " * 9).strip(), 2: "full space", 3: "soft", 4: None, 5: "", 6: "plain"}
    assert {r.form for r in queries.queries()["p3_forms"](spark, str(tmp_path)).collect()} == {"space"}


def encoding_table(spark):
    sound = [(i, f"{PLAIN}{GERMAN} {i}", None) for i in range(60)] + [(60, None, None), (61, "", None), (62, "  ", "zlib"), (63, "A replacement character (�) is shown.", None), (64, "The sequence Ã¼ is read twice.", None), (65, PLAIN * 3000, None)]
    bad = [
        (100, PLAIN.encode().decode("cp1252", "replace").replace("�", "\x9d"), None), (101, GERMAN.encode().decode("latin-1"), None),
        (102, GERMAN.encode("latin-1").decode("cp850"), None), (103, GERMAN.encode("latin-1").decode("utf-8", "replace"), None),
        (104, PLAIN.encode().decode("mac_roman"), None), (105, "All is sound here. But cafÃ© is not.", None),
        (106, base64.b64encode(zlib.compress(GERMAN.encode().decode("cp437").encode())).decode(), "Zlib"),
    ]
    return spark.createDataFrame(sound + bad, "input_id bigint, content string, compression string").withColumn("places", F.lit(1))


def test_wrongly_decoded_records(spark):
    docs = encoding_table(spark)
    model = P4.PairModel.of(docs)
    found = {r.input_id: r for r in P4.improbable(docs, model, restore=True).collect()}
    assert set(found) == set(range(100, 107))
    assert found[101].content == GERMAN and found[102].content == GERMAN and found[104].content == PLAIN and found[106].content == GERMAN
    assert found[103].restorable == 0 and found[105].content == "All is sound here. But café is not."
    empty = docs.where("false")
    assert P4.improbable(empty, P4.PairModel.of(empty)).count() == 0


RUSSIAN = "Тихая гавань хранит старый журнал, и каждый сторож считает лодки в полдень. Всё хорошо: рёв моря слышен у моста. "


def test_pairs_of_many_records_wrongly_decoded_alike(spark):
    texts = [GERMAN, RUSSIAN, "Le garçon a mangé à l’hôtel où l’été est déjà passé. "]
    rows = [(i, texts[i % 3] + str(i), None) for i in range(90)]
    for k, wrong in enumerate(("latin-1", "cp1252", "cp1251"), 1):
        rows += [(1000 * k + i, (texts[i % 3] + str(i)).encode().decode(wrong, "ignore" if wrong == "cp1252" else "replace"), None) for i in range(45) if wrong != "cp1251" or i % 3 == 1]
    docs = spark.createDataFrame(rows, "input_id bigint, content string, compression string")
    found = {r.input_id: r.content for r in P4.improbable(docs, P4.PairModel.of(docs), restore=True).collect()}
    assert set(found) == {i for i, *_ in rows if i >= 1000}
    assert all(found[1000 + i] == texts[i % 3] + str(i) for i in range(45))


def test_misread_by_the_patterns():
    texts = [GERMAN, RUSSIAN, "семьдесят Рёв всё É » ÄÖÜ £ 業界のデータ", "", "a�b"]
    texts += [t.encode().decode(w, "replace") for t in texts for w in P4.WRONG]
    for t in texts:
        want = [c == "�" for c in t]
        for w in P4.WRONG:
            for m in P4._UTF8[w].finditer(t):
                if w not in P4.CYRILLIC or len(P4.re.findall(P4._UTF8[w].pattern[:-1], m.group())) > 1:
                    want[m.start() : m.end()] = [True] * len(m.group())
        assert P4.misread(common.laid_out([t])[0]).tolist()[:-1] == want


def test_strength_has_no_step():
    # a pair that gains records, in collections of any size, gains strength bit by bit, from 0 on
    for n in (1000, 29_000, 31_000, 10**6):
        docs = np.array([k for k in range(1, max(400, n // 500))] + [n], float)
        own = P4.PairModel(np.arange(1, len(docs) + 1, dtype=np.int64) * ((1 << 21) + 1), docs, n)
        got = own.of_pairs(np.arange(1, len(docs), dtype=np.uint64) * np.uint64((1 << 21) + 1))
        steps = np.diff(got)
        assert got[0] == 0 and (steps >= -1e-6).all() and steps.max() < 10_000 / n * 15 + 1 and got[-1] > 2


def test_segments():
    assert P4.best_segments([3, 4, 5, 90]) == [(3, 6), (90, 91)] and P4.best_segments([]) == []
    assert P4.best_segments([0, 4]) == [(0, 5)]


def test_stuffed_pages(spark):
    import random

    rng = random.Random(5)
    words = ["harbour", "ledger", "quiet", "keeper", "bridge", "counts", "early", "boats", "garden", "lantern", "river", "stone"]
    article = lambda: " ".join(" ".join(rng.choices(words, k=9)).capitalize() + "." for _ in range(12))
    rows = [(i, article(), None) for i in range(40)]
    refrain = "\n".join("The river runs by the old stone bridge.\n" + " ".join(rng.choices(words, k=7)).capitalize() + "." for _ in range(12))
    rows += [
        (50, "buy cheap boats " * 60, None), (51, "\n".join(f'<a href="http://x{i}.example/">cheap boats</a>' for i in range(40)), None),
        (52, "\n".join(f"brand item{i} {i} cm {i}.99 sale" for i in range(40)), None), (53, " ".join(f"#tag{rng.choice(words)}" for _ in range(80)), "none"),
        (54, base64.b64encode(zlib.compress(("fast deal, " * 90).encode())).decode(), "zlib"),
        (60, refrain, None), (61, " ".join(f"Read more about the {w} and its keeper here (see http://a.example/{w})." for w in words), None),
        (62, None, None), (63, "", None), (64, "Not Found", None), (65, " " * 400, None), (66, article() * 800, None), (66, article(), None),
    ]
    docs = spark.createDataFrame(rows, "input_id bigint, content string, compression string").withColumn("share", F.lit(0))
    got = {r.input_id for r in P5.scored(docs).where("stuffed").collect()}
    assert got == {50, 51, 52, 53, 54}
    assert P5.scored(docs.where("false")).count() == 0


def test_language_is_that_of_the_whole_page():
    of = lambda t: P5.language(bare := P5._TAG.sub(" ", t), P5.script(bare))
    menu, body = "<li class='menu'>Главная страница сайта</li>\n" * 20, "<p>The café keeper counts the boats at noon.</p>\n" * 60
    assert of(menu + body) == of(body + menu) == "en"
    assert of("<p>" + "Сторож считает лодки. " * 30 + "</p>" + "<br class='line-of-a-page'>" * 99) == "cyrillic"
    assert of("The quiet harbour. " * 30 + "静かな港の記録" * 90) == "cjk" and of("zalu fibo 12 kano " * 30) == P5.UNKNOWN
    assert of(GERMAN) == "de" and of(menu * 9 + PLAIN) == "cyrillic"


def prose(rng, n):
    nouns = "harbour ledger keeper bridge boat garden lantern river stone window letter market orchard signal".split()
    verbs, small = "counts keeps finds moves guards leaves reads opens".split(), "the a our every this of by with to and for in".split()
    word = lambda: rng.choice(nouns) if rng.random() < 0.7 else "".join(rng.choices("aeioukdlmnrst", k=7))
    one = lambda: " ".join(x for _ in range(rng.randint(2, 4)) for x in (rng.choice(small), word(), rng.choice(verbs), rng.choice(small), word())).capitalize() + "."
    return [one() for _ in range(n)]


def test_redundancy_is_what_finds_stuffed_pages(spark):
    import random

    rng = random.Random(3)
    rows = [(i, "\n".join(" ".join(prose(rng, 3)) for _ in range(5))) for i in range(120)]
    # a table of contents in ever other words: hardly any sentence, and no redundancy
    rows += [(300 + i, "\n".join(p[: -1 - rng.randint(0, 30)] for p in prose(rng, 14))) for i in range(12)]
    # short pages, and ever new words: nothing repeats but the pattern
    rows += [(400 + i, "\n".join(f"{''.join(rng.choices('abdefgik', k=6))} {''.join(rng.choices('abdefgik', k=7))} {rng.randint(1, 99)} kg {rng.randint(1, 99)}.99 sale" for _ in range(30))) for i in range(12)]
    rows += [(500 + i, " ".join(f"#{''.join(rng.choices('lmnoprstu', k=9))}" for _ in range(14))) for i in range(3)]
    docs = spark.createDataFrame([(i, t, None) for i, t in rows], "input_id bigint, content string, compression string")
    got = {r.input_id: r for r in P5.scored(docs).collect()}
    stuffed = {i for i, r in got.items() if r.stuffed}
    assert stuffed == {i for i, _ in rows if i >= 400}
    # the share of sentences alone would take the tables of contents as well; the gate leaves them out
    low = {i for i, r in got.items() if r.share < P5.SENTENCES}
    assert len(low - stuffed) >= 10 and all(got[i].redundancy < P5.EXTREME for i in low - stuffed)


def test_half_of_the_pages_stuffed_alike(spark):
    import random

    rng = random.Random(4)
    rows = [(i, " ".join(prose(rng, 14))) for i in range(60)] + [(100 + i, "buy cheap boats " * 60) for i in range(40)]
    docs = spark.createDataFrame([(i, t, None) for i, t in rows], "input_id bigint, content string, compression string")
    assert {r.input_id for r in P5.scored(docs).where("stuffed").collect()} == set(range(100, 140))


NAV = ["Zum Hafen", "Bootsverleih", "Gezeiten", "Pegelstand"]


def site(rng, n, tags):
    """A page and the numbers of its frame lines: words of no page in the tables, ever other articles."""
    frame = lambda x, tag="li": f'<{tag} class="m{rng.randint(1, 9)}">{x}</{tag}>' if tags else x
    text = lambda x, tag="p": f"<{tag}>{x}</{tag}>" if tags else x
    top = [frame(x) for x in NAV] + [frame("Harbour office > Notices > Week 12", "div")]
    body = [text(prose(rng, 1)[0][:-1], "h2")] + [text(" ".join(prose(rng, 3))) for _ in range(4)] + [text("Opening hours", "h2")] + [text(" ".join(prose(rng, 2)))]
    foot = [frame(f"Seen by {rng.randint(1, 999)} sailors so far", "div"), frame("Moored at pier nine since long ago.", "div"), frame(f"Tide tables: {prose(rng, 1)[0][:20]}, {prose(rng, 1)[0][:20]}", "aside")]
    if rng.random() < 0.5:
        body.insert(3, frame("A word from our chandler", "div"))
    lines = top + body + [""] + foot
    return "\n".join(lines), {k for k, x in enumerate(lines) if x and x not in body} | {k for k, x in enumerate(lines) if "chandler" in x}


def sites(n=40):
    import random

    rng = random.Random(6)
    rows, want = [], {}
    for host, tags in (("www.kalo.example", True), ("tide.example", False)):
        for i in range(n):
            page, frame = site(rng, i, tags)
            rows.append(("input_docs", f"{host}-{i}", host, page, None))
            want["input_docs", f"{host}-{i}"] = frame
    # one article copied again and again with small edits, beside the other pages of a host: no line of it is a frame
    article = [prose(rng, 1)[0][:-1]] + [" ".join(prose(rng, 3)) for _ in range(6)]
    for i in range(n):
        own = [x if k != i % 7 else x.replace(" ", f" q{i} ", 1) for k, x in enumerate(article)]
        rows.append(("input_docs", f"copy-{i}", "tide.example", "\n".join(own), None))
        want["input_docs", f"copy-{i}"] = set()
    rows += [("content_metadata", "f", "", "Title of the text\nA long paragraph that says what it says.\nACME\n- 1 -\nAnother long paragraph that says some more.\nACME\n- 2 -", None), ("input_docs", "n", "h", None, None), ("input_docs", "e", "h", "", None), ("input_docs", "one", "h", "Not found", None), (None, None, "h", "x", None)]
    want["content_metadata", "f"] = {2, 3, 5, 6}
    return rows, want


def rows_of(found):
    return {(r.tab, r.rec_key, r.line_no) for r in found.collect()}


def test_frames_by_votes(spark, monkeypatch):
    rows, want = sites()
    docs = spark.createDataFrame(rows, "tab string, rec_key string, host string, content string, compression string").withColumn("line_no", F.lit(7))
    truth = {(*k, n) for k, v in want.items() for n in v}
    got = rows_of(P6.frame_lines(docs.unionByName(docs)))
    single = rows_of(P6.frame_lines(docs))
    assert len(single & truth) >= 0.95 * len(truth) and len(single - truth) <= 0.01 * len(truth)
    assert len(got & truth) >= 0.95 * len(truth) and not any(k.startswith("copy") for _, k, _ in got)
    monkeypatch.setattr(P6, "BROADCAST_KEYS", -1)
    assert rows_of(P6.frame_lines(docs)) == single
    bodies = {r.rec_key: r.body for r in P6.main_bodies(docs.unionByName(docs.limit(3))).collect()}
    monkeypatch.undo()
    assert bodies["f"] == "Title of the text\nA long paragraph that says what it says.\nAnother long paragraph that says some more." and bodies["e"] == "" and bodies["one"] == "Not found"
    for tab, key, _, text, _ in rows:
        if text and key and key != "f":
            assert bodies[key] == "\n".join(x for n, x in enumerate(text.split("\n")) if (tab, key, n) not in single)
    assert P6.main_bodies(docs.unionByName(docs)).count() == P6.main_bodies(docs).count() == len({r[1] for r in rows if r[1] and r[3] is not None})
    # without the votes most rows are lost
    nothing = spark.createDataFrame([], "key bigint, what string")
    monkeypatch.setattr(P6, "losing", lambda lines: nothing)
    assert len(rows_of(P6.frame_lines(docs)) & truth) < 0.3 * len(truth)
    monkeypatch.undo()
    assert P6.frame_lines(docs.where("false")).count() == 0 and P6.main_bodies(docs.where("false")).count() == 0


def test_paths_have_their_parents():
    page = '<div class="main col-2">\n<h2>Title</h2>\n<p>Text</p>\n</div>\n<nav>Menu\n<ul class="x"><li>A</li>\n<li>B</li></ul>\nplain'
    assert P6.paths_of(page.split("\n")) == ["div.main", "div.main>h2", "div.main>p", "div.main", "nav", "ul.x>li", "ul.x>li", ""]


def test_point_table_and_chunks():
    t = common.PointTable(lambda c: ord(c) % 7)
    x = np.array([1, 8, 0x10FFFF], np.uint32)
    assert t.of(x).tolist() == [1, 1, 0x10FFFF % 7]
    assert list(common.chunks(["a" * 10, "b" * 10, "c" * 50, ""], 20)) == [(0, 1), (1, 2), (2, 3), (3, 4)] and list(common.chunks([])) == []
