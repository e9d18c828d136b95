import base64
import math
import os
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import p7_neardups as P7
from lodestack.llm import p8_encode as P8
from lodestack.llm import p9_mixture as P9
from lodestack.llm import p10_personal as P10

needs_tokenizers = pytest.mark.skipif(not os.path.exists(P8.tokenizer_path("byte_bpe_50k")), reason="no tokenizer files")


def near_docs():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows, i = [], 0
    for _ in range(40):
        base = [word() for _ in range(rng.randint(25, 90))]
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(own))
                own[k : k + rng.randint(0, 1)] = [word()]
            rows.append((i, f"u{i if rng.random() < 0.8 else i - 1}", " ".join(own), None))
            i += 1
    rows += [(900 + k, f"c{k}", "the same words again and again " * 4 + "until twenty of them are there", "none") for k in range(30)]
    return rows + [(990, "n", None, None), (991, "e", "", None), (992, "s", "too short", None), (993, "l", "long text of many words " * 4000, None)]


def similar(rows, size, least, threshold):
    sets = {}
    for i, u, t, _ in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= least:
            sets[i] = u, set(zip(*(w[k:] for k in range(size))))
    return {(a, b): sets[a][0] != sets[b][0] for a in sets for b in sets if a < b and len(sets[a][1] & sets[b][1]) >= threshold * len(sets[a][1] | sets[b][1])}


@pytest.mark.parametrize("hot,split", [(500, 1000), (5, 3)])
def test_near_duplicates_by_brute_force(spark, monkeypatch, hot, split):
    monkeypatch.setattr(P7, "HOT", hot)  # low: buckets are split by sub-bands
    monkeypatch.setattr(P7, "SPLIT", split)  # low: keys and classes are split over tasks
    rows = near_docs()
    docs = spark.createDataFrame(rows + rows[:9], "input_id bigint, url string, content string, compression string").withColumn("ck1", F.lit(1))
    near = P7.NearDuplicates(docs, 0.7, 3, 20)
    want = similar(rows, 3, 20, 0.7)
    got = {tuple(r) for r in near.pairs().collect()}
    assert got == {k for k, other in want.items() if other}
    parent = {i: i for i in {x for k in want for x in k}}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, b in want:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    groups = {r.input_id: r.group_id for r in near.groups().collect()}
    assert all(groups[i] == root(i) for i in parent) and all(g == i for i, g in groups.items() if i not in parent)


def test_copies_are_one_class_however_many(spark, monkeypatch):
    # two texts in many copies share their bands as two classes, not as many rows
    monkeypatch.setattr(P7, "HOT", 4)
    asked = []
    real = P7._sub_bands
    monkeypatch.setattr(P7, "_sub_bands", lambda s: asked.append(1) or real(s))
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"u{i}", text if i % 2 else text + " end", None) for i in range(40)]
    near = P7.NearDuplicates(spark.createDataFrame(rows, "input_id bigint, url string, content string, compression string"), 0.7, 3, 20)
    assert near.pairs().count() == 40 * 39 // 2 and not asked


def test_no_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], "input_id bigint, url string, content string, compression string")
    near = P7.NearDuplicates(docs)
    assert near.pairs().count() == 0 and near.groups().count() == 0


def test_odd_sketches_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    errors = []
    for j in np.linspace(0.7, 1, 30):
        n = 400
        both = round(2 * n * j / (1 + j))
        pool = rng.integers(0, 1 << 32, 2 * n, dtype=np.uint32)
        a, b = pool[:n], np.concatenate((pool[:both], pool[n : 2 * n - both]))
        m = P7.min_hashes(np.concatenate((a, b)), np.array([0, n]))
        s = P7.sketches(m)
        errors.append(P7.estimated(s[:1], s[1:])[0] - j)
    assert abs(np.mean(errors)) < 0.04 and np.max(np.abs(errors)) < P7.SURE * P7.deviation(0.7)


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("id AS u", "id + 1 AS v").unionByName(spark.createDataFrame([(1000, 1001), (1001, 1002), (1002, 1000)], "u bigint, v bigint"))
    got = {r.node: r.root for r in P7._components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in (1000, 1001, 1002)}


@needs_tokenizers
def test_ids_are_those_of_the_public_library(spark):
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    path = P8.tokenizer_path("byte_bpe_50k")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab's're'veLL \n\t 12é漢　.!<|>"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
    def check(texts):
        ids, counts, *_ = P8.encoder(open(path, "rb").read()).encode(texts) if texts else ([], [], [])
        at = 0
        for t, n in zip(texts, counts):
            assert list(ids[at : at + n]) == other.encode_ordinary(t)
            assert P8.decoded_text(list(ids[at : at + n])) == t
            at += n

    check()
    long = "x" * 60_000 + " don't <|endoftext|> " * 2000
    rows = [(1, "Hello world's"), (2, ""), (3, None), (4, long), (5, "Hello world's")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("key", F.lit(2))
    got = {r.doc_id: r for r in P8.encoded(df).collect()}
    assert {k: r.ids for k, r in got.items()} == {i: other.encode_ordinary(t or "") for i, t in rows}
    assert got[1].offsets == [0, 5, 11] and got[3].ids == []
    assert P8.encoded(df.where("false")).count() == 0


@needs_tokenizers
def test_mixture_reaches_its_shares(spark):
    rng = random.Random(9)
    rows, n = [], 0
    for source, k in (("big", 400), ("mid", 120), ("small", 30)):
        for _ in range(k):
            rows.append((n, source, rng.choice(["en", "EN ", "de", None, "xx"]), rng.choice(["blog.a.example", "www.b.example", None]), "word " * rng.randint(1, 60)))
            n += 1
    rows += [(n, "big", "en", None, None), (n + 1, "big", "en", None, ""), (n + 2, None, "en", None, "word"), (n + 3, "other", "en", None, "word"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, host string, text string").withColumn("n_tokens", F.lit(5))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed = P9.mixture(docs, targets)
    got = mixed.collect()
    assert len(got) == len({r.doc_id for r in got}) and all(1 <= r.copies <= {"big": 1, "mid": 2, "small": 4}[r.source] for r in got)
    shares = {r.source: r for r in P9.shares(mixed, targets).collect()}
    assert all(abs(shares[s].actual_share - w) < 0.02 for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2), ("gone", 0.0)))
    assert sorted(map(tuple, P9.mixture(docs, targets).collect())) == sorted(map(tuple, got))
    none = spark.createDataFrame([("gone", 1.0, 1)], targets.schema)
    assert P9.mixture(docs, none).count() == 0 and P9.mixture(docs.where("false"), targets).count() == 0 and P9.mixture(docs, targets.where("false")).count() == 0


def test_thresholds_are_found_between_keys_that_lie_close(spark):
    rng = random.Random(10)
    close = [0.5]
    for _ in range(5):
        close.append(math.nextafter(close[-1], 1))
    keys = {"close": [1e-6, 0.25, *close, 1.0, 7e8], "alike": [0.25, 0.5, 0.5, 0.5, 0.75], "many": [rng.random() ** 9 for _ in range(2000)], "one": [0.3], "whole": [None, None]}
    rows = [(i, s, rng.randint(1, 50), k) for i, (s, k) in enumerate((s, k) for s, ks in keys.items() for k in ks)]
    part = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, key double")

    def nearest(s, want):
        each = defaultdict(int)
        for _, source, n, k in rows:
            if source == s and k is not None:
                each[k] += n
        sofar, last = 0, -1.0
        for k in sorted(each):
            if sofar + each[k] > want:
                return k if sofar + each[k] - want < want - sofar else last
            sofar, last = sofar + each[k], k
        return last

    tokens = {s: sum(r[2] for r in rows if r[1] == s) for s in keys}
    for share in (0.0, 0.3, 0.45, 0.6, 0.8, 1.1):
        missing = {s: share * n for s, n in tokens.items()}
        want = {s: nearest(s, m) if m > 0 else -1.0 for s, m in missing.items()}
        assert {s: k for s, (k, _) in P9._thresholds(part, missing).items()} == want


def test_raking_meets_marginals_and_caps():
    cells = {(s, l, t): 10.0 + len(s) + 3 * k for k, (s, l, t) in enumerate((s, l, t) for s in "ab" for l in "xy" for t in "uv")}
    f = P9.raked(cells, {"a": 0.8, "b": 0.2}, {"a": 2, "b": 1}, 100.0)
    sums = defaultdict(float)
    for c, n in cells.items():
        sums[c[0]] += n * f[c]
    assert abs(sums["a"] - 80) < 1e-6 and abs(sums["b"] - 20) < 1e-6 and all(v <= 2 for v in f.values())


TEXTS = [
    "Write to ada.holt+x@mail.example, or ben [at] quay [dot] example. The mail goes at noon, the ferry at dot five.",
    "Call +44 1632 960810 or (237) 555-0122; 030/23125554, 020 7946 0248. Offset 725713794 in segment 16, ISBN 978-0-00-499952-2.",
    "Card QQ 89 61 85 C and 992-22-1988, 00381311-G; ticket #414798, run 414798-760, on 2024-03-25.",
    "She lives at 12b Harrow Lane, Flat 3; he at Lindenstraße 5, they at 40 rue des Cordiers and Calle del Faro 7. North Harbour Street View is a feature.",
    "Dr. Mara Holtwick met OSKAR HOLTWICK; HOLTFOLD, Mara wrote to B. Holtwick and jan holtfold. Mara left. Storm Mara passed.",
]
MORE = [f"{g} {s} opened the ticket, says {s.lower()}{k}@mail.example." for k in range(2) for g in ("Mara", "Oskar", "Jan", "Ines") for s in ("Holtwick", "Holtfold", "Brackwick", "Lundfold")]


def test_pieces_are_found(spark, monkeypatch):
    rows = list(enumerate([*TEXTS, *MORE, None, "", "x " * 50_000, "Storm Mara passed. Storm Mara passed."]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("found", F.lit(1)).withColumn("kind", F.lit(2))
    known = P10.Names.of(docs)
    got = {r.doc_id: r for r in P10.personal(docs, known).collect()}
    pieces = {i: {(p.kind, p.found) for p in r.found} for i, r in got.items()}
    assert pieces[0] == {("email", "adaholtxmailexample"), ("email", "benatquaydotexample")}
    assert pieces[1] == {("phone", x) for x in ("441632960810", "2375550122", "03023125554", "02079460248")}
    assert pieces[2] == {("id", x) for x in ("qq896185c", "992221988", "00381311g")}
    assert pieces[3] == {("address", x) for x in ("12bharrowlane", "lindenstraße5", "40ruedescordiers", "calledelfaro7")}
    assert pieces[4] == {("name", x) for x in ("maraholtwick", "oskarholtwick", "holtfoldmara", "bholtwick", "janholtfold")}
    n = len(TEXTS) + len(MORE)
    assert got[n].clean is None and got[n].found == [] and got[n + 1].clean == "" and pieces[n + 3] == set()
    assert got[0].clean.startswith("Write to [EMAIL], or [EMAIL]. The mail goes") and "[NAME] met [NAME]" in got[4].clean
    assert P10.Names.of(docs.where("false")).known.count() == 0
    # words are joined where they are too many to broadcast, with the same result
    monkeypatch.setattr(P10, "BROADCAST_WORDS", -1)
    joined = {r.doc_id: r for r in P10.personal(docs, known, terms=P10.revealing(docs, known)).collect()}
    assert {i: (r.found, r.clean) for i, r in joined.items()} == {i: (r.found, r.clean) for i, r in got.items()}
    monkeypatch.undo()
    # what a word discloses decides: with a bar nothing reaches, no name is found
    monkeypatch.setattr(P10, "DISCLOSURE", 99.0)
    none = P10.personal(docs, P10.Names.of(docs), clean=False).collect()
    assert {p.kind for r in none for p in r.found} == {"email", "phone", "id", "address"} and all(r.clean is None for r in none)


def filler(rng, n):
    return " ".join(rng.choice("the quiet harbour keeps a ledger and every boat is counted at noon by the old bridge".split()) for _ in range(n))


def test_disclosure_over_a_corpus(spark):
    rng = random.Random(10)
    givens = "Ada Ben Cleo Dan Eva Finn Gus Hana".split()
    rows = [f"{filler(rng, 40)} {rng.choice(givens)} {s} {filler(rng, 30)}. The Street View of {filler(rng, 5)}." for s in ("Ng", "Holtwick", "Лунин", "Söderbrack") for _ in range(12)]
    rows += [f"{filler(rng, 30)}. {filler(rng, 60)}" for _ in range(60)]
    # a firm that is met with one person only reveals them; one that is met with anybody doesn't
    rows += [f"{filler(rng, 20)} Ada Holtwick of Zarquon wrote {filler(rng, 20)}" for _ in range(5)] + [f"{filler(rng, 20)} {g} {s} of Marlow wrote {filler(rng, 20)}" for g, s in zip(givens, ("Ng", "Holtwick") * 4)]
    rows += ["Zarquon sails.", "Marlow sails, and Holtwick too."]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    known = P10.Names.of(docs)
    got = {r.doc_id: r for r in P10.personal(docs, known, terms=P10.revealing(docs, known)).collect()}
    assert all(len(got[i].found) == 1 and got[i].found[0].kind == "name" for i in range(48)) and not any(got[i].found for i in range(48, 108))
    assert all(p.found.endswith("ng") for i in range(12) for p in got[i].found) and "Street View" in got[0].clean
    assert got[len(rows) - 2].clean == "[TERM] sails." and got[len(rows) - 1].clean == "Marlow sails, and [NAME] too."


def test_spans_are_those_of_the_whole_patterns():
    texts = [*TEXTS, "a@b.example c at d dot example e(at)f.example.com @x @ y", "Tel. +49 30 123456, 10 Long Mill Hill Road, ул. Новая, д. 5", "é@ü.example " * 3, "1" * 40, "0049 (0)30 123456 / AB123456C, x@y", ""]
    for t in texts:
        out, taken, rest = [], [], t
        for kind, form in (("email", P10.EMAIL), ("address", P10.ADDRESS), ("id", P10.IDENTITY), ("phone", P10.PHONE)):
            for m in form.finditer(rest):
                a, b = m.span()
                if any(a < y and x < b for x, y in taken):
                    continue
                if kind in ("id", "phone") and (P10.NO_NUMBER_BEFORE.search(t, max(0, a - 16), a) or P10.NO_NUMBER_AFTER.match(t, b)):
                    continue
                if kind == "phone" and not 7 <= sum(map(str.isdigit, m.group())) <= 15:
                    continue
                taken.append((a, b))
                out.append((a, b, kind))
            rest = P10._masked(t, sorted(out), "@")
        assert P10.numbers_and_addresses(t) == sorted(out)
