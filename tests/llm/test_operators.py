"""Operators of the llm subpackage on small tables: brute force, exact round trips, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from proofmill.llm import decontam, embed_dedup, langid, license_scan, minhash_dedup, pii, quality, secret_scan, simple8b, sp_sampling, spans, token_store
from proofmill.llm import queries as llm_queries
from proofmill.llm.common import Scratch, connected_components, held_out
from proofmill.llm.hashing import shingles, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, id long, n long"
ODD = [None, "", "   \n\t ", "x", "a b", "a b", "é ü ﬁ 漢字 \0 \u0085 ▁", "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None, "clash", 7, 8) for i, t in enumerate(ODD)] + [(3, "x", None, None, None, None, None, None), (None, "a b", "en", "s", 1, "c", 1, 2)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- shared
def test_held_out(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_hashes_equal_plain_words():
    texts = [t.encode() for t in ("A b\tC", "", "c a B  b", "x" * 10)]
    h, at = word_hashes(texts)
    assert list(np.diff(at)) == [3, 0, 4, 1] and h[0] == h[4] and h[1] == h[5] == h[6] and h[2] == h[3]
    assert len(shingles(h[3:7], 2)) == 3 and len(shingles(h[:1], 5)) == 1 and not len(shingles(h[:0], 2))


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.comp for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {x: root(x) for u, v in edges if u != v for x in (u, v)}


# ---------------------------------------------------------------- 1 language
def test_languages(spark, docs):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog with the hat", "en"), ("der hund und die katze mit dem hut", "de"), ("le chat et le chien avec le chapeau", "fr")] * 20)]
    p = langid.learn_profiles(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert [p.predict(t)[0] for t in ("the dog and", "und der hund", "avec le chien", None, "123 !?")] == ["en", "de", "fr", "und", "und"]
    rows = langid.predict_language(docs, p).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows) and {r.lang_pred for r in rows if not r.doc_id} <= {"und", "en", "de", "fr"}
    assert langid.identify_languages(spark, empty(spark)).count() == 0
    assert langid.Profiles({}, 10).predict("abc") == ("und", 0.0)
    g, n = langid.gram_counts("Aa")
    assert dict(zip(g.tolist(), n.tolist(), strict=True))[ord("a")] == 2


def plain_grams(text):
    """n-grams of letters, words between marks: the same lists in plain code."""
    words, out = "".join(c if c.isalpha() else " " for c in text.lower()).split(), Counter()
    stream = "\1" + "".join(w + "\1" for w in words)
    for n in (1, 2, 3):
        for i in range(len(stream) - n + 1):
            g = stream[i : i + n]
            if g != "\1" and not (n == 3 and g[1] == "\1"):
                out[g] += 1
    return out if words else Counter()


def code_of(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


@pytest.mark.parametrize("block", [1, 7, 1 << 18])
def test_gram_counts_equal_plain_code(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    r = random.Random(1)
    for t in [*filter(None, ODD[:-1]), "\U00030005 x", *("".join(r.choice("aBc é.1 \U00030005ß") for _ in range(r.randint(0, 60))) for _ in range(60))]:
        g, n = langid.gram_counts(t)
        assert sorted(zip(g.tolist(), n.tolist(), strict=True)) == sorted((code_of(k), v) for k, v in plain_grams(t).items())


def test_language_query_equals_plain_distances(spark, sf_dir):
    """The registered query against profiles and out-of-place distances in plain code."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    out_of_fold = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts = {}
    for lang, text in {(r.lang, r.text) for r in rows if r.lang is not None and r.text and not out_of_fold(r.doc_id)}:
        counts.setdefault(lang, Counter()).update(plain_grams(text))
    top = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code_of(x[0])))[:400]]
    ranks = {lang: {g: i for i, g in enumerate(top(c))} for lang, c in sorted(counts.items())}
    got = {r.doc_id: r for r in llm_queries.op1_language_id(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        own = top(plain_grams(r.text or ""))
        x = got[r.doc_id]
        if not own:
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        far = sorted((sum(abs(rank[g] - i) if g in rank else 400 for i, g in enumerate(own)), lang) for lang, rank in ranks.items())
        assert x.lang_pred == far[0][1] and x.score == pytest.approx(1 - far[0][0] / far[1][0]) and x.held_out == out_of_fold(r.doc_id)


def test_every_language_is_learned(spark):
    """However its rows compare with the sample, and however many are copies; a text with a tie goes to the first language."""
    rows = [("zz", "qqq qqq")] * 3000 + [("aa", f"the cat {i} sat {chr(97 + i % 26)}") for i in range(300)] + [("bb", "xyx yxy"), ("cc", "xyx yxy")]
    p = langid.learn_profiles(spark.createDataFrame(rows, "lang string, text string"), sample=40)
    assert p.langs == ["aa", "bb", "cc", "zz"] and p.predict("qqq")[0] == "zz" and p.predict("xyx") == ("bb", 0.0)
    many = langid.learn_profiles(spark.createDataFrame([(f"l{i}", f"w{i}x") for i in range(700)], "lang string, text string"))
    assert len(many.langs) == 700


# ---------------------------------------------------------------- 2 embeddings
def plain_links(x, cosine=0.95):
    """Links of each vector, and the least index that it reaches, from all pairs."""
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= cosine
    label = np.arange(len(x))
    while True:
        new = np.array([label[link[i]].min() for i in range(len(x))])
        if (new == label).all():
            return link.sum(1) - 1, label
        label = new


@pytest.mark.parametrize(("recall", "block"), [(1.0, 512), (0.9995, 16)])
def test_embeddings_equal_brute_force(spark, monkeypatch, recall, block):
    """Exact traversal, and small chunks dealt over many tasks; odd rows beside them, and columns with clashing names."""
    monkeypatch.setattr(embed_dedup, "CHUNKS", 2)
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 16))
    x[:150] = x[0] + r.normal(scale=0.12, size=(150, 16))
    x[200:220] = x[200]
    x[215:220] *= 4  # the same direction
    rows = [(i, v.tolist(), "v", 1, 2) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [1.0, None] + [0.0] * 14), (903, [float("nan")] * 16), (904, [1.0]), (905, []), (906, [float("inf")] + [0.0] * 15)]
    rows = [r_ if len(r_) > 2 else (*r_, None, None, None) for r_ in rows] + [(7, x[7].tolist(), "w", 3, 4), (None, x[3].tolist(), "w", 3, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, id long, n long")
    got = embed_dedup.embedding_dedup(df, recall=recall, sample=200, block=block, words=8).collect()
    assert len(got) == len(rows)
    out = {r_.vec_id: r_ for r_ in got}
    n, label = plain_links(x)
    if recall == 1:
        assert [out[i].n_links for i in range(400)] == n.tolist()
    assert sum(out[i].n_links for i in range(400)) >= 0.999 * n.sum() and all(out[i].n_links <= n[i] for i in range(400))
    assert [out[i].component_id for i in range(400)] == label.tolist() and all(out[i].kept == (label[i] == i) for i in range(400))
    assert all((out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True) for i in range(900, 907))
    assert (out[None].n_links, out[None].component_id) == (0, None)
    assert embed_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embedding_recall_at_default_parameters(spark):
    """Thousands of links at a cosine just above the wanted one, between vectors without any other structure."""
    r = np.random.default_rng(8)
    x = r.normal(size=(9000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    u = r.normal(size=(3000, 64))
    u -= (u * x[:3000]).sum(1)[:, None] * x[:3000]
    x[3000:6000] = 0.951 * x[:3000] + np.sqrt(1 - 0.951**2) * u / np.linalg.norm(u, axis=1)[:, None]
    n, _ = plain_links(x)
    out = {o.vec_id: o.n_links for o in embed_dedup.embedding_dedup(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    found = sum(out.values())
    assert n.sum() >= 6000 and found >= 0.999 * n.sum() and all(out[i] <= n[i] for i in range(len(x)))


def test_embeddings_of_several_lengths_and_ties(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=32).tolist()) for i in range(300)]
    rows += [(1000 + i, v) for i, v in enumerate([[3.0, 4.0], [6.0, 8.0], [0.0, 1.0], [1.0], [2.0], [-1.0]])]
    rows += [(2000 + i, v) for i, v in enumerate([[1.0, 0.0, 0.0], [3.0, 4.0, 0.0], [1e200, 0.0, 0.0]])]
    got = {o.vec_id: (o.n_links, o.component_id) for o in embed_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cosine=0.6).collect()}
    n, label = plain_links(np.array([v for _, v in rows[:300]]), 0.6)
    assert [got[i] for i in range(300)] == list(zip(n.tolist(), label.tolist(), strict=True))
    assert [got[1000 + i] for i in range(6)] == [(2, 1000), (2, 1000), (2, 1000), (1, 1003), (1, 1003), (0, 1005)]
    assert [got[2000 + i] for i in range(3)] == [(2, 2000), (2, 2000), (2, 2000)]  # a cosine of exactly 0.6 links


def test_traversal_visits_in_order():
    r = np.random.default_rng(9)
    g = embed_dedup.Grid(r.normal(size=(300, 16)), 9, 0.95, 1.0, 1)
    a, b = (np.sort(x / x.sum())[::-1] for x in r.random((2, 9)))
    cells, before = g.traverse(a, b, 1.0)
    chance = [a[c >> embed_dedup.BITS] * b[c & (1 << embed_dedup.BITS) - 1] for c in cells]
    assert len(set(cells)) == 81 and chance == sorted(chance, reverse=True) and np.allclose(before, np.cumsum([0, *chance[:-1]]))
    assert len(g.traverse(a, b, 0.5)[0]) == next(i for i, m in enumerate(np.cumsum(chance), 1) if m >= 0.5)


# ---------------------------------------------------------------- 3 tokens
def test_simple8b_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 239, 240, 241, 3000):
        for v in (r.integers(0, 2, n), r.geometric(0.02, n), np.zeros(n), r.integers(0, 1 << 62, n), np.where(r.random(n) < 0.05, 1 << 61, 3)):
            v = v.astype(np.uint64)
            assert (simple8b.decode(simple8b.encode(v), n) == v).all()


def test_token_store(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    e = token_store.WordEncoder(path)
    for x in [*filter(None, ODD), "don't <|endoftext|> I'LL", *(f"a{chr(c)}B {chr(c)}" for c in range(1, 0x400))]:
        assert np.frombuffer(e.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    rows = sorted(token_store.store_and_read(docs, path).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()))
    start = 0
    for r, (i, text) in zip(rows, want, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store.store_and_read(empty(spark), path).count() == 0


# ---------------------------------------------------------------- 4 licences
def test_licences(spark, docs):
    m = license_scan.learn_licences(docs)
    texts = ["Released under the MIT License.", "intro\nfoo Licensed under CC BY-NC 4.0. bar", "Licensed under CC BY 4.0", "the licence of the poet is under review", None, ""]
    got = [",".join(f for f, *_ in x) for x in m.scan(texts, 0.6)]
    assert got == ["mit", "cc-by-nc", "cc-by", "", "", ""]
    rows = license_scan.scan_licences(docs, m).collect()
    assert len(rows) == docs.count() and all(r.families == "" for r in rows)
    assert license_scan.scan_licences(empty(spark), license_scan.learn_licences(empty(spark))).count() == 0


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
}


@pytest.mark.parametrize(("width", "mark", "end"), [(72, "", "\n"), (80, " * ", "\n"), (60, "# ", "\r\n"), (72, "// ", "\n")])
def test_wrapped_licences(spark, docs, width, mark, end):
    m = license_scan.learn_licences(docs)
    wrap = lambda t: end.join(mark + x for x in textwrap.wrap(t, width - len(mark)))
    for family, notice in WRAPPED.items():
        for lead in ("", "Copyright (c) 2019 Jane Roe" + end, "river stone " * 9 + end, "The file begins." + end + end):
            found = m.scan([lead + wrap(notice) + end + end + "int main() { return 0; }"], 0.6)[0]
            assert {f for f, *_ in found} == {family}, (family, lead)
    # Notices on adjacent lines are all found, and a blank line keeps paragraphs apart.
    assert {f for f, *_ in m.scan(["Released under the MIT License.\nLicensed under CC BY 4.0\nand other words"], 0.6)[0]} == {"mit", "cc-by"}
    assert m.scan(["Released under\n \nthe MIT\n\nLicense"], 0.6) == [[]]
    assert m.scan(["# Released under\n#\n# the MIT\n#\n# License"], 0.6) == [[]]


def test_licence_windows_equal_plain_code(spark, docs, sf_dir):
    """Every window's score by dense sums, on the documents and on mixtures of notices."""
    m = license_scan.learn_licences(docs)
    r = random.Random(44)
    notices = [t for x in license_scan.TEMPLATES.values() for t in x]
    filler = "the river runs over stones and birds sing near old mills".split()
    part = lambda: " ".join(w for w in r.choice(notices).split() if r.random() < 0.93) if r.random() < 0.4 else " ".join(r.choices(filler, k=r.randint(0, 60)))
    texts = ["".join(part() + r.choice(["\n", "\n", " ", "\n\n", "\n # \n"]) for _ in range(r.randint(0, 12))) for _ in range(60)]
    texts += [r_.text for r_ in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() if r_.text and "icense" in r_.text][:30]
    found = 0
    for t, got in zip(texts, m.scan(texts, 0.6), strict=True):
        want = plain.licences(m, t, 0.6)
        assert sorted((a, n, f) for f, _, _, a, n in got) == [x[:3] for x in want]
        assert sorted(p for _, p, *_ in got) == pytest.approx(sorted(x[3] for x in want), abs=1e-4)
        found += len(want)
    assert found > 30


def test_licence_probabilities_hold_on_new_text(spark, sf_dir):
    """Perturbed notices that training never saw, and paragraphs of other documents: right, and about as sure as right."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = license_scan.learn_licences(docs.where("doc_id % 2 = 0"))
    r = random.Random(45)
    other = [x.text for x in docs.where("doc_id % 2 = 1").select("text").collect() if x.text]
    bits = [" ".join(t.split()[i : i + 20]) for t in other for i in (0, 40) if "icense" not in t and "rights" not in t]
    passages, truth = [], []
    for f, notices in license_scan.TEMPLATES.items():
        for t in notices:
            for _ in range(8):
                words = [w for w in t.split() if r.random() > 0.12 or len(t.split()) < 10]  # a short one may hang on one word
                passages.append(f"{r.choice(bits)} {' '.join(words)} {r.choice(bits)}"), truth.append(m.families.index(f))
    passages += r.sample(bits, min(300, len(bits)))
    truth += [0] * (len(passages) - len(truth))
    p = m.probabilities(m.rows([license_scan._plain(x) for x in passages]) @ m.weight + m.bias)
    right = p.argmax(1) == np.array(truth)
    assert right.mean() > 0.93 and abs(p.max(1).mean() - right.mean()) < 0.06
    unknown = p[np.array(truth) == 0]
    assert ((1 - unknown[:, 0]) >= m.threshold).mean() < 0.03


# ---------------------------------------------------------------- 5 secrets
KEY = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)


def plain_secrets(t):
    out = [(m.start(), 0, m.end()) for m in KEY.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16])


def test_secrets(spark, docs):
    r = random.Random(4)
    texts = [*ODD, "token = ==password:aaaaaaaaaaaaa", "user = bob\npassword: 'abcdefghijkl' https://db.example.com/x", "login=ann\n\n\nsecret=abcdefghijklmnop", "user = bob only", "key=hunter22 alone", "AKIA" + "A" * 14 + " key=hunter22"]
    texts += ["".join(r.choice(["token", "=", " ", "AKIA", "ABCDEFGH12", "deadbeef", ":", "api_key", "é", "\n", "'"]) for _ in range(80)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in secret_scan.scan_secrets(df).collect():
        want = plain_secrets(texts[row.doc_id] or "")
        base = ",".join(f"{secret_scan.KINDS[k]}:{a}:{z}" for a, k, z in want)
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert {s for s in base.split(",") if s} <= set(row.spans.split(","))
    got = {row.doc_id: (row.n_weak_id, row.n_weak_secret, row.n_endpoint) for row in secret_scan.scan_secrets(df).collect()}
    n = len(ODD)
    assert [got[i] for i in range(n + 1, n + 6)] == [(1, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 1, 0)]
    assert secret_scan.scan_secrets(docs).count() == docs.count() and secret_scan.scan_secrets(empty(spark)).count() == 0


def test_secrets_far_apart_and_long(spark):
    mixed = lambda n: "Zz9+" * (n // 4)
    fill = "\n".join(f"SETTING_{i}: plain words" for i in range(60))
    texts = [
        f"client_id = x12\n{fill}\npass = hunter22\n{fill}\nhttps://db.example.com/x",  # over a thousand characters apart
        f"pass = {mixed(400)} client_id = abc",  # the starts are far apart, the gap is one character
        f"client_id = {'ab.' * 100}x pass = {mixed(600)} https://{'h/' * 700}x",  # longer than 64, 256 and 512
        f"login = bob {'q' * 90}{'Q' * 90}7{'+' * 300} {'a.' * 12}com:8080",  # the digit comes late in the token; a host of many labels
        f"client_id = x12\n{fill}\n\npass = hunter22",  # scopes apart
    ]
    got = {r.doc_id: r.spans for r in secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}

    def spans(i, *parts):
        return ",".join(f"{kind}:{texts[i].index(x)}:{texts[i].index(x) + len(x)}" for kind, x in parts)

    assert got[0] == spans(0, ("weak_id", "client_id = x12"), ("weak_secret", "pass = hunter22"), ("endpoint", "https://db.example.com/x"))
    assert got[1] == spans(1, ("weak_secret", f"pass = {mixed(400)}"), ("weak_id", "client_id = abc"))
    assert got[2] == spans(2, ("weak_id", f"client_id = {'ab.' * 100}x"), ("weak_secret", f"pass = {mixed(600)}"), ("endpoint", f"https://{'h/' * 700}x"))
    assert got[3] == spans(3, ("weak_id", "login = bob"), ("weak_secret", f"{'q' * 90}{'Q' * 90}7{'+' * 300}"), ("endpoint", f"{'a.' * 12}com:8080"))
    assert got[4] == ""


# ---------------------------------------------------------------- spans
def test_spans_beyond_a_run(spark):
    """Places past the length of one run, and of runs of runs, with characters of two and four bytes between."""
    for n in (0, 1, 127, 128, 129, 256, 16_385):
        text = "é\U0001F600 " + " ".join(f"x{i}" for i in range(n)) + " ü"
        df = spark.createDataFrame([(text,)], "text string")
        got = df.select(spans.find_spans(F.col("text"), "x[0-9]+", context=True).alias("s")).first().s
        want = list(re.finditer("x[0-9]+", text))
        assert [(m.start, m.end, m.match) for m in got] == [(m.start(), m.end(), m[0]) for m in want]
        bounds = [0, *(m.end() for m in want)], [*(m.start() for m in want), len(text)]
        assert [(m.before, m.after) for m in got] == [(text[bounds[0][i] : bounds[1][i]], text[bounds[0][i + 1] : bounds[1][i + 1]]) for i in range(len(want))]


def test_touching_and_replaced_equal_plain_code(spark):
    r = random.Random(55)
    rows = []
    for i in range(60):
        text = "".join(r.choice("abcdé\U0001F600 ") for _ in range(r.randint(0, 1500)))
        cuts = sorted(r.sample(range(len(text) + 1), min(len(text) + 1, 2 * r.randint(0, 300)) // 2 * 2))
        own = [(cuts[j], cuts[j + 1]) for j in range(0, len(cuts), 2)]
        base = [(a := r.randrange(len(text)), a + r.randint(1, 9)) for _ in range(r.randint(0, 200))] if text else []
        base = [(a, min(b, len(text))) for a, b in base]
        rows.append((i, text, [(a, 0, b) for a, b in own], [(a, r.randrange(2), b) for a, b in base]))
    df = spark.createDataFrame(rows, f"i int, text string, own {spans.SPANS}, base {spans.SPANS}")
    out = df.select("i", spans.touching(F.col("own"), F.col("base")).alias("met"), spans.apart(F.col("own"), F.col("base")).alias("apart"), spans.replaced(F.col("text"), F.col("base"), ["<0>", "<1>"]).alias("masked")).collect()
    for x in out:
        _, text, own, base = rows[x.i]
        met = [any(c < b and d > a for c, _, d in base) for a, _, b in own]
        assert x.met == met and [(s.start, s.kind, s.end) for s in x.apart] == [s for s, m in zip(own, met, strict=True) if not m]
        at, parts = 0, []
        for a, k, b in sorted(base):
            if a >= at:
                parts += [text[at:a], f"<{k}>"]
            at = max(at, b)
        assert x.masked == "".join(parts) + text[at:]


def test_texts_with_many_matches(spark):
    """A megabyte of text with 20,000 matches of several kinds is scanned in seconds."""
    n = 20_000
    text = " ".join(f"line {i} deadbeef0123456789abcdef{i:08d} user = bob{i} a{i}@b.co pass = hunter{i}" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").repartition(1)
    began = time.perf_counter()
    row = secret_scan.scan_secrets(df).first()
    assert (row.n_hex, row.n_weak_id, row.n_weak_secret) == (n, n, n) and len(row.spans.split(",")) == 3 * n
    row = pii.find_pii(df).first()
    assert row.n_email == n and row.base_sha256 == hashlib.sha256(",".join(f"email:{a}:{b}" for a, _, b in plain_pii(text)).encode()).hexdigest()
    masked = pii.mask_pii(df).first().text
    assert masked == re.sub(r"a[0-9]+@b\.co", "[EMAIL]", text)
    assert time.perf_counter() - began < 120


# ---------------------------------------------------------------- 6 benchmark
def test_contamination(spark, docs):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(r.randint(12, 70))) + ". " + " ".join(word() for _ in range(4)) + ".") for i in range(60)] + [(98, None), (99, "")]
    rows, want = [], set()
    for d in range(120):
        words = [word() for _ in range(r.randint(0, 400))]
        if d % 3 == 0:
            item = r.randrange(60)
            cut = r.randint(0, len(words))
            words[cut:cut] = items[item][1].upper().split() if d % 2 else items[item][1].split()
            want.add((d, item))
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (16 << 20, 4000):  # one shard, and several
        assert {(x.doc_id, x.item_id) for x in decontam.find_contamination(df, bench, shard_bytes=size).collect()} == want
    assert {x.doc_id for x in decontam.drop_contaminated(df, bench).collect()} == {d for d in range(120) if d % 3}
    assert decontam.drop_contaminated(docs, bench).collect() == docs.collect()
    assert decontam.find_contamination(docs, bench.where("false")).count() == 0 and decontam.find_contamination(empty(spark), bench).count() == 0


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_contamination_of_shared_and_missing_ids(spark, kind):
    r = random.Random(66)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)) + "."
    held = [text(30) + " " + text(4) for _ in range(6)]
    ids = [0, 0, 1, None, None, 0] if kind != "string" else ["gsm-0", "gsm-0", "1", None, None, "x"]
    bench = spark.createDataFrame([*zip(ids, held, strict=True), (ids[0], held[0]), (None, None)], f"item_id {kind}, text string")
    df = spark.createDataFrame([(d, text(60) + " " + (held[d] if d < 6 else "") + " " + text(60)) for d in range(8)], "doc_id long, text string")
    for size in (16 << 20, 300):  # one shard, and several
        out = decontam.find_contamination(df, bench, shard_bytes=size)
        assert sorted((x.doc_id, x.item_id) for x in out.collect()) == list(enumerate(ids))
        assert {x.doc_id for x in decontam.drop_contaminated(df, bench, shard_bytes=size).collect()} == {6, 7}
    assert out.schema["item_id"].dataType.simpleString() == ("string" if kind == "string" else "bigint")


@pytest.mark.parametrize("threshold", [0.15, 0.4, 0.6])
def test_retrieval_equals_plain_bm25(monkeypatch, threshold):
    """Passages with any share of an item's words, many of them near the threshold; small groups of postings."""
    monkeypatch.setattr(decontam, "POSTINGS", 300)
    r = random.Random(16)
    word = lambda: r.choice("abcdefgh") if r.random() < 0.4 else f"{r.choice('abcdefgh')}{r.randrange(40)}"
    items = [(i, " ".join(word() for _ in range(r.randint(1, 40)))) for i in range(60)] + [(70, "..."), (71, items_text := "same words here"), (72, items_text)]
    texts = []
    for _ in range(80):
        own = items[r.randrange(60)][1].split()
        texts.append(" ".join(w if r.random() < 0.7 else word() for w in own * r.randint(0, 3)) + " " + " ".join(word() for _ in range(r.randint(0, 150))))
    index = decontam.ItemIndex(items)
    got = {(d, at, index.items[p]): s for d, at, p, s in index.retrieve([t.encode() for t in [*texts, "same words here"]], threshold)}
    want = plain.retrieval(items, [*texts, "same words here"], threshold)
    near = {k for k, s in want.items() if abs(s - threshold) < 1e-9}
    assert len(want) > 20 and set(got) - near == set(want) - near and all(got[k] == pytest.approx(want[k]) for k in set(got) & set(want))
    assert {k for k in got if k[0] == 80} >= {(80, 0, 71), (80, 0, 72)}


def test_scores_do_not_depend_on_shards_and_long_items_are_whole(spark):
    r = random.Random(61)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(r.randint(8, 60))) + ". The answer is " + word() + " " + word() + ".") for i in range(40)]
    long = " ".join(word() for _ in range(700)) + ". The answer is " + " ".join(word() for _ in range(6)) + "."
    items += [(100, long), (101, " ".join(word() for _ in range(1500)) + ". So be it now.")]
    noise = lambda n: " ".join(word() for _ in range(n))
    rows = [f"{noise(80)} {' '.join(w for w in t.split() if r.random() < 0.9)} {noise(80)}" for _, t in items[:40]]
    n, w = len(rows), long.split()
    rows += [f"{noise(300)} {long} {noise(300)}", f"{noise(50)} {' '.join(w[:256])} {noise(50)}", f"{noise(50)} {' '.join(w[-198:])} {noise(50)}", f"{noise(10)} {items[41][1]}"]
    df, bench = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = [sorted(map(tuple, decontam.find_contamination(df, bench, shard_bytes=size).collect())) for size in (16 << 20, 5000, 900)]
    assert found[0] and all([x[:2] for x in f] == [x[:2] for x in found[0]] and np.allclose([x[2:] for x in f], [x[2:] for x in found[0]]) for f in found[1:])
    hit = {x[:2] for x in found[0]}
    # The whole item with its answer is found; its first 256 words (without the answer) and its last 198 (without most of the question) are not the item.
    assert (n, 100) in hit and (n + 3, 101) in hit and not {d for d, _ in hit} & {n + 1, n + 2}


# ---------------------------------------------------------------- 7 quality
def test_quality(spark, docs):
    r = random.Random(7)
    good = lambda: " ".join(r.choice(["the", "river", "runs", "over", "stones,", "and", "Birds", "sing."]) for _ in range(r.randint(20, 200)))
    bad = lambda: " ".join(r.choice(["BUY!!", "$$$", "NOW!!", "###", "%%%"]) for _ in range(r.randint(20, 200)))
    rows = [(i, good() if i % 3 else bad()) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)], "doc_id long, quality int")
    model = quality.learn_quality(df, labels)
    out = quality.score_quality(df, model).collect()
    assert sum(x.predicted == int(x.doc_id % 3 > 0) for x in out if x.held_out) == sum(x.held_out for x in out) > 20
    assert len(quality.score_quality(docs, model).collect()) == docs.count()
    kept = quality.keep_quality(docs, model)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert quality.learn_quality(df, labels.where("false")) == 0.5
    assert quality.score_quality(empty(spark), model).count() == 0
    assert quality.encode(None).shape == (1, quality.SIZE) and len(quality.encode("w " * 1000)) == 16


def test_quality_equals_plain_code(spark, sf_dir):
    """The registered query's scores against loops over passages, with the weights that it learned."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn_quality(docs, labels)
    got = {r.doc_id: r for r in llm_queries.op7_quality(spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        want = plain.quality(model, r.text)
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-5) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_quality_of_very_long_words_and_repeated_rows(spark):
    word = "aB1.%" * 500_000  # longer than a packed counter's field
    stats = quality.encode(word + " " + word)[0]
    assert stats[:6] == pytest.approx(plain.passages("aB1.% aB1.%")[0][:6] * np.array([500_000, 500_000.0**2, 1, 1, 1, 1]), rel=1e-5)
    rows = [(i, f"good words {i} and more " * 40 if i % 2 else "BAD!! $$$ " * 40) for i in range(60)] * 2 + [(7, "word " * 40_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.learn_quality(spark.createDataFrame(rows, "doc_id long, text string"), labels, passages=3)
    out = quality.score_quality(spark.createDataFrame([(1, "x", "c", "d", 1, 2.0)], "doc_id long, text string, label string, held_out string, id long, score double"), model).collect()
    assert isinstance(model, quality.Attention) and len(out) == 1


def test_attention_gradient():
    m = quality.Attention()
    r = np.random.default_rng(1)
    x, starts, y = r.normal(size=(7, quality.SIZE)), np.array([0, 3]), np.array([1.0, 0.0])
    loss = lambda: -np.mean(np.log(np.where(y > 0, m.forward(x, starts)["y"], 1 - m.forward(x, starts)["y"])))
    for k, g in m.gradient(x, starts, y).items():
        i = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        m.p[k][i] += 1e-5
        up = loss()
        m.p[k][i] -= 2e-5
        assert (up - loss()) / 2e-5 == pytest.approx(g[i], rel=1e-3)
        m.p[k][i] += 1e-5


# ---------------------------------------------------------------- 8 segmentations
def test_segmentations(spark, docs):
    v = sp_sampling.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    text = "a hello é\n"
    ids = {p: i for i, p in enumerate(v.pieces) if i > 258}

    def every(t):
        if not t:
            yield (), 0.0
        for n in range(1, min(16, len(t)) + 1):
            own = ids.get(t[:n])
            if own is not None or n == 1:
                for rest, w in every(t[n:]):
                    yield (own if own is not None else sp_sampling.RAW + ord(t[0]), *rest), w + (v.weight[own] if own is not None else v.raw_weight * len(t[0].encode()))

    probs = dict(every(sp_sampling.MARK + text.replace(" ", sp_sampling.MARK)))
    z = np.log(sum(np.exp(w) for w in probs.values()))
    n = 4000
    seeds = sp_sampling.mixed(np.arange(n, dtype=np.uint64) * np.uint64(77))
    made = sp_sampling.Sampler(v, [text] * n).sample(seeds, 3)
    assert all(len({tuple(s[0]) for s in m}) == 3 for m in made)
    assert all(abs(s[1] - (probs[tuple(s[0])] - z)) < 1e-9 for m in made[:50] for s in m)
    first = {}
    for m in made:
        first[tuple(m[0][0])] = first.get(tuple(m[0][0]), 0) + 1
    assert all(abs(first.get(k, 0) / n - np.exp(w - z)) < 0.035 for k, w in probs.items())
    assert np.mean([sum(np.exp(s[1]) / s[3] for s in m) for m in made]) == pytest.approx(1, abs=0.02)
    alone = sp_sampling.Sampler(v, ["other", text]).sample(np.array([5, seeds[9]], np.uint64), 3)[1]
    assert [s[0].tolist() for s in alone] == [s[0].tolist() for s in made[9]]
    out = sp_sampling.sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2).collect()
    assert all(r.decoded_ok for r in out) and {r.doc_id for r in out} == {r.doc_id for r in docs.collect()}
    assert sp_sampling.sample_segmentations(empty(spark), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def plain_samples(sampler, doc, seed, k):
    """Gumbel top-k of one text, edge by edge: the edges of each sample and its perturbed value."""
    noise = lambda key: float(sp_sampling._gumbel(np.array([key % 2**64], np.uint64))[0])
    number = sampler.number[sampler.starts[doc] : sampler.starts[doc + 1]]
    agenda, out = [(noise(seed), (), 0, int(sampler.first[number[0]]) if len(number) else 0)], []
    for s in range(k):
        if not agenda:
            break
        agenda.sort(key=lambda node: -node[0])
        value, path, word, at = agenda.pop(0)
        path, phi = list(path), sum(float(sampler.logp[e]) for e in path)
        for w in range(word, len(number)):
            first, end = int(sampler.first[number[w]]), int(sampler.end[number[w]])
            at = at if w == word else first
            key = int(sp_sampling.mixed(np.array([(seed + (s + 1) * 0xD6E8FEB86659FD93 + (w + 1) * 0xA0761D6478BD642F) % 2**64], np.uint64))[0])
            while at < end:
                edges = range(sampler.offset[at], sampler.offset[at + 1])
                x = {e: float(sampler.logp[e]) + noise(key + (at - first) * 0xA24BAED4963EE407 + int(sampler.length[e]) * 0x9E3779B97F4A7C15) for e in edges}
                best = max(edges, key=x.get)
                # The others' values, given that this node's is `value`, in the plain form.
                agenda += [(-np.logaddexp(-value, -phi - x[e] + np.log(-np.expm1(x[e] - x[best]))), (*path, e), w, at + int(sampler.length[e])) for e in edges if e != best]
                path, phi, at = [*path, best], phi + float(sampler.logp[best]), at + int(sampler.length[best])
        out.append((path, value))
    return out


def test_words_that_come_again(monkeypatch):
    """A word is taken apart once however many groups it comes in, and forgetting words changes no sample; samples are those of plain loops."""
    v = sp_sampling.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    r, seen, own = random.Random(8), [], sp_sampling.Vocabulary.lattice
    monkeypatch.setattr(sp_sampling.Vocabulary, "lattice", lambda self, code: seen.append(len(code)) or own(self, code))
    stock = ["the", "data", "naïve", "größer", "поиск", "検索", "re-run", "x\ny", "\n", "", "𝒳", "e\u0301", "a\0b", "▁", "internationalisation", "0123456789"]
    groups = [[" ".join(r.choice(stock) + r.choice(["", "s", "ing"]) for _ in range(r.randint(0, 30))) for _ in range(7)] + [None, ""] for _ in range(12)]
    seeds = sp_sampling.mixed(np.arange(9, dtype=np.uint64))
    shared, small = sp_sampling.Lattices(v), sp_sampling.Lattices(v, most=60)

    def flat(sampler):
        return [[(ids.tolist(), *rest) for ids, *rest in m] for m in sampler.sample(seeds, 3)]

    for texts in groups:
        alone = flat(sp_sampling.Sampler(v, texts))
        del seen[:]
        again = sp_sampling.Sampler(v, texts, shared)
        assert flat(again) == alone == flat(sp_sampling.Sampler(v, texts, small))
        del seen[:]
        assert flat(sp_sampling.Sampler(v, texts, shared)) == alone and not seen
        assert again.number.tolist() == [shared.words[w] for t in texts if t for w in sp_sampling._CHUNKS.findall("▁" + t.replace(" ", "▁"))]
    for d in range(9):
        plain = plain_samples(again, d, int(seeds[d]), 3)
        assert [again.id[np.array(p, np.int64)].tolist() for p, _ in plain] == [m[0] for m in alone[d]]
        assert [g for _, g in plain] == pytest.approx([m[2] for m in alone[d]], rel=1e-9)
    text = "\ud800 é \U0001d4b3\0"
    raw = [np.array([sp_sampling.RAW + c for c in (0xD800, 0xE9, 0x1D4B3, 0x10FFFF + 1)]), np.array([5])]
    assert [v.raw[x].tolist() for x in sp_sampling.ids_of(raw, v)][0] == [bytes([b]) for b in "?é\U0001d4b3\0".encode()]
    assert sp_sampling.decode_ids(sp_sampling.ids_of([sp_sampling.Sampler(v, [text]).sample(seeds[:1], 1)[0][0][0]], v)[0], v) == text.replace("\ud800", "?")


# ---------------------------------------------------------------- 9 near-duplicates
def plain_near(rows, k, percent):
    sets = {i: minhash_dedup.shingles_of(minhash_dedup.words_of(t), k) for i, t in rows}
    label = {i: i for i in sets}
    keys = sorted(sets)
    links = [(a, b) for a in keys for b in keys if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize(("k", "star_rounds", "block"), [(2, 2, 128), (5, 0, 8)])
def test_near_duplicates(spark, k, star_rounds, block):
    r = random.Random(9)
    word = lambda: r.choice("abcdefghijklmnop") * r.randint(1, 3)
    rows, n = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "é É")], 7
    for _ in range(6):
        base = [word() for _ in range(r.randint(30, 80))]
        for _ in range(25):
            copy = [word() if r.random() < 0.03 else w for w in base]
            rows.append((n, " ".join(copy)))
            n += 1
    r.shuffle(rows)
    out = minhash_dedup.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), k=k, star_rounds=star_rounds, block=block).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == plain_near(rows, k, 80)
    assert all(x.kept == (x.doc_id == x.component_id) for x in out)


@pytest.mark.parametrize("k", [2, 5])
def test_no_near_duplicate_is_lost(spark, k):
    """At default parameters: families where a document's second partner is its only way to the rest, chains, stars, likeliest partners that fail, exact ties."""
    r = random.Random(k)
    fresh = lambda n: [f"{r.randrange(16**6):x}" for _ in range(n)]
    families = []
    for _ in range(150):  # two that are near a third, not each other, in any order of ids
        u = fresh(200)
        families.append(r.sample([u, u[36:], u[:-36]], 3))
    for n in (10, 300):  # a chain: each is near the next only
        words = fresh(200 + 30 * n)
        families.append([words[30 * i : 30 * i + 300] for i in range(n)])
        centre = fresh(200)  # a star: each lacks another part
        families.append([centre] + [centre[: (a := r.randrange(170))] + fresh(20) + centre[a + 20 :] for _ in range(n)])
    for _ in range(20):  # many shared words, but below the threshold, beside one above it
        u = fresh(200)
        families.append([u, u[:150] + fresh(45), u[:150] + fresh(48), u[40:], u[:100] + fresh(100)])
    for _ in range(20):  # 9 shingles each, 8 of them shared: exactly 0.8
        u = fresh(9 + k - 1)
        families.append([u, u[:-1] + fresh(1)])
    rows = [" ".join(w) for f in families for w in f]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    out = minhash_dedup.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == plain_near(rows, k, 80)


def test_near_duplicates_odd_rows(spark, docs):
    out = minhash_dedup.minhash_dedup(docs, k=2).collect()
    assert len(out) == docs.count() and minhash_dedup.minhash_dedup(empty(spark)).count() == 0
    assert {x.component_id for x in out if x.doc_id in (4, 5, None)} == {4}


def test_least_matches():
    for n, m in minhash_dedup.least_matches(200, 40, 0.8, 1e-7):
        assert 0 < m < 0.8 * n


# ---------------------------------------------------------------- 10 personal data
plain_pii = plain.base_spans


def test_personal_data(spark, docs):
    r = random.Random(10)
    texts = [*ODD, "1.2.3.4 a@b.co 4111 1111 1111 1111 +1 (509) 555-6973", "a@b.c" + ".d" * 3000, "9" * 50_000]
    texts += ["".join(r.choice("0123456789.@+- ()ab_\né%") for _ in range(200)) for _ in range(100)] + ["".join(r.choice("0123456789 -") for _ in range(150)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.find_pii(df).collect():
        want = plain_pii(texts[row.doc_id] or "") if row.doc_id != len(ODD) + 2 else []
        base = ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in want)
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(k == i for _, k, _ in want) for i in range(4))
    masked = {row.doc_id: row.text for row in pii.mask_pii(df).collect()}
    assert masked[len(ODD)] == "[IP] [EMAIL] [CARD] [PHONE]"
    clean = pii.mask_pii(docs)
    assert clean.columns == docs.columns and sorted(clean.collect(), key=repr) == sorted(docs.collect(), key=repr)
    assert pii.find_pii(empty(spark)).count() == 0


def test_contextual_bootstrap(spark):
    rows = [(i, f"note {i} ends. patient number 411111111111111{i % 10} was seen") for i in range(60)] + [(100, "patient number 88112233445 was seen"), (101, "version number 2.0 was seen")]
    out = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), accept=0.05).collect()}
    assert out[100].n_context == 1 and out[100].spans == "context:15:26" and out[101].n_context == 0


def test_contextual_identifiers_of_any_form(spark):
    """With the parameters of the registered query."""
    rows = [f"please reach me at user{i}@example.com today and rest" for i in range(60)]
    n = len(rows)
    new = ["QQ123456C", "AB123456", "user@localhost", "4821", "1st"]
    rows += [f"please reach me at {x} today and rest" for x in new]
    everyday = len(rows)
    rows += ["the parcel QQ123456C came back", "see page 4821 of it", "version number 2.0 was seen"]
    rows += [f"the {w} won 1st prize in {w} city" for w in ("ann", "bob", "cid", "dan") for _ in range(3)] + [f"my {x} won {y} prize" for x in ("dog", "cat", "pig") for y in ("1st", "2nd", "3rd", "4th", "5th")]
    out = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [out[n + i] for i in range(len(new))] == [f"context:19:{19 + len(x)}" for x in new]
    assert out[everyday] == "context:11:20"
    assert {out[i] for i in range(everyday + 1, len(rows))} == {""}
    masked = pii.mask_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).where(f"doc_id = {n}").first().text
    assert masked == "please reach me at [CONTEXT] today and rest"


def test_contextual_rounds_go_on(spark):
    """Each context is known by the identifiers of the one before it, so the last needs a third round."""
    rows = [f"please reach me at user{i}@example.com today" for i in range(200)]
    rows += [f"please reach me at x{i}k today" for i in range(48)] + [f"the badge with code x{i}k opened" for i in range(48)]
    rows += [f"the badge with code y{i}k opened" for i in range(8)] + [f"a visitor called number y{i}k left" for i in range(8)] + ["a visitor called number z7k left"]
    out = {r.doc_id: r.n_context for r in pii.find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [out[i] for i in range(len(rows))] == [0] * 200 + [1] * (len(rows) - 200)


def test_bootstrap_equals_plain_code(spark, sf_dir):
    """Spans of the registered query, and of texts full of identifiers, against dictionaries of patterns and instances."""
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.spans for r in llm_queries.op10_pii(spark, sf_dir).collect()}
    name = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    assert got == {i: name(s) for i, s in zip(rows, plain.all_spans(list(rows.values())), strict=True)}
    r = random.Random(101)
    lead = ["call me at", "my badge is", "see page", "reach " + "w" * 90 + " " + "v" * 200 + " at"]
    thing = lambda: r.choice([f"u{r.randrange(30)}@x.com", f"+1 (509) 555-{r.randrange(6900, 6930)}", f"ID{r.randrange(40)}", str(r.randrange(30)), f"{r.randrange(10**8, 10**8 + 20)}"])
    texts = [" ".join(f"{r.choice(lead)} {thing()} {r.choice(['now', 'or', 'today.'])}" for _ in range(r.randint(0, 6))) for _ in range(150)]
    made = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), accept=0.6).collect()
    want = plain.all_spans(texts, accept=0.6)
    assert {x.doc_id: x.spans for x in made} == {i: name(s) for i, s in enumerate(want)} and sum(x.n_context for x in made) > 50
