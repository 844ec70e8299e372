"""Questions to sources by joins, against a dictionary for each source."""

from __future__ import annotations

import random

import pytest
from plain_index import TextIndex, present
from pyspark.sql import functions as F

from proofmill.functions.fulltext import figure_forms, figures, normal_form, normalize
from proofmill.operators import source_index

ODD = [None, "", "Pek¨ oz naïve–X ﬁne 1{,}000", "Kovač İstanbul ΣΑΣ K Å ǆ ´a ^b `c", "x\u0301\u0302y \u212b ½ ² ⅷ", "3.10, 4,000.50 and .5 v1.2 2001.00001", "Mon-\ndrian a-\nb-\nc bottle-  \n neck", "camelCaseWords useW4A16 alpha-2b-x9"]


def test_normal_forms(spark):
    r = random.Random(1)
    texts = ODD + ["".join(chr(r.choice((r.randrange(32, 0x250), r.randrange(0x2000, 0x2200), r.randrange(0x300, 0x370), r.randrange(0x1E00, 0x2000)))) for _ in range(60)) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", normalize("t").alias("n"), figure_forms(normalize("t")).alias("f")).collect()
    for x in rows:
        assert x.n == normal_form(texts[x.i]), ascii(texts[x.i])
        assert set(x.f) == figures(normal_form(texts[x.i]))


WORDS = ["model", "models", "conformal", "prediction", "TurboNet", "W4A16", "W4", "A16", "well-known", "known", "coefficient", "coecient", "bottle-\nneck", "bottleneck", "Mondrian", "Mon-\ndrian", "fine-tuning", "12", "3.10", "x9-beta2", "dataset", "data set", "GPT", "naïve", "ﬁne", "res-\nult"]
KINDS = ["compound", "alnum", "acronym", "camel", "proper", "figure", "stem"]


@pytest.mark.parametrize("batch", [2_000, 2])
def test_answers_equal_plain_code(spark, monkeypatch, batch):
    monkeypatch.setattr(source_index, "BATCH", batch)
    r = random.Random(batch)
    sources = [(f"s{i}", " ".join(r.choice(WORDS) for _ in range(r.randint(0, 25))), " ".join(r.choice(WORDS) for _ in range(r.randint(0, 4))), i % 7 != 6) for i in range(24)] + [("none", None, None, True)]
    terms = [*WORDS, "Zebra", "zebras", "model-based", "Conform", "prediction-model", "ss", "fine", "datasets", "etwork", "predic", "turbo9", "knownfine", "e\u0301"]
    asked = [(j, s[0], r.choice(["confor", "predic", "model", "turbo", "known"]) if k == "stem" else r.choice(["12", "3.1", "3.10", "9", "4"]) if k == "figure" else r.choice(terms), k) for j, (s, k) in enumerate((s, k) for s in sources for k in KINDS for _ in range(6))]
    asked += [(5, "s0", "model", "proper"), (900, "absent", "model", "proper")]
    df = spark.createDataFrame(sources, "ident string, body string, refs string, trusted boolean")
    got = source_index.ask_sources(spark.createDataFrame(asked, "pair_id long, ident string, what string, kind string"), df).collect()
    assert len(got) == len(asked)
    index = {i: TextIndex(b or "", refs or "") for i, b, refs, ok in sources if ok}
    for x in got:
        assert x.present == (present(index[x.ident], x.what, x.kind) if x.ident in index else None), x
    assert len({x.present for x in got}) == 3
    plan = source_index.ask_sources(spark.createDataFrame(asked, "pair_id long, ident string, what string, kind string"), df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowConverters", "")


def test_index_equals_plain_counts(spark):
    r = random.Random(3)
    sources = [(f"s{i}", " ".join(r.choice(WORDS) for _ in range(40)), "Vovk 2005 Vovk") for i in range(6)] + [("none", None, None)]
    bags = {x.ident: x for x in source_index.token_bags(spark.createDataFrame(sources, "ident string, body string, refs string")).collect()}
    for ident, body, refs in sources:
        plain = TextIndex(body or "", refs or "")
        b = bags[ident]
        assert (b.counts, b.ref_counts, b.figures, b.halves) == (dict(plain.counts), dict(plain.refs), sorted(plain.figures), sorted(plain.halves))


def test_self_check(spark):
    good = "useful words about conformal prediction " * 400
    abstract = "several longer telling wordings appearing within abstract summary paragraph"
    rows = [
        ("short", "Some Title Words", "", "a b c", "a b c", True), ("good", "Conformal Prediction", "", good, good, True), ("lone", "Conformal Prediction", "", good, good + "b c d e f " * 300, True), ("strange", "Conformal Prediction", "", good, good + "�" * 200, True),
        ("title", "Unheard Wording", "", good, good, True), ("abstract", "", abstract, good, good, True), ("unknown", None, None, good, good, None), ("cut", "Conformal Prediction", "", good, good, False), ("void", "Some Title", "", None, None, None),
    ]
    df = spark.createDataFrame(rows, "ident string, title string, abstract string, body string, plain string, closed boolean").withColumn("refs", F.lit(""))
    why = {x.ident: x.why for x in source_index.self_check(df).collect()}
    assert why["good"] == [] and {k: len(v) for k, v in why.items()} == {"short": 3, "good": 0, "lone": 1, "strange": 1, "title": 1, "abstract": 1, "unknown": 1, "cut": 1, "void": 1}
    paged = {x.ident: x.why for x in source_index.self_check(df.withColumn("pages", F.lit(40)).withColumn("failed", F.lit(2))).collect()}
    assert len(paged["good"]) == 2
