"""Text, precision and number functions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from proofmill.functions import precision as P
from proofmill.functions import text as X
from proofmill.functions.numbers import numbers
from proofmill.operators.arithmetic import comparisons, find_seed_rows, moments
from proofmill.operators.registry import mask_code, parse_tag, tags_of
from proofmill.operators.sentences import sentences_of, split_documents, units
from proofmill.sources.readers import bib_entries


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("sentence", "expected"),
    [
        ("Coverage was 90.3% on 12 of 17 models.", [("12 of 17", "ratio"), ("90.3%", "pct")]),
        ("In 2019 we ran Table 3 with 5 seeds and 4 ideas.", [("5", "plain")]),
        ("A gain of -0.5pp and 2x speed.", [("-0.5pp", "pp"), ("2x", "x")]),
        ("It costs $19 at https://a.b/123.", []),
        ("1,234 rows and 3 – 5 percent", [("1,234", "plain"), ("5 percent", "pct")]),
        ("", []),
        (None, []),
    ],
)
def test_numbers(sentence, expected):
    assert [(n["raw"], n["kind"]) for n in numbers(sentence)] == expected


def test_strip_and_tokens(spark):
    assert one(spark, X.strip_markdown(F.lit("a <!-- x\ny --> [link](u) `code` **bold**"))).split() == ["a", "link", "bold"]
    assert one(spark, X.strip_tex(F.lit(r"We \emph{gain} 5\% \cite{x} % note"))).split() == ["We", "gain", "5%"]
    assert one(spark, X.strip_tex(F.lit(r"\textbf{A \emph{b}} \paragraph{C} 3 \pm 1 \foo{} \hspace{1em} $x$ 1{,}000 a & b \\ d"))).split() == "A b C 3 ± 1 foo x 1000 a | b d".split()
    assert one(spark, X.strip_markdown(F.lit("**[a b](u)** and [*c*](v) ```x\ny``` _d_"))).split() == ["a", "b", "and", "c", "d"]
    assert [one(spark, P.shown(F.lit(x))) for x in (1.0e7, 0.1 + 0.2, 1234567.89, -0.5, 0.0, 100.0, 1e-20, 12.340)] == ["10000000", "0.3", "1234567.89", "-0.5", "0", "100", "1.000e-20", "12.34"]
    assert one(spark, X.tokens(F.lit("The Models and models show classes"))) == ["classe", "model"]
    assert one(spark, X.name_tokens(F.lit("meanScore_total.csv"))) == ["csv", "mean", "score", "total"]
    assert one(spark, X.sentences(F.lit("See Fig. 2 now. Then stop! (Really.) ok"))) == ["See Fig. 2 now.", "Then stop!", "(Really.) ok"]
    assert [one(spark, X.number(F.lit(v))) for v in ("1,200", "true", "inf", "x", "")] == [1200.0, 1.0, None, None, None]


def test_precision(spark):
    lit = F.lit
    assert one(spark, P.parsed(lit("−1,000.5"))) == -1000.5
    assert one(spark, P.tolerance(lit("2.5e+06"))) == pytest.approx(0.5e5 * 1.0001)
    assert one(spark, P.overlap(P.difference(P.interval(lit("91.2")), P.interval(lit("88.0"))), P.interval(lit("3.3"))))
    assert not one(spark, P.overlap(P.difference(P.interval(lit("91.2")), P.interval(lit("88.0"))), P.interval(lit("4.2"))))
    assert one(spark, P.relative_change(P.interval(lit("0.0")), P.interval(lit("5")))) is None
    assert [one(spark, P.significant_digits(lit(x))) for x in ("90.0", "100", "0.529", "0")] == [3, 1, 3, 1]
    assert [one(spark, P.student_t(lit(x))) for x in (1, 30, 31)] == [12.706, 2.042, 1.96]


def test_units_and_lines():
    text = "# Head\nfirst line\nsecond. Third\n\n| a | b |\n|---|---|\n- item one\n- item two"
    assert [(n, t) for n, t, _ in units(text)] == [(1, "Head"), (2, "first line second. Third"), (5, "| a | b |"), (7, "item one item two")]
    assert sentences_of(text)[1:3] == [(2, "first line second."), (3, "Third")]
    assert sentences_of("") == []


COMPARED = [
    ("We reach 91.2 against the baseline's 88.0, a gain of 4.2 points.", ("against", "4.2", "points")),
    ("It ranged from 88.0 to 91.2, a gain of 3.2 points.", None),
    ("The learning rate goes from 0.1 to 0.01, a reduction of 90%.", None),
    ("From 80.0 to 82.0; however a drop of 5 points elsewhere.", None),
    ("It was 88.0, 89.0 and 91.2 vs 87.0, a gain of 4.2 points.", None),
    ("No numbers here.", None),
    ("It beats 80.0 vs 78.0 and improves by 2.0 points.", ("against", "2.0", "points")),
    ("We improve from 10% to 12%, 2 pp.", ("from to", "2", "points")),
    ("From 80.0 to 82.0 the 82.0% gain holds.", ("from to", "82.0", "percent")),
    ("91.2 vs 88.0 is a 3.6% relative improvement, as 91.2 vs 88.0 shows.", None),
]


def test_comparison(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(COMPARED)], "i int, text string")
    got = {r.i: (r.frame, r.change, r.unit) for r in comparisons(df).collect()}
    assert [got.get(i) for i in range(len(COMPARED))] == [e for _, e in COMPARED]


SEEDED = [
    ("Over 3 seeds: 91.2, 90.8, 91.5, mean 91.2 ± 0.35.", ["mean VERIFIED"]), ("Over 5 seeds: 91.2, 90.8, 91.5, mean 95.0 ± 9.0.", ["count FLAGGED", "mean FLAGGED", "spread FLAGGED"]), ("seeds: 0, 1, 2 mean 5.0 ± 1.0", ["identifiers UNVERIFIABLE"]),
    ("Held at 20.1 ± 2.0 degrees and 21.0 ± 2.0 degrees, a significant change over 2 runs", []), ("91.2 ± 0.9 vs 90.8 ± 1.1 is significant", ["significance UNVERIFIABLE"]), ("91.2 ± 0.9 vs 90.8 ± 1.1 is significant by a t-test", []),
    ("91.2 ± 0.9% ms vs 90.8 ± 1.1 is significant", []), ("Over 3 seeds: 1.0, 2.0, 3.0; another loss was 9.0 ± 1.0", []), ("Over 3 seeds: 5.0, 5.0, 5.0, mean 5.0 ± 0.0", ["mean VERIFIED"]), ("Over 3 seeds: 1,000.5, 1,001.5, 1,002.5, mean 1,001.5 +/- 1.0", ["mean VERIFIED"]),
    ("Over 3 seeds: -1.0, −2.0, -3.0, mean −2.0 ± 1.0", ["mean VERIFIED"]), ("over 1 runs the standard deviation is 2.0 and the standard error is 9.0", []), ("over 4 runs the standard deviation (Table 3) is 2.0 and the standard error is 9.0", []), ("", []), (None, []),
]


def test_seed_rules(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SEEDED)], "i int, sentence string")
    got = {}
    for r in find_seed_rows(df).collect():
        got.setdefault(r.i, []).append(f"{r.rule} {r.status}")
    assert [got.get(i, []) for i in range(len(SEEDED))] == [e for _, e in SEEDED]


def test_moments(spark):
    lists = [["1.0", "2.5", "-4", "1,000"], ["3"], [], ["1e3", "1e3"], ["100000000.1", "100000000.2", "100000000.3"]]
    for r in spark.createDataFrame([(x,) for x in lists], "x array<string>").select("x", moments(F.col("x")).alias("m")).collect():
        v = [float(x.replace(",", "")) for x in r.x]
        mean = sum(v) / len(v) if v else 0
        assert (r.m.n, r.m.mean) == (len(v), pytest.approx(mean)) and r.m.square == pytest.approx(sum((x - mean) ** 2 for x in v), rel=1e-6)


def test_tags():
    assert parse_tag(" a = 1.5 ", False) == ("a", "1.5", None)
    assert parse_tag(" key = value ", False) == (None, None, None)
    assert parse_tag(" a = 1 (note)", True)[1] == "1"
    assert parse_tag(" a 1", False)[2] is not None
    assert tags_of("x 0.75%<!-- claim: m = 0.7545 -->", False) == [(1, "m", "0.7545", "0.75", None)]
    assert tags_of("0.3 % claim: t = -0.39 (mean)", True)[0][1:3] == ("t", "-0.39")
    masked = mask_code("a\n```\n<!-- claim: b = 1 -->\n```\n\n    code\ntext", False)
    assert mask_code("~~~~\nx\n~~~\ny\n~~~~\nz", False).split() == ["z"] and mask_code("a\n    b\n\n    c\n\n    d", False).split() == ["a", "b"]  # b goes on a paragraph
    assert [parse_tag(b, False)[2] is None for b in ("a = 1", "a", "= 1", "a = b = 1", "a =", "a = 1x", "a = <value>")] == [True, False, False, False, False, False, True]
    assert [t[4] is None for t in tags_of("<!-- claim: a = 1\n2 <!-- claim: b = 2 -->", False)] == [False, True]
    assert masked.count("\n") == 6 and "claim" not in masked and "code" not in masked and masked.endswith("text")


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_documents_in_pieces(spark, chunk):
    """Lines dealt over tasks against one loop for each document: runs of lines over pieces, paragraphs cut where sentences end, abbreviations over lines."""
    r = random.Random(chunk)
    lines = ["# Head", "|a|b|", "|--|--|", "", "  ", "---", "It is so.", "It is so. But why", "not? (Yes.)", "as et", "al.", "Smith et al.", "Said Fig.", "- an item", "2) another", "end!", '"Quoted"', "\u00a0x\x1c", "####### no head", "| one bar", "Dr.", "No"]
    docs = [(f"d{i}.{r.choice(['md', 'tex'])}", "\n".join(r.choice(lines) for _ in range(r.randint(1, 40)))) for i in range(60)] + [("void.md", None), ("empty.md", ""), ("long.md", "It is so\n" * 3000 + "\n\nEnd. " * 50)]
    df = spark.createDataFrame(docs, "rel string, text string")
    plain = sorted(map(tuple, split_documents(df).collect()))
    assert sorted(map(tuple, split_documents(df, long=-1, chunk=chunk).collect())) == plain
    assert sorted(map(tuple, split_documents(df, long=100, chunk=chunk).collect())) == plain


def test_bibliography_entries():
    text = """@article{a1,
  title = {A {Nested {and {deep}}} title}, author = "Doe, Jane" # " and others",
  year = 2020, month = jan, note = {open
@book{b2, title={B}, year = {1999}}
@misc{c3, title = "unclosed
"""
    assert bib_entries(text) == [
        ("a1", {"title": "A {Nested {and {deep}}} title", "author": "Doe, Jane", "year": "2020", "month": "jan", "note": "open"}, 1), ("b2", {"title": "B", "year": "1999"}, 4), ("c3", {"title": "unclosed"}, 5),
    ]
    assert bib_entries("") == [] and bib_entries("@string{x} @a{k, }") == [("k", {}, 1)]
