"""Recorded answers, tiers, silent containers, names, and the support check in an audit."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from proofmill import cli
from proofmill.operators import judge, mentions, support, values
from proofmill.plans.audit import audit
from proofmill.sources import readers, records

ATOM = b"""<?xml version='1.0'?><feed xmlns='http://www.w3.org/2005/Atom'><entry><id>http://arxiv.org/abs/2001.00001v1</id><title>A Study of
 Conformal Things</title><summary> We study many conformal prediction methods. </summary><published>2020-01-02T00:00:00Z</published><author><name>Ann Smith</name></author><author><name>Bo P\xc3\xa9rez</name></author></entry></feed>"""
ABS = b"""<html><head><title>x</title><meta name="citation_title" content="A Study of Conformal Things"/><meta name="citation_author" content="Smith, Ann"/><meta name="citation_date" content="2020/01/02"/></head>
<body><blockquote class="abstract mathjax"><span>Abstract:</span> We study.</blockquote></body></html>"""
CROSSREF = json.dumps({"message": {"title": ["On Birds"], "author": [{"family": "Kovač"}, {"name": "A group"}], "issued": {"date-parts": [[2019, 3]]}, "abstract": "<jats:p>Short.</jats:p>"}}).encode()


def test_answers():
    assert records.read_atom(ATOM) == {"title": "A Study of Conformal Things", "abstract": "We study many conformal prediction methods.", "authors": ["smith", "perez"], "year": 2020}
    assert records.read_abs(ABS) == {"title": "A Study of Conformal Things", "abstract": "We study.", "authors": ["smith"], "year": 2020}
    assert records.read_crossref(CROSSREF) == {"title": "On Birds", "abstract": "Short.", "authors": ["kovac"], "year": 2019}
    assert records.read_abs(b"<html></html>") is None
    for what, status, content, cut in (("atom", 404, b"x", False), ("atom", 200, b"", False), ("html", 200, b"x", True), ("atom", 200, b"<junk", False), ("crossref", 200, b"[]", False), ("pdf", 200, b"%PDF", False)):
        assert set(records.read_answer(what, status, content, cut)) == {"note"}


def test_tiers(spark, tmp_path):
    words = " ".join(f"word{i} conformal prediction study things" for i in range(900))
    full = f"<html><head><title>A page about things</title></head><body><div class='ltx_page_content'><p>A Study of Conformal Things. {words}</p></div></body></html>".encode()
    page = f"<html><head><title>Word1 things study</title></head><body><p>{words}</p></body></html>".encode()
    rows = [
        ("arxiv:2001.00001", "atom", 200, ATOM, False), ("arxiv:2001.00001", "html", 200, full, False), ("arxiv:2001.00002", "abs", 200, ABS, False), ("arxiv:2001.00002", "html", 200, full[:-20], False), ("doi:10.1/x", "crossref", 200, CROSSREF, False),
        ("url:https://a.b", "page", 200, page, False), ("arxiv:2001.00003", "atom", 406, None, False),
    ]
    made = {r.ident: r for r in records.assemble(spark.createDataFrame(rows, records.RESPONSES)).collect()}
    assert {k: (r.tier, r.trusted) for k, r in made.items()} == {"arxiv:2001.00001": ("html", True), "arxiv:2001.00002": ("abstract", False), "doi:10.1/x": ("abstract", False), "url:https://a.b": ("web", True), "arxiv:2001.00003": ("none", False)}
    assert "its end is missing" in made["arxiv:2001.00002"].note and "unavailable (status 406)" in made["arxiv:2001.00003"].note and made["arxiv:2001.00002"].body is None
    codes = {(r.kind, r.ident): (r.status_code, r.authors) for r in records.citation_records(spark.createDataFrame(rows, records.RESPONSES)).collect()}
    assert codes["arxiv", "2001.00001"] == (200, ["smith", "perez"]) and codes["arxiv", "2001.00003"][0] == 406
    records.write_token_bags(records.assemble(spark.createDataFrame(rows, records.RESPONSES)).where("trusted"), str(tmp_path / "bags"))
    bags = [json.loads(x) for p in (tmp_path / "bags").glob("*.json.gz") for x in gzip.open(p, "rt")]
    assert {b["ident"] for b in bags} == {"arxiv:2001.00001", "url:https://a.b"} and all(b["counts"]["conformal"] >= 900 for b in bags)
    assert records.assemble(spark.createDataFrame([], records.RESPONSES)).count() == 0


def test_silent_containers(spark, tmp_path):
    cell = lambda kind, text: {"cell_type": kind, "source": text}
    (tmp_path / "code.ipynb").write_text(json.dumps({"cells": [cell("code", "x = 1")] * 3}))
    (tmp_path / "none.ipynb").write_text(json.dumps({"cells": []}))
    (tmp_path / "wrap.tex").write_text("\\documentclass{article}\n\\hypersetup{pdftitle={A long title. With sentences}}\n\\begin{document}\n\\includepdf[pages=-]{paper.pdf} % Text. Here\n\\end{document}\n")
    (tmp_path / "bare.tex").write_text("\\documentclass{article} % Nothing. Else\n")
    (tmp_path / "real.tex").write_text("\\begin{document}\nWe include a figure. \\includegraphics{a.pdf}\n\\end{document}\n")
    (tmp_path / "empty.md").write_text("\n")
    got = {r.file: r.evidence for r in audit(spark, str(tmp_path), only=["seeds"]).where("check = 'scan'").collect()}
    assert set(got) == {"code.ipynb", "none.ipynb", "wrap.tex", "bare.tex"}
    assert "all its cells, 3 of them, are code" in got["code.ipynb"] and "without cells" in got["none.ipynb"] and "wraps a PDF (paper.pdf) with \\includepdf" in got["wrap.tex"] and "no readable sentences" in got["bare.tex"]
    assert readers.why_silent("x.ipynb", json.dumps({"cells": [cell("markdown", ""), cell("code", "")]}).encode()) == "its 1 prose cell(s) hold no text"
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "data.csv").write_text("a\n1\n")
    nothing = audit(spark, str(tmp_path / "other"), only=["seeds"]).collect()
    assert [(r.check, r.status) for r in nothing] == [("scan", "FLAGGED")]


def test_names(spark):
    cases = {"Kovač": "kovac", "Erdős": "erdos", "Łukasz": "ukasz", "Pérez": "perez", "P\\'{e}rez": "perez", "ﬁsh": "fish", "Müller-Lüd": "mullerlud", "Ｗide": "wide", "e\u0301a": "ea"}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.n for r in df.select("x", mentions.normal_name(F.col("x")).alias("n")).collect()} == cases


def test_medians_of_many_values(spark):
    """A million distinct values in a skewed column, its middle in a thin slice; huge and tiny ones; two middle values in different slices."""
    x = F.pow(F.col("id").cast("double") - 500_000, F.lit(3.0))
    cells = spark.range(1_000_001).select(F.lit("t").alias("file"), F.lit("cubes").alias("header"), x.alias("v"))
    far = spark.createDataFrame([("t", "far", v) for v in (-1e308, 1e308, 5e-324, -5e-324, 0.25, 1e-300)] + [("t", "two", v) for v in (1.0, 1e9)] + [("t", "same", 4.0)] * 9, "file string, header string, v double")
    got = {r.header: r.median for r in values.medians(cells.unionByName(far), F.col("v")).collect()}
    assert got == {"cubes": 0.0, "far": (5e-324 + 1e-300) / 2, "two": (1.0 + 1e9) / 2, "same": 4.0}


def test_medians(spark):
    rows = [("t", "a", str(x)) for x in [5, 1, 4, 2, 3]] + [("t", "b", str(x)) for x in [1, 2, 3, 10]] + [("t", "c", "7")] * 50 + [("t", "c", "9")] * 50 + [("t", "d", str(i * 37 % 20_011)) for i in range(20_000)]
    got = {r.header: r.median for r in values.medians(spark.createDataFrame(rows, "file string, header string, raw string"), values.number("raw")).collect()}
    d = sorted(i * 37 % 20_011 for i in range(20_000))
    assert got == {"a": 3.0, "b": 2.5, "c": 8.0, "d": (d[9_999] + d[10_000]) / 2}


@pytest.fixture
def paper(tmp_path):
    (tmp_path / "p.tex").write_text("Smith et al. \\cite{a} show that the ZebraNet model works. We like ZebraNet a lot.\n\nJones et al. \\cite{a} argue.\n\nThey show that QuokkaNet is used \\cite{a}. Their recall on images of cats reaches 91.2 percent \\cite{b}.\n")
    (tmp_path / "r.bib").write_text("@article{a,\n title = {T},\n eprint = {2001.00001}\n}\n@article{b,\n title = {U},\n eprint = {2001.00002}\n}\n")
    return tmp_path


def sources_of(spark):
    text = "Many other words stand here first. Then the recall on images of cats reaches 91.2 percent in every run. Other words follow here now. " * 2
    return spark.createDataFrame([("arxiv:2001.00001", "T", ["Ann Smith"], 2020, True, "They show the model works. " * 5, ""), ("arxiv:2001.00002", "U", ["Max Roe"], 2020, True, text, "")], support.SOURCES)


def test_support_in_the_audit(spark, paper, capsys):
    rows = audit(spark, str(paper), only=["support"], cited=sources_of(spark)).collect()
    flagged = [r.message for r in rows if r.status == "FLAGGED"]
    # ZebraNet is the document's own word too, so only QuokkaNet is asked for; Jones is no author.
    assert len(rows) == 4 and sum("QuokkaNet" in m for m in flagged) == 1 and sum("Jones" in m for m in flagged) == 1 and len(flagged) == 2
    assert {r.status for r in audit(spark, str(paper), only=["support"]).collect()} == {"UNVERIFIABLE"}
    assert not any(r.check == "support" for r in audit(spark, str(paper)).collect())
    capped = support.check_support(*support_tables(spark), most_sources=1).collect()
    assert sum("beyond the first 1" in r.message for r in capped) == 1
    assert cli.main(["check", str(paper), "--replies", "x", "--only", "seeds"]) == 2
    sources_of(spark).write.parquet(str(paper / "cited.parquet"))
    cli.main(["check", str(paper), "--only", "support", "--cited", str(paper / "cited.parquet"), "--json", "--exit-zero"])
    assert "QuokkaNet" in capsys.readouterr().out


def support_tables(spark):
    docs = spark.createDataFrame([("p.tex", "One says it \\cite{a}. Two says it \\cite{b}.")], "rel string, text string")
    bib = spark.createDataFrame([("a", "arxiv:2001.00001", "1"), ("b", "arxiv:2001.00002", "2")], "key string, ident string, ord string")
    return docs, bib, sources_of(spark)


def test_judged_support(spark, paper):
    docs = spark.createDataFrame([("p.tex", "Their recall on images of cats reaches 91.2 percent \\cite{b}.")], "rel string, text string")
    _, bib, cited = support_tables(spark)
    pair = support.find_pairs(docs, bib).first()
    claim = spark.createDataFrame([(pair.text, pair.context, cited.where("ident = 'arxiv:2001.00002'").first().body, "")], "claim string, context string, text string, abstract string")
    key = judge.judge_claims(claim, spark.createDataFrame([], "key string, first string, second string")).first().key
    for said, status in (("SUPPORTED", "VERIFIED"), ("CONTRADICTED", "FLAGGED"), ("UNCLEAR", "UNVERIFIABLE")):
        first = json.dumps({"verdict": said, "quote": "the recall on images of cats reaches 91.2 percent", "excerpt": "E1"})
        replies = spark.createDataFrame([(key, first, '{"finding": "NONE"}')], "key string, first string, second string")
        row = support.check_support(docs, bib, cited, replies).first()
        assert (row.status, said in row.message) == (status, True)
