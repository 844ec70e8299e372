"""Checks over small folders written by the tests, and readers of each format."""

from __future__ import annotations

import io
import json
import zipfile
from collections import Counter

import pytest

from proofmill import cli
from proofmill.operators import findings as fi
from proofmill.operators import mentions, passages, values
from proofmill.operators.overclaim import find_overclaims
from proofmill.plans import report
from proofmill.plans.audit import audit
from proofmill.sources import files, readers


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "paper").mkdir()
    (tmp_path / "data").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.md").write_text("We always win.")
    (tmp_path / "a.md").write_text("# Report\nThe strict evaluation set holds 138 scored rows.\nThe mean coverage of the scores is 90.3%.\nSee arXiv:2001.00001.\nValue 0.75<!-- claim: m = 0.7545 -->.\n")
    (tmp_path / "b.md").write_text("The strict evaluation set holds 131 scored rows. We reach 91.2 against 88.0, a gain of 4.2 points.\n")
    (tmp_path / "paper" / "main.tex").write_text("\\documentclass{x}\nNobody tuned this. Over 3 seeds: 91.2, 90.8, 91.5, mean 95.0 ± 0.35.\n")
    (tmp_path / "paper" / "refs.bib").write_text("@article{k,\n author = {Doe, Jane and Roe, Max},\n title = {A Study of Things},\n eprint = {2001.00002},\n year = 2020\n}\n")
    (tmp_path / "data" / "scores.csv").write_text("model,coverage\nm1,0.912\nm2,0.894\nm3,0.903\n")
    (tmp_path / "data" / "pooled_runs.json").write_text('{"recall": {"final": 0.8125, "runs": [0.80, 0.82]}, "items": ["x", "y"]}')
    (tmp_path / "c.md").write_text("The final recall of the pooled runs was 0.8125.")
    (tmp_path / "claims.csv").write_text("label,value,tolerance\nm,0.7545,\nspare,1,\n")
    return tmp_path


def test_audit(spark, folder):
    records = spark.createDataFrame([("arxiv", "2001.00001", 404, None, None), ("arxiv", "2001.00002", 200, "A study of things", ["Jane Doe", "Ann Poe"])], "kind string, ident string, status_code int, title string, authors array<string>")
    rows = audit(spark, str(folder), records=records).collect()
    got = Counter((r.check, r.status) for r in rows)
    assert got["consistency", "FLAGGED"] == 1 and got["benchmark", "FLAGGED"] == 1 and got["seeds", "FLAGGED"] == 1 and got["overclaim", "FLAGGED"] == 1
    assert got["citation", "FLAGGED"] == 2 and got["registry", "VERIFIED"] == 1 and got["registry", "UNVERIFIABLE"] == 1
    verified = [r for r in rows if r.check == "source" and r.status == "VERIFIED"]
    assert sorted(r.message for r in verified) == ["The final recall of the pooled runs was 0.8125.", "The mean coverage of the scores is 90.3%."]
    assert any("coverage [m3] = 0.903" in r.evidence for r in verified) and any("recall.final = 0.8125" in r.evidence for r in verified)
    assert not any("node_modules" in r.file for r in rows)


def test_audit_offline_and_selected(spark, folder):
    rows = audit(spark, str(folder), only=["citation"]).collect()
    assert {(r.check, r.status) for r in rows} == {("citation", "UNVERIFIABLE")} and len(rows) == 2
    with pytest.raises(ValueError, match="unknown check"):
        audit(spark, str(folder), only=["nothing"])


def test_reports(spark, folder, capsys):
    found = audit(spark, str(folder), only=["overclaim", "benchmark"]).cache()
    text = report.text_report(found, ["overclaim", "benchmark", "seeds"])
    assert "[seeds] flagged 0" in text and "nobody" in text.lower()
    assert report.top_report(found, 1).count("\n1. ") == 1
    made = json.loads(report.json_report(found, ["overclaim"]))
    assert made["schema_version"] == 1 and len(made["findings"]) == 2
    assert report.exit_code(found) == 1 and report.exit_code(found, "never") == 0
    assert cli.main(["check", str(folder / "missing")]) == 2


def test_walk_order(spark):
    rels = ["b/x.md", "a.md", "b/a/y.md", "c.md", "b.md"]
    df = spark.createDataFrame([(r,) for r in rels], "rel string")
    from pyspark.sql import functions as F

    assert [r.rel for r in df.orderBy(files.walk_order(F.col("rel"))).collect()] == ["a.md", "b.md", "c.md", "b/x.md", "b/a/y.md"]


def test_readers():
    nb = {"cells": [{"cell_type": "markdown", "source": ["a\n", "b"]}, {"cell_type": "code", "source": "x"}, {"cell_type": "markdown", "source": None}]}
    assert readers.read("n.ipynb", json.dumps(nb).encode())[0] == "a\nb\n\n"
    assert readers.read("n.ipynb", json.dumps({"worksheets": [{"cells": [{"cell_type": "heading", "source": "h"}]}]}).encode())[0] == "h"
    assert readers.read("n.ipynb", b"[]")[1] and readers.read("n.ipynb", b"{}")[1]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>")
        z.writestr("word/footnotes.xml", "<x/>")
    assert readers.read("d.docx", buf.getvalue()) == ("One\ttwo\n\nThree", None, ["footnotes"])
    assert readers.read("d.docx", b"junk")[1]
    assert readers.read("t.md", b"ok\xff")[0] == "ok\ufffd"
    bbl = "\\bibitem{a} \\emph{CoRR}, abs/1706.03762\n\\bibitem{b} ArXiv, abs/cs/0508103\n\\bibitem{c} nothing"
    assert [(k, f, n, u) for k, f, n, u in readers.bbl_entries(bbl)] == [("a", {"eprint": "1706.03762"}, 1, None), ("b", {}, 2, "abs/cs/0508103")]
    values_, keys, cut = readers.json_values('{"pooled": {"coverage": 0.9, "runs": [1, 2, 3], "name": "5"}}')
    assert ("pooled.coverage", 0.9, None, 0) in values_ and ("pooled.runs", None, [1.0, 2.0, 3.0], 3) in values_ and keys == ["pooled", "coverage", "runs", "name"] and not cut


def test_registry_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"a": 1, "b": {"value": "2.5", "tolerance": 0.1}, "a": 3, "c": true}')
    rows = sorted((r.label, r.value) for r in files.read_registry(spark, str(tmp_path / "r.json")).collect())
    assert rows == [("a", "1"), ("a", "3"), ("b", "2.5"), ("c", None)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "rel string, line int, seq int, sentence string")
    assert find_overclaims(empty).count() == 0
    assert fi.summary(spark.createDataFrame([], fi.SCHEMA), ["scan"]).first().flagged == 0
    assert values.numeric_aggregates(spark.createDataFrame([], "file string, header string, raw string")).count() == 0


def test_mentions_and_quotes(spark):
    docs = spark.createDataFrame([("a.md", 0, "see https://x.org/p). and 10.1234/abc; arXiv:2001.00001v2\nhttps://arxiv.org/abs/2001.00001")], "rel string, file_ord int, text string")
    got = {(r.kind, r.ident, r.line) for r in mentions.first_seen(mentions.find_mentions(docs), ["file_ord", "line", "kind_ord", "pos"]).collect()}
    assert got == {("url", "https://x.org/p", 1), ("doi", "10.1234/abc", 1), ("arxiv", "2001.00001", 1)}
    q = spark.createDataFrame([(1, "One two, three four five SIX!"), (2, "one two"), (3, "one two three four five seven")], "quote_id int, quote string")
    t = spark.createDataFrame([(1, "zero one two three four five six seven"), (2, None)], "text_id int, text string")
    assert [(r.quote_id, r.text_id) for r in passages.contained_quotes(q, t).collect()] == [(1, 1)]
