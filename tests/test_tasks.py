"""How work is dealt over tasks, and what plans must not repeat."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from proofmill.functions.precision import exponent
from proofmill.operators import arithmetic, consistency
from proofmill.operators.sentences import split_documents
from proofmill.plans import catalogue


@pytest.mark.parametrize("name", ["seeds_rules", "seeds_statistics", "benchmark_relative", "unit_assembly"])
def test_small_files_are_dealt_over_tasks(spark, sf_dir, name):
    """A table of one file is one task's input, but not one task's work."""
    assert catalogue.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= 4


def test_exponents(spark):
    raws = spark.createDataFrame([("1.5e3",), ("2E-4",), ("7.25",), ("",), (None,)], "raw string")
    made = raws.select("raw", exponent(F.col("raw")).alias("e"))
    assert {r.raw: r.e for r in made.collect()} == {"1.5e3": 3, "2E-4": -4, "7.25": 0, "": 0, None: 0}


def test_spread_is_named_once(spark):
    """The words around a spread are searched once, not once for each reading of it."""
    said = spark.createDataFrame([("a.md", 1, 0, "Results over 4 runs: 1.0, 2.0, 3.0, 4.0, mean 2.5 ± 0.65 (SEM).")], "rel string, line int, seq int, sentence string")
    found = arithmetic.find_seed_rows(said)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("confidence\\s+interval") == 1
    assert [(r.rule, r.status) for r in found.collect()] == [("mean", "VERIFIED")]


@pytest.mark.parametrize("name", ["consistency_pairs", "consistency_overlap"])
def test_claims_are_read_once(spark, sf_dir, name):
    """The self-join reads written claims; no side splits documents or extracts numbers again."""
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" not in plan


def test_worker_hands_on_sentences_as_it_goes(spark):
    """Many documents in one task come back in bounded batches, and none is lost."""
    from proofmill.operators.sentences import HELD

    text = "It is so. " * 2000
    docs = spark.range(300).selectExpr("concat(id, '.md') as rel", f"'{text}' as text")
    assert docs.count() * len(text) > 2 * HELD
    made = split_documents(docs)
    sizes = made.mapInArrow(lambda batches: batches, made.schema).groupBy("rel").agg(F.count("*").alias("n"), F.max("seq").alias("last")).collect()
    assert len(sizes) == 300 and {(r.n, r.last) for r in sizes} == {(2000, 1999)}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_passages_are_read_once(spark, sf_dir):
    """The joins of the best passages read written tables; documents are not cut into tokens again."""
    plan = catalogue.QUERIES["passage_topk"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "regexp_extract_all" not in plan


@pytest.mark.parametrize("name", ["consistency_pairs", "consistency_overlap"])
def test_tokens_are_made_once_and_frequent_ones_are_not_shuffled(spark, sf_dir, name, monkeypatch):
    """No filter over the written claims makes their tokens again, and postings of frequent tokens go before the join."""
    written, plans = consistency.written, []
    monkeypatch.setattr(consistency, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df, name))
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plans[0].count("regexp_extract_all") == 1
    assert "LeftAnti" in plan


def test_patterns_asked_for_first_lose_nothing(spark):
    """What looks like a number is still left out, ranges and ratios are read, sentences end where BREAK says."""
    from proofmill.functions.numbers import numbers
    from proofmill.functions.text import BREAK
    from proofmill.operators.sentences import unit_sentences

    for text in ("HTTPS://x.org/12 rows", "WWW.x.org/77 rows", "doi 10.1234/55 is", "arXiv: 1234.56789 is", "on 2024-01-02 it", "by [12] it", "release v1.2 is", "host 1.2.3.4 is"):
        assert numbers(text) == [], text
    assert [n["raw"] for n in numbers("from 12%–15% in 3 of 4 runs and 5/6 runs")] == ["3 of 4", "5/6", "12%", "15%"]
    for text in ("One. Two!  Three? (Four) e.g. Five.", "A... B.\tC", "x. y. Z", "Ends. ", "!? A", ". . B"):
        assert [s for _, s in unit_sentences(1, text.replace("e.g.", "eg"), [])] == [s.strip() for s in re.split(BREAK, text.replace("e.g.", "eg")) if s.strip()]


def test_pieces_are_read_once(spark, sf_dir):
    """The windows over pieces read written tables; no document is cleaned or cut a second time for them, and no text is in the windows over pieces."""
    plan = catalogue.QUERIES["unit_assembly_in_pieces"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "split(" not in plan  # that of short documents, none here


def test_comparisons_are_read_once(spark, sf_dir):
    """Filters do not scrub a sentence, pick the stated change or read a printed number again; such plans grew beyond what can be compiled."""
    plan = catalogue.QUERIES["benchmark_relative"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("https?://") == 1 and plan.count("[eE]([-+]?") == 3
    assert [[c["number"] for c in arithmetic.found_in(t)["changes"]] for t in ("From 1.0 to 2.0, a GAIN OF 1.0 points", "5.0 vs 4.0, beats it BY 1.0 points", "5.0 against 4.0, a 1.0% gain")] == [["1.0"]] * 3
