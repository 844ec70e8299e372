"""Kept answers, the budget of calls, what a folder's ignore file leaves out, and reports in parts, against plain loops."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from proofmill.operators import budget, findings
from proofmill.plans import report
from proofmill.sources import answers, files

START = datetime(2024, 1, 1)


def test_kept_answers_in_any_batches(spark):
    r = random.Random(3)
    log = [(f"k{r.randrange(9)}", r.choice("12"), START + timedelta(hours=r.randrange(60)), r.choice([200, 404, 403, 429, 503, 0, None, 301]), f"b{i}") for i in range(200)]
    df = spark.createDataFrame(log, "key string, version string, taken timestamp, status_code int, body string")
    want = {}
    for row in log:
        code = row[3] or 0
        if 0 < code < 500 and code not in (401, 403, 405, 406, 408, 425, 429, 451):
            want[row[:2]] = max(want.get(row[:2], row), row)
    kept = None
    for part in (log[:70], log[120:], log[70:120], log[:9]):
        kept = answers.upsert(kept, spark.createDataFrame(part, df.schema))
    assert sorted(map(tuple, kept.collect())) == sorted(want.values()) == sorted(map(tuple, answers.upsert(None, df).collect()))
    now = START + timedelta(hours=80)
    good = {k for (k, v), row in want.items() if v == "1" and row[2] > now - timedelta(days=1)}
    asked = answers.to_ask(df.select("key").union(spark.createDataFrame([("new",)], "key string")), kept, "1", F.lit(now), days=1)
    assert sorted(x.key for x in asked.collect()) == sorted({f"k{i}" for i in range(9) if any(x[0] == f"k{i}" for x in log)} - good | {"new"})
    assert answers.upsert(None, df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 1, 40, 10_000])
def test_budget(spark, most):
    r = random.Random(most)
    claims = [(f"k{r.randrange(150)}", i, r.randint(1, 2)) for i in range(300)]
    cached = {f"k{i}" for i in range(0, 150, 4)}
    df = spark.createDataFrame(claims, "key string, ord long, cost int").repartition(7)
    got = {(x.key, x.ord): x.state for x in budget.allocate(df, spark.createDataFrame([(k,) for k in cached], "key string"), most).collect()}
    state, calls = {}, 0
    for key, _, cost in claims:
        if key not in state:
            state[key] = "cached" if key in cached else "asked" if calls + 2 <= most else "beyond"
            calls += cost * (key not in cached)
    assert got == {(k, o): state[k] for k, o, _ in claims}


def test_ignore_file(spark, tmp_path):
    for name in ("a.md", "keep/b.md", "keep/c.txt", "drop/d.md", "drop/deep/e.md", "notes.tex"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text("Words.")
    listed = lambda: sorted(x.rel for x in files.list_files(spark, str(tmp_path)).select("rel").collect())
    assert len(listed()) == 6
    (tmp_path / files.IGNORE).write_text("# no pattern\n\ndrop/\n*.txt\n")
    assert listed() == ["a.md", "keep/b.md", "notes.tex"]


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_report_in_parts(spark, tmp_path, n):
    rows = [(["seeds", "source"][i % 2], ["FLAGGED", "VERIFIED", "UNVERIFIABLE"][i % 3], f"f{i % 40}.md", i % 7 if i % 11 else None, f'says "{i % 50}" \n é', "", {"k": "v"} if i % 5 == 0 else {}) for i in range(n)]
    found = spark.createDataFrame(rows, findings.SCHEMA).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        report.write_json_report(found, ["seeds", "source"], str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "out").glob("part-*"))
    made = json.loads("".join(p.read_text() for p in parts))
    whole = json.loads(report.json_report(found, ["seeds", "source"]))
    assert {k: v for k, v in made.items() if k != "findings"} == {k: v for k, v in whole.items() if k != "findings"}
    assert sorted(map(json.dumps, made["findings"])) == sorted(map(json.dumps, whole["findings"])) and len(made["findings"]) == n and (n < 5000 or len(parts) > 1)
    keys = [(x["check"], ["FLAGGED", "UNVERIFIABLE", "VERIFIED"].index(x["status"]), x["file"]) for x in made["findings"]]
    assert keys == sorted(keys)
