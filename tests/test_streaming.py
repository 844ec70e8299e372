"""An incremental audit: new files only, once each."""

from __future__ import annotations

from proofmill.streaming.watch import watch


def test_watch(spark, tmp_path):
    docs, out, state = tmp_path / "docs", str(tmp_path / "out"), str(tmp_path / "state")
    docs.mkdir()
    run = lambda: watch(spark, str(docs), out, state).awaitTermination(120)
    read = lambda: sorted((r.check, r.file, r.status) for r in spark.read.parquet(out).collect())
    (docs / "a.md").write_text("We always win.")
    assert run() and read() == [("overclaim", "a.md", "FLAGGED")]
    (docs / "b.md").write_text("We reach 91.2 against 88.0, a gain of 4.2 points.")
    (docs / "c.bin").write_bytes(b"x")
    assert run() and read() == [("benchmark", "b.md", "FLAGGED"), ("overclaim", "a.md", "FLAGGED")]
    assert run() and len(read()) == 2
