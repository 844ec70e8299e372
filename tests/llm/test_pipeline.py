"""The corpus pipeline against plain code, its columns, and odd rows."""

from __future__ import annotations

import numpy as np
import plain
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from proofmill.llm import queries, quality


def test_pipeline_equals_plain_code(spark, sf_dir):
    """Every stage in loops: who is kept, the masked texts, and what the ids of each sample decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir).collect()
    model = quality.learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r.doc_id: r.text for r in docs.collect() if plain.quality(model, r.text) >= 0.7}
    label = plain.components(kept, 5, 80)
    first = [i for i in sorted(kept) if label[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = plain.contaminated(items, [kept[i] or "" for i in first])
    clean = [i for n, i in enumerate(first) if n not in bad]
    masked = {i: plain.masked(kept[i] or "", s) for i, s in zip(clean, plain.all_spans([kept[i] or "" for i in clean]), strict=True)}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert 0 < len(clean) < len(kept) < docs.count() and {r.doc_id for r in out} == set(clean)
    samples = {}
    for r in out:
        ids = np.frombuffer(r.ids, "<i4").tolist()
        samples.setdefault(r.doc_id, []).append(tuple(ids))
        assert sp.decode(ids) == masked[r.doc_id] and r.decoded_ok
    assert all(len(x) == len(set(x)) == 2 for i, x in samples.items() if len(masked[i]) > 3)


def test_stages_keep_columns_and_bear_odd_rows(spark, sf_dir):
    """Nulls, empty and long texts, repeated rows, rows without an id, extra columns with clashing names, and an empty table."""
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, __key string, label int, row string, marks int"
    long = "The river runs over stones and birds sing near old mills. " * 2000
    rows = [(1, long), (1, long), (2, long + "once more"), (3, None), (4, ""), (None, "a text of its own that stands here"), (None, "a text of its own that stands here"), (None, long), (5, "call +1 (509) 555-6973 or ann@x.org now")]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), 0.5, 7, "k", 1, "r", 3) for i, t in rows], names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        assert made.columns == docs.columns, name
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect())
    assert ids == [(False, 1), (False, 3), (False, 4), (False, 5), (True, 0)]
    text = {r.doc_id: r.text for r in corpus_pipeline.mask_personal_data(spark, docs.where("doc_id = 5 or doc_id = 3"), sf_dir).collect()}
    assert text == {3: None, 5: "call [PHONE] or [EMAIL] now"}
    segmented = corpus_pipeline.segment(spark, docs.where("doc_id > 1"), sf_dir).collect()
    assert {r.doc_id for r in segmented} == {2, 3, 4, 5} and all(r.decoded_ok for r in segmented)


@pytest.mark.parametrize("name", ["op3_token_store", "op4_license_scan", "op5_secret_scan", "op6_decontamination", "op8_sentencepiece_sampling"])
def test_registered_queries_run_over_whole_tables(spark, sf_dir, name):
    """Those that no other test runs as registered: one row for each document, or those of its samples or finds."""
    out, n = queries.QUERIES[name](spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = out.collect()
    ids = {r.doc_id for r in rows}
    assert len(rows) == n if name[:3] in ("op3", "op4", "op5") else len(ids) <= n
    assert len(ids) == n or name.startswith("op6")


def test_registered_pairs_equal_plain_code(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.component_id for r in queries.op9_minhash_dedup(spark, sf_dir).collect()}
    assert got == plain.components(docs, 2, 80)
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.embedding}
    out = {r.vec_id: r.n_links for r in queries.op2_embedding_dedup(spark, sf_dir).collect()}
    x = np.array([vectors[i] for i in sorted(vectors)], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert [out[i] for i in sorted(vectors)] == ((x @ x.T >= 0.95).sum(1) - 1).tolist()
