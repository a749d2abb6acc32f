"""The corpus pipeline: its stages on the edge corpus, and whole runs."""

from __future__ import annotations

from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from cohortflow.llm import piece_codec
from cohortflow.llm.queries import QUERIES
from tests.llm.conftest import CLASHES

STAGES = dict(corpus_pipeline.STAGES)


def test_all_queries_are_registered():
    found = queries()
    assert found["pipeline"] is corpus_pipeline.run
    assert [sum(name.startswith(f"op{n}_") for name in found) for n in range(1, 11)] == [1] * 10
    assert set(QUERIES) <= set(found) and set(oracle_sql()) <= set(found)
    assert list(STAGES) == ["quality", "near_duplicates", "secrets", "mix", "pieces"]


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_keep_columns_and_bear_edges(spark, sf_dir, corpus, nothing, name):
    kept = STAGES[name](spark, corpus, sf_dir)
    assert kept.schema.simpleString() == corpus.schema.simpleString()
    rows = kept.collect()
    assert rows and all(row[c] == f"{c}!" for row in rows for c in CLASHES)
    if name != "secrets":
        assert {(r.doc_id, r.text) for r in rows} <= {(r.doc_id, r.text) for r in corpus.collect()}
    if name in ("quality", "near_duplicates"):
        assert len(rows) < corpus.count()
    if name == "secrets":
        assert len(rows) == corpus.count()
        assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
        assert not [r for r in rows if "AKIA" in (r.text or "")]
    empty = STAGES[name](spark, nothing, sf_dir)
    assert empty.count() == 0 and empty.columns == corpus.columns


def test_run(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    copies = Counter(r.doc_id for r in rows)
    assert rows and set(copies) <= set(docs) and max(copies.values()) <= 3
    peer = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL_PATH)
    for r in rows:
        assert r.parity and r.round_trip and r.n_tokens == len(r.token_ids)
        if "[secret]" not in peer.decode(r.token_ids):
            assert peer.decode(r.token_ids) == docs[r.doc_id].text
    low = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality == 0}
    assert len(low & set(copies)) <= 0.05 * len(low)
