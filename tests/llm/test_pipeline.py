"""The pipeline's stages against brute force, and the contract of its frames."""

from __future__ import annotations

import re

from tokenizers import Tokenizer

import corpus_pipeline
from sluicegate.llm import decontaminate
from sluicegate.llm.common import staged
from sluicegate.llm.queries import tokenizer_path

from .test_operators import joined, odd_docs, repeated

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, held = docs.columns, {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, FOLDER), name)
        held[name] = docs
        if name != "bpe_encoding":
            assert docs.columns == columns
    rows = {k: {r.doc_id: r for r in v.collect()} for k, v in held.items()}
    start, kept = rows["documents"], rows["language_id"]
    assert all(re.search(r"[^\W\d_]", start[d].text) for d in kept)
    ids = sorted(kept)
    groups = joined([kept[d].text for d in ids], 5, 80)
    assert set(rows["ngram_jaccard_join"]) == {ids[k] for k, (_, c) in groups.items() if c == k}
    cut = rows["suffix_array_dedup"]
    assert not repeated([cut[d].text for d in sorted(cut)], 50) and all(r.n_chars == len(r.text) for r in cut.values())
    items = [p.strip() for p in decontaminate.plain_forms([r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()])]
    clean = rows["benchmark_decontamination"]
    for d, r in cut.items():
        form = decontaminate.plain_forms([r.text])[0]
        if any(i in form for i in items):
            assert d not in clean
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for d, r in rows["bpe_encoding"].items():
        assert r.ids == library.encode(clean[d].text, add_special_tokens=False).ids


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 100 and "ids_sha256" in out.columns


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (odd_docs(spark), odd_docs(spark).where("false")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, FOLDER).count()


def test_language_stage_takes_clashing_names(spark):
    docs = odd_docs(spark).selectExpr("*", "'x' AS score", "1 AS lang_pred")
    kept = corpus_pipeline.identify_language(spark, docs, FOLDER)
    assert kept.columns == docs.columns and kept.where("score = 'x'").count() == kept.count() > 0
