"""The corpus pipeline on a small table, against the stages by plain Python."""

import os

import pytest

import corpus_pipeline
from quillrank.llm import decontaminate, encoders, line_dedup, minhash, quality
from tests.llm.test_dedup import brute_lines, components

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_run(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    scores = {r["doc_id"]: r["predicted"] for r in quality.score_quality(read("documents"), read("labels")).collect()}
    docs = {r["doc_id"]: r["text"] for r in read("documents").collect() if scores[r["doc_id"]]}
    short = brute_lines(list(docs.items()))
    docs = {i: short[(i, t)] if t else t for i, t in docs.items()}
    sets = {i: set(minhash.shingle_set(t or "", 5).tolist()) for i, t in docs.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    part = components(sets, links)
    matcher = decontaminate.Matcher([(r["item_id"], r["text"]) for r in read("benchmark").collect()], decontaminate.EDIT_SHARE)
    docs = {i: t for i, t in docs.items() if part[i] == i and not matcher.find(t or "")}
    import public_tokenizers

    found = encoders.word_bpe(public_tokenizers.path("word_bpe_49k.json")).encode_decode([t or "" for t in docs.values()])
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: n for i, (n, _, _) in zip(docs, found)}


def test_stages():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["good_quality", "no_repeated_lines", "one_of_each", "no_benchmark", "encoded"]
    assert line_dedup.RUN_WORDS == 50
