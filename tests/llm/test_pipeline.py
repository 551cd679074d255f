"""The pipeline's stages against brute-force versions, each on its own input."""

import re

import corpus_pipeline
from partlab.llm import language_id, toxicity

from .test_methods import _brute_groups


def test_stages(spark, sf_dir, model_file):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    flat = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [flat(t) for t in bench]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        before, after = ({r["doc_id"]: r for r in d.collect()} for d in (docs, out))
        assert set(after) <= set(before)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "toxicity":  # one text at a time, from the same network
            scorer = toxicity.Scorer(toxicity.train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
            assert set(after) == {i for i, r in before.items() if scorer.score([r["text"]])[0] < toxicity.THRESHOLD}
        if name == "language_id":
            scorer = language_id.Scorer(language_id.train(docs, model_file))
            said = {i: scorer.score([r["text"]]) for i, r in before.items()}
            assert set(after) == {i for i, (lang, p) in said.items() if lang[0] != "und" and p[0] >= 0.5}
        if name == "near_dedup":
            groups = _brute_groups([(i, r["text"], None) for i, r in before.items()], 80)
            assert set(after) == {i for i, (n, top) in groups.items() if top == i}
        if name == "decontamination":
            assert not [i for i, r in after.items() if any(x in flat(r["text"]) for x in items if x.strip())]
        if name == "sentencepiece":
            assert set(after) == set(before) and "decoded_sha256" in out.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_stages_on_odd_rows_and_empty_tables(spark, sf_dir, odd_docs, no_docs):
    """Nulls, empty and long texts, repeated rows, other columns: every stage ends, keeps the
    columns and gives rows of its input."""
    before = {repr(tuple(r)) for r in odd_docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, odd_docs, sf_dir), stage(spark, no_docs, sf_dir)
        assert none.count() == 0
        if name != "sentencepiece":
            assert out.columns == none.columns == odd_docs.columns
            assert {repr(tuple(r)) for r in out.collect()} <= before
        else:
            assert out.count() == odd_docs.count()
