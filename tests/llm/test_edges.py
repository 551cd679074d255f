"""Every operator on awkward rows, and on empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from partlab.llm import chat_formatting, decontamination, language_id, license_scan, lz_fingerprint, minmax_dedup, sentencepiece_codec, sharding, toxicity, url_filters
from partlab.llm.queries import SHARD_SLOTS, SHARDS, URL_RULES

from .conftest import TEXTS

N = len(TEXTS) + 2


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 0), (5, 1), (3, 0), (99, 1), (None, 1), (5, 1), (7, None)], "doc_id bigint, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat the cat sat on the mat"), (2, None), (None, "too short"), (3, "")], "item_id bigint, text string")


def test_toxicity(odd_docs, no_docs, labels):
    rows = toxicity.score_documents(odd_docs, labels).collect()
    assert len(rows) == N and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert toxicity.score_documents(no_docs, labels).count() == 0
    none = toxicity.score_documents(odd_docs, labels.limit(0)).collect()
    assert {round(r["score"], 6) for r in none} == {0.1}
    assert toxicity.drop_toxic(odd_docs, labels.limit(0)).columns == odd_docs.columns


def test_language(odd_docs, no_docs, model_file):
    rows = language_id.identify(odd_docs, model_file).collect()
    assert len(rows) == N
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2))
    assert by[3]["lang_pred"] == "en"
    assert language_id.identify(no_docs, model_file).count() == 0
    assert set(r["lang_pred"] for r in language_id.identify(odd_docs.withColumn("lang", F.lit(None).cast("string")), model_file).collect()) == {"und"}
    kept = language_id.keep_identified(odd_docs, model_file)
    assert kept.columns == odd_docs.columns and kept.where("doc_id < 3").count() == 0


def test_near_duplicates(odd_docs, no_docs):
    rows = minmax_dedup.groups(odd_docs, 85).collect()
    assert len(rows) == N
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["n_shingles"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in (0, 1, 2))
    assert by[3]["n_shingles"] == 1 and by[8]["n_shingles"] == 2
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert by[4]["component_id"] is None and by[5]["component_id"] is None and not by[4]["kept"]
    assert minmax_dedup.groups(no_docs, 85).count() == 0
    kept = minmax_dedup.keep_first(odd_docs, 80)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is not None, x)) == [None, 0, 1, 2, 3, 6, 7, 8]
    twice = odd_docs.where("doc_id = 4")
    assert twice.count() == 2 and minmax_dedup.keep_first(twice, 80).count() == 1


def test_decontamination(odd_docs, no_docs, benchmark):
    by = {r["doc_id"]: r for r in decontamination.contamination(odd_docs, benchmark).collect()}
    assert [i for i, r in by.items() if r["contaminated"]] == [4, 5, None] and by[4]["item_ids"] == [1]
    assert decontamination.contamination(no_docs, benchmark).count() == 0
    assert decontamination.contamination(odd_docs, benchmark.limit(0)).where("contaminated").count() == 0
    kept = decontamination.drop_contaminated(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns and kept.count() == N - 4
    assert decontamination.drop_contaminated(odd_docs, benchmark.limit(0)).count() == N


def test_fingerprints(odd_docs, no_docs):
    rows = lz_fingerprint.compare_neighbours(odd_docs).collect()
    assert len(rows) == N
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_chars"] == 0 and by[0]["near_next"] == 1.0 and by[8]["n_chars"] == 80000
    assert by[4]["fingerprint"] == by[None]["fingerprint"] != by[5]["fingerprint"]
    end = TEXTS[8][:60000] + "The cat sat on the mat. The cat sat on the mat."
    assert by[8]["edited_sha256"] == hashlib.sha256(end.encode()).hexdigest()
    assert lz_fingerprint.compare_neighbours(no_docs).count() == 0
    one = lz_fingerprint.compare_neighbours(odd_docs.where("doc_id = 3")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"worw").hexdigest() and one["near_next"] == 1.0


def test_licences(odd_docs, no_docs):
    rows = license_scan.scan(odd_docs).collect()
    assert len(rows) == N and all(r["licence"] is None and r["n_matches"] == 0 for r in rows)
    assert license_scan.scan(no_docs).count() == 0


def test_sentencepiece(odd_docs, no_docs, model_file):
    by = {r["doc_id"]: r for r in sentencepiece_codec.digest(odd_docs, model_file).collect()}
    assert by[0]["n_tokens"] == by[1]["n_tokens"] == 2 and by[8]["decoded_sha256"] == hashlib.sha256(TEXTS[8].encode()).hexdigest()
    assert sentencepiece_codec.digest(no_docs, model_file).count() == 0
    assert sentencepiece_codec.encoded(odd_docs, model_file).columns[-2:] == ["token_ids", "n_tokens"]


def test_sharding(odd_docs, no_docs):
    rows = sharding.place(odd_docs, F.col("doc_id"), SHARDS, SHARD_SLOTS).collect()
    assert len(rows) == N and all(r["shard"] in SHARDS for r in rows)
    assert sharding.place(no_docs, F.col("doc_id"), SHARDS, SHARD_SLOTS).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://x.net", "http://x.net/", "https://example.com?q=/de/", "http://example.com/de/1", "http://badexample.com/de/1", "http://a.org/fr/", "http://a.org/fr/", "x" * 5000]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    by = {r["page_id"]: r for r in url_filters.judge(pages, URL_RULES).collect()}
    assert len(by) == len(urls) and all(r["verdict"] in ("allow", "block") for r in by.values())
    assert (by[0]["host"], by[0]["path"], by[2]["host"], by[3]["host"]) == ("", "", "", "")
    assert (by[4]["host"], by[4]["path"], by[4]["rule"], by[4]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert by[5]["rule"] is None and by[6]["rule"] == "net/" and by[6]["verdict"] == "block"
    assert (by[7]["host"], by[7]["path"], by[7]["rule"]) == ("example.com", "", None)
    assert by[8]["rule"] == "example.com/de/" and by[9]["rule"] is None and by[10]["verdict"] == by[11]["verdict"] == "allow"
    assert url_filters.judge(pages.limit(0), URL_RULES).count() == 0


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "one"), (1, 2, "user", "more"), (1, 3, "assistant", "two"), (1, 3, "assistant", "two"), (2, 0, "user", None), (3, 0, None, "x"), (None, 0, "assistant", ""), (4, None, "assistant", "only")]
    c = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id bigint, turn bigint, role string, text string, turns string")
    by = {r["conv_id"]: r for r in chat_formatting.preference_digest(c).collect()}
    assert len(by) == 5
    assert by[1]["n_prompt_turns"] == 5 and by[1]["chosen"] == ""  # the repeated turn answers with itself
    assert by[4]["prompt"] == "" and by[4]["rejected"] == "<|assistant|>\n<|end|>\n" and by[4]["chosen_spans"] == "14:25"
    assert by[2]["prompt"] == "<|user|>\n<|end|>\n"
    assert chat_formatting.preference_digest(c.limit(0)).count() == 0
    # rows without a conversation aren't one
    lone = c.where("conv_id IS NULL")
    assert chat_formatting.preference_digest(lone.unionAll(lone)).count() == 2
    assert chat_formatting.format_pairs(lone, lone, "conv_id").count() == 2
    a, b = c.where("conv_id = 1"), c.where("conv_id = 1 AND turn < 2 OR conv_id = 2")
    pairs = {r["conv_id"]: r for r in chat_formatting.format_pairs(a, b, "conv_id").collect()}
    assert pairs[1]["n_prompt_turns"] == 2 and pairs[1]["rejected"] == "" and pairs[2]["chosen"] == ""
