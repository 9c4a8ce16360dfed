"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for all operators and stages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tempograph.llm")
from tempograph.llm import ctw, jaccard, langid, licences, mixing, packing, pii, quality, sharding, topk  # noqa: E402
from tempograph.llm.common import drop_stored, stored  # noqa: E402

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000 + "end"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "one two three", "en", "b", 13), (4, "one two three", "en", "b", 13), (None, "a null id here", "de", None, 1),
    (5, LONG, "en", "a", len(LONG)), (6, "naïve café – “quotes” \U0001f600 done", None, "b", 1), (7, "The MIT License. Released under the MIT License.\nx@y.example.com", "en", "b", 1),
]
CLASH = ["rank", "shard", "slot", "size", "key", "group", "kept", "component_id", "block", "id", "score", "d2", "target", "taken", "_h", "words"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def score(docs):
    return ctw.score(docs.withColumn("train", F.lit(True)))


def mixture(docs):
    sizes = docs.withColumns({"id": F.col("doc_id"), "size": F.size(F.split(F.coalesce("text", F.lit("")), " ")).cast("long")})
    return mixing.taken(*mixing.pieces(sizes, block_words=16))


OPERATORS = {
    "quality": lambda d: quality.quality_rules(d), "packing": lambda d: packing.pack(d, P.path("word_bpe_49k.json")),
    "sharding": lambda d: sharding.interleave(sharding.keys_of(d), 3), "pii": lambda d: pii.pseudonymise(d, "k"), "licences": lambda d: licences.scan(d),
    "jaccard": lambda d: jaccard.near_duplicates(d), "ctw": score, "mixing": mixture,
}
ROWS = {"quality": 9, "sharding": 9, "pii": 9, "jaccard": 9, "ctw": 9, "mixing": 9}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    rows = OPERATORS[name](odd).collect()
    assert len(rows) == ROWS.get(name, len(rows)) and rows


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(none, name):
    assert OPERATORS[name](none).collect() == []


def test_empty_tables_of_the_others(spark):
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(v, v).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    model = langid.train(spark.createDataFrame([], "lang string, text string"))
    assert langid.identify(pages, model).collect() == []


def test_quality_of_odd_rows(odd):
    got = {(r.doc_id, r.n_words): r for r in OPERATORS["quality"](odd).collect()}
    assert got[1, 0].base_failed and got[3, 0].base_failed and not got[1, 0].kept
    assert got[5, 30_001].n_repeat_words == 30_000 and got[5, 30_001].base_failed


def test_near_duplicates_of_odd_rows(odd):
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in OPERATORS["jaccard"](odd).collect()), key=str)
    assert (1, 0, 1) in got and (2, 0, 2) in got and got.count((4, 1, 4)) == 2 and (None, 1, None) in got and (5, 2, 5) in got


def test_sharding_of_odd_rows(odd):
    rows = OPERATORS["sharding"](odd).collect()
    assert sorted(sum(r.shard == s for r in rows) for s in range(3)) == [3, 3, 3]
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == [0, 1, 2]


def test_packing_of_odd_rows(odd):
    rows = OPERATORS["packing"](odd).collect()
    empty = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert [r.doc_tokens for r in empty] == [1, 1, 1] and all(r.ids == b"\x01\0\0\0" for r in empty)
    assert sum(r.length for r in rows if r.doc_id == 5) == 30_002


def test_stages(spark, odd, none, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    for docs in (spark.createDataFrame(ODD, SCHEMA), odd.withColumns({c: F.lit(1) for c in ("n_words", "pii_kinds", "text_key", "runs", "_copy", "rep", "key", "row", "_row", "copy", "kept")}), none):
        for name, stage in pipeline.STAGES:
            out = stored(stage(spark, docs, sf_dir), f"test_{name}")
            assert name == "packing" or out.columns == docs.columns
            rows = out.collect()
            if name != "packing" and "_copy" in docs.columns:
                assert {tuple(r[c] for c in ("_copy", "key", "row", "kept", "pii_kinds")) for r in rows} <= {(1,) * 5}, "callers' columns stay"


def test_stored_files_can_be_dropped(spark):
    df = stored(spark.range(3), "x")
    assert df.count() == 3
    drop_stored(spark)
    with pytest.raises(Exception, match="does not exist|FileNotFound|FILE_NOT_EXIST|No such file"):
        df.collect()
