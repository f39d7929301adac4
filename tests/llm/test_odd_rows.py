"""Every stage and operator over nulls in any column, empty and very long texts, ties, repeated rows, empty tables and columns
whose names clash with those that the operators use inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import shards, simhash, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, item string, node long, fp long, kind string, root long, id string, v double, key string, part int, cell int, h long, start long, length string"
TEXT = "some words that make a sentence of more than five words"


def rows():
    def row(i, t, lang="en", source="s"):
        return (i, t, lang, source, len(t) if t is not None else None, "r", None, 1, 2, "k", 3, "i", 0.5, "q", 4, 5, 6, 7, "l")

    out = [row(1, None), row(2, ""), row(None, TEXT), row(4, TEXT, None, None), row(4, TEXT, None, None), row(5, TEXT.upper()), row(6, "x"), row(7, "word " * 200_000 + "a@b.org"), row(8, " \n\t "), row(None, None, None, None)]
    return out + [row(10 + i, f"number {i} of a few other texts that are not like each other {i * i} {'pq' * i}") for i in range(12)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(10, 1, 0), (11, 0, 0), (12, None, 1), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, TEXT, 2), (2, None, 3), (None, "x", 4), (3, "", 5)], "item_id long, text string, row int").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, folder, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = run(spark, docs, folder)
    got = out.collect()
    texts = sorted(str(r[1]) for r in rows())
    if stage == "best-fit packing":
        assert {r.doc_id for r in got} == {r[0] for r in rows()} and sum(r.piece == 0 for r in got) == len(rows())
    else:
        assert out.columns == docs.columns
    if stage == "SimHash near-dedup":
        assert sorted(str(r.text) for r in got if str(r.text).lower() == TEXT) == [TEXT] and sum(not (r.text or "").strip() for r in got) == 1
    if stage == "benchmark decontamination":
        assert sorted(str(r.text) for r in got) == [t for t in texts if t.lower() != TEXT]
    if stage == "PII":
        assert len(got) == len(rows()) and all(len(r.text or "") == (r.n_chars or 0) for r in got) and "a@b.org" not in max((r.text or "" for r in got), key=len)
    empty = run(spark, docs.limit(0), folder)
    assert empty.count() == 0 and (stage == "best-fit packing" or empty.columns == docs.columns)


def test_operators(spark, tmp_path):
    import public_tokenizers

    docs = spark.createDataFrame(rows(), SCHEMA)
    assert simhash.near_duplicates(docs).count() == len(rows()) and simhash.near_duplicates(docs.limit(0)).count() == 0
    assert shards.shard_documents(docs).count() == len(rows())
    at = "file://" + str(tmp_path / "ids")
    token_files.write_token_files(docs, at, public_tokenizers.path("word_bpe_49k.json"))
    got = token_files.read_token_files(spark, at).orderBy("start").collect()
    assert len(got) == len(rows()) and [r.doc_id for r in got][:2] == [None, None] and all(len(r.ids) == 4 * r.n_tokens for r in got)
    assert token_files.read_token_files(spark, at).agg(F.sum("n_tokens")).first()[0] == got[-1].start + got[-1].n_tokens


def test_hot_keys_by_an_absolute_bound(spark, monkeypatch):
    """Large tables split a key by rows, whatever its share; the rows of a salted join stay the same."""
    from tidewater.llm import common

    many = spark.range(4000).selectExpr("id", "if(id % 3 = 0, 0, id % 1000) AS k")
    few = common.staged(spark.range(1000).selectExpr("id AS k", "id * 2 AS v"))
    plain = sorted(many.join(few, "k").collect())
    monkeypatch.setattr(common, "BROADCAST", -1)
    assert {r.k: r["__parts"] for r in common.hot_keys(many.select("k"), "k").collect()} == {0: 86}
    assert sorted(common.salted_join(many, few, "k", many.id).collect()) == plain
    monkeypatch.setattr(common, "HOT", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 500)
    assert {r.k: r["__parts"] for r in common.hot_keys(many.select("k"), "k").collect()} == {0: 3}
    assert sorted(common.salted_join(many, few, "k", many.id).collect()) == plain
    monkeypatch.setattr(common, "MOST", 3)
    assert {r.k: r["__parts"] for r in common.hot_keys(many.select("k"), "k").collect()} == {0: 2}
