"""Each stage of the pipeline against brute force on its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import pii_crf, queries, sentencepiece_codec, winnow
from pairloom.sources.tables import table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    before = table(spark, SF, "documents")
    columns, kept = before.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, before, SF), name)
        rows = {r.doc_id: r for r in docs.collect()}
        old = {r.doc_id: r for r in before.collect()}
        assert set(rows) <= set(old)
        kept[name] = rows
        if name != "encode":
            assert docs.columns == columns
        if name == "quality_rules":
            words = {i: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for i, r in old.items()}
            assert all(len(words[i]) >= 50 for i in rows)
            labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
            assert all(i in rows for i, q in labels.items() if q == 1 and i in old and len(words[i]) >= 50)
        elif name == "near_dedup":
            from test_operators import _components

            _, at = _components([(i, r.text) for i, r in old.items()])
            assert set(rows) == {i for i in old if at[i] == i}
        elif name == "decontaminate":
            dirty = {r.doc_id for r in winnow.decontaminate(before, table(spark, SF, "benchmark")).where("contaminated").collect()}
            assert set(rows) == set(old) - dirty
        elif name == "redact_pii":
            assert set(rows) == set(old) and not any(pii_crf.base_spans(r.text) for r in rows.values())
            assert all(r.n_chars == len(r.text) for r in rows.values())
            assert all(r.text == old[i].text for i, r in rows.items() if not re.search("[0-9@]", old[i].text))
        else:
            decoder = sentencepiece_codec.Decoder(sentencepiece_codec.Pieces.load(queries.PIECES))
            assert all(decoder.decode(r.token_ids) == old[i].text for i, r in rows.items()) and set(rows) == set(old)
        before = docs
    assert len(kept["encode"]) == corpus_pipeline.run(spark, SF).count()


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, rows without a doc_id, and columns whose names the stages use."""
    prose = [r.text for r in table(spark, SF, "documents").where("length(text) > 400").limit(6).collect()]
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    long = " ".join(f"{w}{k}" for k in range(2_000) for w in words.split()) + " " + "9" * 10_000 + ".1.1.1"
    texts = [None, "", " \n ", prose[0], prose[0], prose[1], prose[2] + " mail a.b@c.example now", long, "x" * 100_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, prose[1]), (None, prose[3]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
    docs = docs.select("*", *(F.lit(7).cast("long").alias(n) for n in ("row_", "hit_", "words_", "items_", "kept", "n_words", "spans", "component_id")))
    for name, empty in (("some", False), ("none", True)):
        folder = f"{tmp_path}/{name}"
        (docs.where("false") if empty else docs).write.parquet(f"{folder}/documents.parquet")
        for other in ("benchmark", "labels"):
            df = table(spark, SF, other)
            (df.where("false") if empty else df).write.parquet(f"{folder}/{other}.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == ["doc_id", "n_tokens", "token_ids", "round_trip"]
        ids = [r.doc_id for r in out.collect()]
        assert all(r.round_trip for r in out.collect()) and ids == [] if empty else ids.count(5) <= 1 and ids.count(4) == 0 and not {0, 1, 2} & set(ids)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_docstrings_state_the_odd_cases(name, stage):
    assert "null" in stage.__doc__.lower() and "empty" in stage.__doc__.lower() and "repeated" in stage.__doc__.lower()
