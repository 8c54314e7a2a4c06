"""The pipeline against brute force on a small fixture."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from maskwell.llm import language_id, mixing, simhash


@pytest.fixture(scope="module")
def steps(spark, sf):
    """The documents, and what each stage leaves of them."""
    from maskwell.llm import common

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out.append(common.materialise(stage(spark, out[-1], sf), name))
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps)


def test_each_stage(steps):
    docs, known, distinct, sparse, mixed = steps
    assert ids(known) == Counter(r["doc_id"] for r in language_id.identify_languages(docs).filter("lang_pred <> 'und'").collect())
    last = {}
    for r in known.collect():
        last[r["text"] or ""] = max(r["doc_id"], last.get(r["text"] or "", -1))
    assert ids(distinct) == Counter(last.values())
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in distinct.collect()}
    group = {i: i for i in prints}
    for a in sorted(prints):
        for b in sorted(prints):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    assert ids(sparse) == Counter(set(group.values()))
    assert ids(mixed) == Counter({r["doc_id"]: r["copies"] for r in mixing.mix_documents(sparse).collect() if r["copies"]})


def test_language_stage_ignores_scores(spark, monkeypatch):
    """Four families in a cycle: the winner's score is under 0.25, and the text stays."""
    import numpy as np

    model = language_id.Hierarchy(np.zeros((0, language_id.FEATURES), np.float32), [])
    row = lambda bias: np.eye(1, language_id.FEATURES + 1, language_id.FEATURES)[0] * bias
    model.families, model.members = ["a", "b", "c", "d"], {f: ["x", "y"] for f in "abcd"}
    model.family_rows = np.array([row(b) for b in (-50, 1e-6, 1e-6, 1e-6, -100, 1e-6)])
    model.lang_rows = {f: np.array([row(1e-6)]) for f in "abcd"}
    assert 0 < model.predict("a text")[1] < 0.25
    monkeypatch.setattr(language_id, "train", lambda docs: model)
    docs = spark.createDataFrame([(1, "a text", "en"), (2, "12 34", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    assert ids(corpus_pipeline.language_stage(spark, docs, "")) == {1: 1}


def test_run(spark, sf, steps):
    got = corpus_pipeline.run(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in steps[0].collect()}
    assert Counter(r["doc_id"] for r in got) == ids(steps[-1])
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in got)


def test_odd_tables(spark, steps):
    """Nulls, repeats, clashing names and no rows at all."""
    from pyspark.sql import functions as F

    from maskwell.llm import common

    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "same words here for all", "en", "a", 1), (2, "same words here for all", "en", "a", 1), (3, "same words here for all", None, "b", 1), (None, "other words that stand alone", "fr", None, 1), (4, "12 34", "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({k: F.lit("x") for k in ("maskwell_row", "digest", "fp", "place", "copies")})
    for table in (docs, docs.filter("text is null"), docs.filter("false"), docs.withColumn("lang", F.lit(None).cast("string"))):
        got = corpus_pipeline.run_on(spark, table).collect()
        if table is docs:
            assert {r["doc_id"] for r in got} <= {3, None} and {r["decoded_sha256"] for r in got} <= {hashlib.sha256(t.encode()).hexdigest() for t in ("same words here for all", "other words that stand alone")}
            assert got
        else:
            assert not got
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    before = common.written()
    corpus_pipeline.run_on(spark, docs.filter("false"))
    assert common.written() - before <= 1  # only the table that the last stage reads is left


def test_encoding_stage(spark, steps):
    got = corpus_pipeline.encoding_stage(spark, steps[-1], "").collect()
    texts = Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in steps[-1].select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in got) == texts
