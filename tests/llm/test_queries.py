"""Registered queries: SQL ones against DuckDB, the pipeline against a plain version."""

import os

import duckdb
import pytest

import corpus_pipeline
from loomwell.llm import common, pii, queries, toxicity
from loomwell.llm.shingle import shingles as shingle_list
from loomwell.session import ship

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchall()
    names = [d[0] for d in con.description]
    got = [tuple(r) for r in queries.queries()[name](ship(spark), SF).select(names).collect()]
    assert sorted(got) == sorted(want)


def test_held_out_accuracy(spark):
    out = {r.doc_id: r for r in queries.op1_toxicity(ship(spark), SF.replace("0.001", "0.01")).collect()}
    labels = {r.doc_id: r.toxic for r in common.table(spark, SF.replace("0.001", "0.01"), "labels").collect()}
    held = [(out[i].predicted, y) for i, y in labels.items() if out[i].held_out]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)


def test_pipeline_stages(spark):
    ship(spark)
    docs = common.table(spark, SF, "documents")
    cols = docs.columns
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == cols
    model = toxicity.train(docs, common.table(spark, SF, "labels"))
    scorer = toxicity.Scorer(model)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect() if scorer.score(r.text or "") < 0.5}
    near = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert near.columns == cols
    kept = {r.doc_id: r.text for r in near.collect()}
    texts = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    first = {}
    for i, t in texts:
        first.setdefault(t, i)
    assert all(t in first and first[t] == i for i, t in kept.items())  # one of each group of copies

    def shingles(t):
        return set(shingle_list(t.encode(), 5))

    whole = {i: shingles(t) for i, t in texts}
    unlike = {i for i, s in whole.items() if all(i == j or len(s & o) < 0.8 * len(s | o) for j, o in whole.items())}
    assert unlike <= kept.keys()  # clean documents stay
    rest = corpus_pipeline.drop_contaminated(spark, docs, SF)
    hit = {r.doc_id for r in queries.op8_decontaminate(spark, SF).collect() if r.contaminated}
    assert rest.columns == cols and {r.doc_id for r in rest.collect()} == {i for i, _ in texts} - hit
    masked = corpus_pipeline.mask_personal_data(spark, docs, SF).collect()
    assert not any(pii.base_spans(r.text) for r in masked)


def test_pipeline_runs_and_survives_odd_rows(spark, tmp_path):
    ship(spark)
    for t in ("labels", "benchmark"):
        common.table(spark, SF, t).write.parquet(f"{tmp_path}/{t}.parquet")
    odd = [(1, None, "en", "s", None), (None, None, "en", "s", 1), (None, "x y", "en", "s", 3), (2, "x y", "en", "s", 3), (2, "x y", "en", "s", 3), (3, "", None, None, 0)]
    spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 2}
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("none", ["documents", "labels", "benchmark"])
def test_pipeline_on_empty_tables(spark, tmp_path, none):
    ship(spark)
    rows = [(k, f"text number {k} of a few " + "word " * k, "en", "s", None) for k in range(5)]
    tables = {
        "documents": spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, "a text that no document holds")], "item_id long, text string"),
    }
    for name, df in tables.items():
        (df.limit(0) if name == none else df).write.parquet(f"{tmp_path}/{name}.parquet")
    left = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in left} == (set() if none == "documents" else set(range(5)))
