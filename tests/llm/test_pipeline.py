"""The pipeline's stages on the smallest tables and on odd rows."""

import duckdb
import pytest

import corpus_pipeline
from posequarry.llm import queries, toxicity
from tests.llm.test_operators import FOLDER, ODD, SCHEMA, check_mix
from tests.llm.test_shingles import kept as similar_kept
from tests.oracle import canonical, connect

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        kept.append(docs)
        if k < 3:
            assert docs.columns == COLUMNS
    everything = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.learn(everything, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    clean = {r["doc_id"] for r in everything.collect() if model.score(r["text"]) < 0.7}
    assert {r["doc_id"] for r in kept[0].collect()} == clean
    assert sorted(r["doc_id"] for r in kept[1].collect()) == similar_kept([(r["doc_id"], r["text"]) for r in kept[0].collect()])
    mixed = queries.mixing.mix(kept[1]).collect()
    check_mix(mixed)
    assert sorted(r["doc_id"] for r in kept[2].collect()) == sorted(r["doc_id"] for r in mixed for _ in range(r["copies"]))
    assert kept[3].count() == kept[2].count() and kept[3].filter("lossless").count() == kept[3].count()


def test_odd_rows(spark):
    labels_only = FOLDER
    for rows in (ODD, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs.columns
            docs = stage(spark, docs, labels_only)
            if k < 3:
                assert docs.columns == before
            n = docs.count()
            assert n <= 2 * len(rows)
            if k == 1 and rows:
                # Blank texts, the two sentences and the three others are one document each.
                assert n == 5


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    tables = connect(FOLDER)
    result = tables.execute(queries.SQL[name])
    want = canonical([d[0] for d in result.description], result.fetchall())
    df = queries.QUERIES[name](spark, FOLDER)
    assert canonical(df.columns, df.collect()) == want
    assert duckdb is not None
