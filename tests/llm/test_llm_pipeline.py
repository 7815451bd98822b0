"""The pipeline's stages on their own input, and the registered queries against their SQL."""

import corpus_pipeline
import duckdb
import pytest
from bizlake.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(catalog.SQL))
def test_sql(spark, key):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want, got = con.execute(catalog.SQL[key]).df(), catalog.QUERIES[key](spark, SF).toPandas()
    by = [c for c in ("doc_id", "conv_id", "depth") if c in want.columns]
    want, got = (rows.sort_values(by).reset_index(drop=True) for rows in (want, got))
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for column in got.columns:
        assert (got[column] == want[column]).all(), column


def test_stages_keep_columns_and_rows(spark, hard, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, hard, empty):
            out = stage(spark, table, SF)
            assert out.count() <= table.count()
            if name != "mixing":
                assert out.columns == table.columns


NAMES = ["rules", "n_lines", "n_dropped", "_text_hash", "_doc", "_hash", "_text_id", "row", "text_id", "h", "hash", "id", "_lines", "x.y", "template", "size"]


def test_clashing_columns_keep_their_values(spark, hard):
    docs = hard.select("doc_id", "text", "lang", "source").selectExpr("*", *[f"concat('{n} of ', coalesce(cast(doc_id AS string), 'none')) AS `{n}`" for n in NAMES])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns + (["copies", "taken"] if name == "mixing" else [])
        rows = out.collect()
        assert rows
        for r in rows:
            own = "none" if r["doc_id"] is None else r["doc_id"]
            assert [r[n] for n in NAMES] == [f"{n} of {own}" for n in NAMES], name
        want = {(r["doc_id"], r["lang"], r["source"]) for r in docs.collect()}
        assert {(r["doc_id"], r["lang"], r["source"]) for r in rows} <= want


def test_near_duplicates_keep_one(spark, hard):
    kept = corpus_pipeline.near_duplicates(spark, hard, SF).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids and ids.count(8) == 1 and 9 not in ids
    assert {4, 5, 6, 7, 11, 12} <= set(ids)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "copies", "taken"} <= set(out.columns) and 0 < out.count() <= 200
