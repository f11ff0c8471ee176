"""All queries over odd and empty tables, and SQL where there is some."""

import pytest
from compare import connect, differences

import corpus_pipeline
from folio.llm.queries import oracle_sql, queries

NAMES = sorted(queries())


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_all_come_back(spark, odd, name):
    rows = queries()[name](spark, odd).collect()
    table = "pages" if name.startswith("op7") else "documents"
    ids = [r[0] for r in spark.read.parquet(f"{odd}/{table}.parquet").select("page_id" if table == "pages" else "doc_id").collect()]
    if name.startswith("op1_"):
        assert {r.doc_id for r in rows if r.is_secret} == {10}
    elif name.startswith("op10_"):
        assert sum(r.length for r in rows if r.doc_id == 6) == 3 * rows[[r.doc_id for r in rows].index(6)].doc_tokens
        assert {r.doc_id for r in rows} == set(ids)
    else:
        assert sorted((r[0] for r in rows), key=str) == sorted(ids, key=str)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_empty_results(spark, empty, name):
    assert queries()[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, odd, data, name):
    assert differences(queries()[name](spark, data), connect(data), oracle_sql()[name]) == ""


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, odd)
        assert kept.schema.names == docs.schema.names and kept.count() <= before.count()
    texts = [r.text for r in kept.collect()]
    assert None not in texts and not any("11acdfb36bb7" in t for t in texts)
