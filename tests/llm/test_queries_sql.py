"""Queries that SQL can express, against their SQL."""

import pytest
from compare import connect, difference

from talusgrid.llm.queries import llm_queries, llm_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_query_matches_sql(spark, name):
    got = llm_queries()[name](spark, FOLDER).toPandas()
    assert difference(got, connect(FOLDER).execute(llm_sql()[name]).fetchdf()) is None


def test_each_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in llm_queries()) == list(range(1, 14))


def test_results_do_not_depend_on_partitions(spark):
    """Ids, texts and digests are the same when the table is dealt out otherwise."""
    from talusgrid.llm import mixing, ngram_join, substrings

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source")
    dealt = docs.repartition(5)
    for operator in (mixing.mix_plan, ngram_join.ngram_classes, substrings.repeat_counts):
        assert sorted(map(tuple, operator(docs).collect())) == sorted(map(tuple, operator(dealt).collect()))
