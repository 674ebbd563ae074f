"""Queries against their SQL checks, and the pipeline stage by stage."""

import re

import duckdb
import pytest

import corpus_pipeline
from lactoscope.llm import simhash
from lactoscope.llm.queries import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, database, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    cursor = database.execute(CHECKS[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in frame.collect()) == expected


def test_one_query_for_each_operator():
    assert [sum(name.startswith(f"op{n}_") for name in QUERIES) for n in range(1, 14)] == [1] * 13
    assert len(QUERIES) == 13


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.dtypes == docs.dtypes
            sizes.append(after.count())
        if i == 1:
            # One document of each component, and every component keeps one.
            groups = simhash.near_groups(docs).collect()
            assert sorted(r.doc_id for r in after.collect()) == sorted({r.component_id for r in groups})
        if i == 2:
            seen = set()
            for r in after.orderBy("doc_id").collect():
                w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
                windows = {tuple(w[k : k + 50]) for k in range(len(w) - 49)}
                assert not windows & seen and r.n_chars == len(r.text)
                seen |= windows
        docs = after
    assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert docs.select("doc_id").distinct().count() == sizes[-1]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0] and columns == ["doc_id", "text", "lang", "source", "n_chars"]
