import duckdb
import pytest

import __spark_entry__ as entry
from tarnwell.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings papers paper_documents paper_blocks document_chunks chunk_embeddings qa_ablation_sample30 heldout_items name_list".split()


#: What holds for every row of the queries that SQL does not compute.
HOLDS = {
    "block_shapes": ["id IS NOT NULL", "code IS NOT NULL AND formula IS NOT NULL AND authors IS NOT NULL"],
    "markdown_parsed": ["order_index >= 0", "length(content_hash) = 64", "block_type = 'image_reference' OR trim(content) <> ''", "NOT (should_embed AND block_type IN ('title', 'authors', 'affiliation'))"],
    "lines_parsed": ["order_index >= 0", "length(content_hash) = 64", "trim(content) <> ''", "page_number >= 1"],
    "planned_units": ["chunk_index >= 0", "token_count >= 1", "length(content_hash) = 64", "size(source_block_ids) >= 1", "chunk_type <> 'fused_evidence' OR size(source_chunk_ids) = 2", "page_from IS NULL OR page_from <= page_to"],
    "planning_windows": ["`window` >= 0"],
    "boundaries_repaired": ["trim(content) <> ''"],
    "boundary_sources": ["trim(content) <> ''", "source_block_ids IS NULL OR size(source_block_ids) = size(array_distinct(source_block_ids))"],
    "boundaries_validated": ["trim(content) <> ''", "piece >= 0", "NOT (trim(element_at(split(content, '\\\\n'), -1)) RLIKE '^##\\\\s+[0-9]+(\\\\.[0-9]+)*\\\\s+.+$' AND size(split(content, '\\\\n')) > 1)"],
    "hybrid_hyde_rerank_search": ["rank BETWEEN 1 AND 10", "score BETWEEN 0 AND 1"],
    "graded_results": ["query_id IS NOT NULL", "score BETWEEN 0 AND 1", "relevant OR NOT sufficient"],
    "neighbours_held": ["id IS NOT NULL AND held IS NOT NULL"],
    "extracted_keywords": ["size(keywords) <= 4", "size(keywords) = size(array_distinct(keywords))"],
}


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def tables(data):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return connection


def compare(spark, data, tables, name, function, sql):
    found = function(spark, data)
    expected = tables.execute(sql)
    columns = sorted(found.columns)
    assert columns == sorted(c[0] for c in expected.description)
    at = [[c[0] for c in expected.description].index(c) for c in columns]
    key = lambda r: repr(r)
    assert sorted((tuple(plain(v) for v in r) for r in found.select(*columns).collect()), key=key) == sorted((tuple(plain(r[i]) for i in at) for r in expected.fetchall()), key=key)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, data, tables, name):
    function = catalogue.QUERIES[name]
    if name in catalogue.SQL:
        compare(spark, data, tables, name, function, catalogue.SQL[name])
    else:
        found = function(spark, data).cache()
        assert found.count() > 0
        for condition in HOLDS[name]:
            assert found.where(f"NOT coalesce({condition}, false)").limit(3).collect() == []
        found.unpersist()


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
