"""The registered queries over the smallest tables: against their SQL, or by what must hold for every row."""

import math

import duckdb
import pytest

from tarnwell.llm import queries

TABLES = "documents document_chunks chunk_embeddings paper_blocks qa_ablation_sample30 heldout_items name_list papers".split()
HOLDS = {
    "p1_found": ["chunk_id_a < chunk_id_b"],
    "p1_groups": ["group_id <= chunk_id", "copies >= 0 AND links >= 0"],
    "p2_found": ["vector_id_a < vector_id_b"],
    "p2_neighbours": ["vector_id % 50 = 0", "place BETWEEN 1 AND 10", "cosine BETWEEN -1.0001 AND 1.0001", "vector_id <> neighbour_id"],
    "p4_found": ["kind IN ('hyphen', 'ocr', 'header', 'page_number')"],
    "p4_paragraphs": ["trim(text) <> ''", "array_contains(blocks, paragraph)"],
    "p5_pieces": ["n_words <= 320 AND length(piece) <= 2400", "piece_index = 0 OR begin > 0", "`end` - begin = length(piece)"],
    "p6_packed": ["n_tokens <= 2048", "container_id IS NULL OR place + n_tokens <= 2048"],
    "p6_usage": ["n_tokens BETWEEN 1 AND 2048", "n_items >= 1"],
    "p8_found": ["kind IN ('email', 'phone', 'id_number', 'address', 'name')", "trim(surface) = surface AND surface <> ''"],
    "p8_masked": ["doc_id IS NOT NULL", "n_masked = 0 OR masked_text LIKE '%[%]%'"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, data, name):
    found = queries.QUERIES[name](spark, data)
    if name not in queries.SQL:
        found = found.cache()
        assert len(set(found.collect())) == found.count() if name.endswith("_found") else found.count() > 0
        for condition in HOLDS[name]:
            assert found.where(f"NOT coalesce({condition}, false)").limit(3).collect() == []
        found.unpersist()
        return
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    expected = connection.execute(queries.SQL[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(repr, map(tuple, found.select(*names).collect()))) == sorted(map(repr, expected.fetchall()))


def test_pieces_cover_their_texts(spark, data):
    """Pieces begin with the end of the one before, on a whole word where there is one, and leave out white space alone."""
    texts = {("block", r.id): r.content for r in spark.read.parquet(f"{data}/paper_blocks.parquet").select("id", "content").collect()}
    texts |= {("chunk", r.id): r.content for r in spark.read.parquet(f"{data}/document_chunks.parquet").select("id", "content").collect()}
    rows = {}
    for r in queries.QUERIES["p5_pieces"](spark, data).collect():
        rows.setdefault((r.item_kind, r.item_id), []).append(r)
    assert rows
    for key, own in rows.items():
        own.sort(key=lambda r: r.piece_index)
        assert [r.piece_index for r in own] == list(range(len(own))) and all(texts[key][r.begin : r.end] == r.piece for r in own)
        for a, b in zip(own, own[1:]):
            assert a.begin < b.begin and a.end < b.end and a.end - b.begin <= 120 and texts[key][a.end : b.begin].strip() == ""
        assert texts[key][: own[0].begin].strip() == "" and texts[key][own[-1].end :].strip() == ""


def test_containers_are_nearly_full(spark, data):
    rows = queries.QUERIES["p6_usage"](spark, data).collect()
    assert len(rows) <= math.ceil(sum(r.n_tokens for r in rows) / 2048) * 1.02 + 1
