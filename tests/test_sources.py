import json

import pytest
from pyspark.sql import functions as F

from tarnwell.sources import formats
from tarnwell.streaming import ingest

FEED = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2401.00001v1</id><updated>2024-01-02T00:00:00Z</updated><published>2024-01-01T00:00:00Z</published>
<title>A  Title
 here</title><summary> Some
 words </summary><author><name>Jane Smith</name></author><author><name>Joe</name></author><category term="cs.IR"/><link title="pdf" href="https://x/pdf/1" rel="related"/></entry></feed>"""


def test_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("\n## Head \nbody")
    (tmp_path / "sub" / "b.txt").write_text("plain title\nbody")
    (tmp_path / "c.txt").write_text("  \n")
    (tmp_path / "d.pdf").write_text("no")
    assert sorted(r.title for r in formats.text_files(spark, str(tmp_path)).collect()) == ["Head", "plain title"]


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FEED)
    paper = formats.atom_feed(spark, str(tmp_path / "f.xml")).first()
    assert (paper.arxiv_id, paper.title, paper.abstract, paper.authors, paper.categories, paper.pdf_url) == ("2401.00001v1", "A Title here", "Some words", ["Jane Smith", "Joe"], ["cs.IR"], "https://x/pdf/1")
    spark.dataSource.register(formats.FeedSource)
    assert spark.read.format("stored_feed").load(str(tmp_path)).count() == 1


def test_json_inputs(spark, tmp_path):
    gold = tmp_path / "g.json"
    gold.write_text(json.dumps([{"query": " q ", "gold_chunk_ids": [1]}, {"id": "x", "query": "r", "category": "c"}]))
    assert sorted((r.id, r.query, r.category) for r in formats.gold_cases(spark, str(gold)).collect()) == [("qa-0001", "q", "unknown"), ("x", "r", "c")]
    gold.write_text(json.dumps([{"query": ""}]))
    with pytest.raises(Exception, match="no query"):
        formats.gold_cases(spark, str(gold)).collect()
    judges = tmp_path / "j.json"
    judges.write_text(json.dumps([{"qa_id": "a", "variant": "v", "answer_correct": False, "citation_correct": True}, {"qa_id": "a", "variant": "v", "answer_correct": True, "citation_correct": True}]))
    assert [r.answer_correct for r in formats.judge_labels(spark, str(judges)).collect()] == [True]
    cases = tmp_path / "c.jsonl"
    cases.write_text('{"query": "a", "relevant_chunk_ids": [1]}\n\n{"query": "b"}\n')
    with pytest.raises(Exception, match="no relevant ids for: b"):
        formats.relevance_cases(spark, str(cases)).collect()
    one = spark.createDataFrame([('["a", "b"]',), ("a",), (None,)], "v string").select(formats.lenient_array(F.col("v")).alias("v"))
    assert [r.v for r in one.collect()][0] == ["a", "b"]


def test_files(spark, tmp_path):
    for n in (3, 1, 2):
        (tmp_path / f"{n}.pdf").write_bytes(b"x" * n)
    assert [r.length for r in formats.smallest_files(spark, str(tmp_path), 2).collect()] == [1, 2]
    assert formats.file_hashes(spark, str(tmp_path)).count() == 3


def test_streams(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    docs = lambda rows: spark.createDataFrame(rows, "id long, content string")
    docs([(1, "one text"), (2, "two")]).write.parquet(str(source))
    ingest.chunk_new_documents(spark, str(source), target, str(tmp_path / "check"))
    docs([(3, "two"), (4, "three")]).write.mode("append").parquet(str(source))
    ingest.chunk_new_documents(spark, str(source), target, str(tmp_path / "check"))
    assert sorted(r.content for r in spark.read.parquet(target).collect()) == ["one text", "three", "two"]
