import hashlib

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import hashing, measures, text


def value(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in row.items())).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("content", "noise"),
    [
        ("", True), ("  ", True), ("12", True), ("xii", False), ("IV", True), ("Page 3 of 9", True), ("3 · Some header", True), ("Some header • 12", True), ("March 2021", True), ("12 May 2020", True),
        ("2021-03-04", True), ("arXiv:2401.1", True), ("All Rights Reserved by X", True), ("*,†", True), ("1, 2, 3", True), ("A plain sentence.", False), ("12\n13", False), ("| 12 |", False), ("²", True),
    ],
)
def test_noise(spark, content, noise):
    assert value(spark, text.is_noise(F.col("c")), c=content) is noise


@pytest.mark.parametrize(
    ("content", "order", "kind"),
    [
        ("A Title", 0, "title"), ("Jane Smith and Joe Miller", 2, "authors"), ("Department of Physics", 3, "affiliation"), ("Abstract", 9, "abstract"), ("2 Related Work", 9, "section_title"), ("References", 9, "reference"),
        ("Figure 3: a plot", 9, "figure_caption"), ("Table 2: values", 9, "table_caption"), ("| a | b |", 9, "table"), ("Algorithm 1 sort", 9, "algorithm"), ("def f(x):\n    return x", 9, "code"), ("x = y + \\alpha", 9, "formula"),
        ("[1] A. Author", 9, "reference"), ("- item", 9, "list"), ("plain words follow here", 9, "paragraph"), ("", 4, "unknown"),
    ],
)
def test_block_kind(spark, content, order, kind):
    assert value(spark, text.block_kind(F.col("c"), F.col("o")), c=content, o=order) == kind


def test_text_pieces(spark):
    assert value(spark, text.sanitized(F.col("c")), c="abc\x00d\te\r\nf\x85") == "abcd\te\r\nf"
    assert value(spark, text.heading_section(F.col("c")), c="\n##  A &amp; B \nrest") == "A & B"
    assert value(spark, text.heading_section(F.col("c")), c="# A") is None
    assert value(spark, text.visual_refs(F.col("c")), c="see Fig. 2, figure 3 and TABLE 1, Fig 2") == ["Fig. 2", "Fig. 3", "Table 1", "Fig. 2"]
    assert value(spark, text.embedded_caption(F.col("c")), c="https://x.y/z Table 2: rows").asDict() == {"prefix": "https://x.y/z", "caption": "Table 2: rows", "kind": "table_caption"}
    assert value(spark, text.embedded_caption(F.col("c")), c="We show Table 2: rows") is None
    assert value(spark, text.keywords_of(F.col("c")), c="The BM25 Model beats Dense by 3.5% and BM25") == ["BM25", "Model", "Dense", "3.5"]
    assert value(spark, text.query_terms(F.col("c")), c="What does section 3.1 say about RAG and it?") == ["3.1", "say", "rag", "and"]
    assert value(spark, text.token_estimate(F.col("c")), c="   ") == 1
    assert value(spark, text.table_is_regular(F.col("c")), c="| a | b |\n| --- | --- |\n| 1 | 2 |") is True
    assert value(spark, text.field_of(F.col("c"), "arXiv ID"), c="# T\n\narXiv ID: 2401.1v1 \nx") == "2401.1v1"


def test_hashes(spark):
    assert value(spark, hashing.content_hash(F.col("c")), c="  a\r\nb \n") == hashlib.sha256(b"a\nb").hexdigest()
    key = value(spark, hashing.request_key("ask", query=hashing.json_text(F.col("c")), k=F.lit("3")), c='a "b"')
    assert key == "ask:" + hashlib.sha256(b'{"k": 3, "query": "a \\"b\\""}').hexdigest()


def test_measures(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in range(10)] + [("b", None)], "g string, v double")
    found = {r.g: r for r in rows.groupBy("g").agg(measures.nearest_rank(F.col("v"), 50).alias("p50"), measures.nearest_rank(F.col("v"), 95).alias("p95"), measures.mean4(F.col("v")).alias("m")).collect()}
    assert (found["a"].p50, found["a"].p95, found["a"].m) == (4.0, 9.0, 4.5)  # 4.5 goes to the even rank
    assert (found["b"].p50, found["b"].m) == (0.0, 0.0)
    one = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert one.select(measures.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.70710678)
