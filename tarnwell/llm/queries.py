"""The queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import leakage, neardup, packing, pii, scans, splitting, terms, vectors
from tarnwell.sources.tables import load_table, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _documents(spark: SparkSession, data_dir: str) -> DataFrame:
    return spread(load_table(spark, data_dir, "documents").select("doc_id", "text"))


def _blocks(spark: SparkSession, data_dir: str) -> DataFrame:
    return spread(load_table(spark, data_dir, "paper_blocks").select("id", "paper_id", "block_type", "page_number", "order_index", "content"))


def _chunks(spark: SparkSession, data_dir: str) -> DataFrame:
    return spread(load_table(spark, data_dir, "document_chunks").select("id", "content", "source_block_ids"))


def query(name: str, sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


# 3: frequency of every term

_TERMS_SQL = """
WITH records AS (
    SELECT DISTINCT ON (field_name, record) field_name, record, phrases FROM (
        SELECT 'keywords' AS field_name, CAST(id AS VARCHAR) AS record, keywords AS phrases FROM document_chunks
        UNION ALL SELECT 'gold_keywords', id, gold_keywords FROM qa_ablation_sample30)),
rows AS (
    SELECT field_name, record, trim(regexp_replace(lower(phrase), '\\s+', ' ', 'g')) AS term
    FROM (SELECT field_name, record, unnest(phrases) AS phrase FROM records)),
kept AS (SELECT * FROM rows WHERE term <> ''),
totals AS (SELECT field_name, count(DISTINCT record) AS all_records FROM kept GROUP BY 1),
counted AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT record) AS records FROM kept GROUP BY 1, 2),
marked AS (
    SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records * 100 > all_records * 5 THEN 'common' END AS mark
    FROM counted JOIN totals USING (field_name))
"""


def _term_fields(spark: SparkSession, data_dir: str) -> list[tuple[DataFrame, str, str, str]]:
    return [
        (load_table(spark, data_dir, "document_chunks"), "keywords", "id", "keywords"),
        (load_table(spark, data_dir, "qa_ablation_sample30"), "gold_keywords", "id", "gold_keywords"),
    ]


@query("p3_found", _TERMS_SQL + "SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL")
def p3_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Terms too rare or too common for retrieval."""
    marked = p3_terms(spark, data_dir)
    return marked.where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


@query("p3_terms", _TERMS_SQL + "SELECT field_name, term, occurrences, records, all_records, mark FROM marked")
def p3_terms(spark: SparkSession, data_dir: str) -> DataFrame:
    """Occurrences, records and mark of every term."""
    counted = terms.with_totals(terms.cut_counts(_term_fields(spark, data_dir)))
    return counted.withColumn("mark", terms.mark(F.col("records"), F.col("all_records")))


@query(
    "p3_phrase_parts",
    _TERMS_SQL
    + """, words AS (SELECT field_name, record, string_split(term, ' ') AS w FROM kept),
parts AS (
    SELECT field_name, record, array_to_string(w[i : i + n - 1], ' ') AS term
    FROM (SELECT *, unnest(range(1, len(w) - i + 2)) AS n FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words)))
SELECT field_name, term, count(*) AS occurrences, count(DISTINCT record) AS records FROM parts GROUP BY 1, 2""",
)
def p3_phrase_parts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Occurrences and records of all word sequences within the terms, of any length."""
    counted = terms.phrase_counts(_term_fields(spark, data_dir), parts_up_to=0)
    return counted.where(F.col("term").isNotNull()).select("field_name", "term", "occurrences", "records")


# 5: oversized items

_OVERSIZED_SQL = """
WITH items AS (
    SELECT DISTINCT 'block' AS item_kind, id AS item_id, content FROM paper_blocks
    UNION ALL SELECT DISTINCT 'chunk', id, content FROM document_chunks)
SELECT item_kind, item_id FROM items
WHERE length(content) > 2400 OR len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) > 320
"""


def _items(spark: SparkSession, data_dir: str) -> DataFrame:
    blocks = load_table(spark, data_dir, "paper_blocks").select(F.lit("block").alias("item_kind"), F.col("id").alias("item_id"), "content")
    chunks = load_table(spark, data_dir, "document_chunks").select(F.lit("chunk").alias("item_kind"), F.col("id").alias("item_id"), "content")
    return blocks.unionByName(chunks)


@query("p5_found", _OVERSIZED_SQL)
def p5_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Blocks and chunks that had to be split."""
    return p5_pieces(spark, data_dir).where("piece_index = 0").select("item_kind", "item_id")


@query("p5_pieces")
def p5_pieces(spark: SparkSession, data_dir: str) -> DataFrame:
    """Pieces of the oversized blocks and chunks."""
    return splitting.split_oversized(_items(spark, data_dir), ["item_kind", "item_id"])


# 6: containers of fixed capacity


@query("p6_packed")
def p6_packed(spark: SparkSession, data_dir: str) -> DataFrame:
    """Container and place of every document, in tokens of a public tokenizer."""
    return packing.pack(_documents(spark, data_dir))


@query("p6_usage")
def p6_usage(spark: SparkSession, data_dir: str) -> DataFrame:
    """Items and tokens of each container."""
    return packing.container_usage(p6_packed(spark, data_dir))


# 7: evaluation items in documents


_LEAK_PARTS = """
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
items AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM heldout_items)),
item_windows AS (SELECT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items WHERE n > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes))
"""
_LEAK_SQL = _LEAK_PARTS + "SELECT DISTINCT doc_id, item_id FROM doc_windows JOIN item_windows USING (n, g)"
_CLEAN_SQL = (
    _LEAK_PARTS
    + """, gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM doc_windows JOIN item_windows USING (n, g))),
removed AS (SELECT doc_id, count(*) AS removed_words FROM gone GROUP BY doc_id),
pieces AS (
    SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k
    FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+[^\\p{L}\\p{N}]*') AS p FROM documents JOIN removed USING (doc_id))),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY k) AS body FROM pieces ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CASE WHEN removed_words > 0 THEN regexp_extract(text, '^[^\\p{L}\\p{N}]*') || coalesce(body, '') ELSE text END AS clean_text, coalesce(removed_words, 0) AS removed_words
FROM documents LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)"""
)


@query("p7_found", _LEAK_SQL)
def p7_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Documents with the evaluation items they hold."""
    found = leakage.leaks(_documents(spark, data_dir), load_table(spark, data_dir, "heldout_items"))
    return found.select("doc_id", "item_id")


@query("p7_cleaned", _CLEAN_SQL)
def p7_cleaned(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every document without the passages of evaluation items."""
    return leakage.without_leaks(_documents(spark, data_dir), load_table(spark, data_dir, "heldout_items"))


# 2: most similar vectors


@query("p2_found")
def p2_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Pairs of vectors of which at least one is among the ten most similar to the other."""
    return vectors.pairs(vectors.neighbours(load_table(spark, data_dir, "chunk_embeddings")))


@query("p2_neighbours")
def p2_neighbours(spark: SparkSession, data_dir: str) -> DataFrame:
    """Ten most similar of all vectors for each query vector, those whose id is divisible by 50."""
    return vectors.neighbours(load_table(spark, data_dir, "chunk_embeddings"), queries=F.col("id") % 50 == 0)


# 1: near-duplicate records


@query("p1_found")
def p1_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Pairs of chunks with nearly the same words or nearly the same source blocks."""
    pairs = neardup.linked_pairs(_chunks(spark, data_dir))
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


@query("p1_groups")
def p1_groups(spark: SparkSession, data_dir: str) -> DataFrame:
    """Group of every chunk, with its copies and links."""
    return neardup.groups(_chunks(spark, data_dir)).withColumnRenamed("id", "chunk_id")


# 8: personal data


@query("p8_found")
def p8_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Each distinct string of personal data in a document, with its kind."""
    return pii.find_personal_data(_documents(spark, data_dir), load_table(spark, data_dir, "name_list"))


@query("p8_masked")
def p8_masked(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every document with typed placeholders for its personal data."""
    return pii.mask_personal_data(_documents(spark, data_dir), load_table(spark, data_dir, "name_list"))


# 4: noise of scanned pages


@query("p4_found")
def p4_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Blocks with broken or misread words, running headers and printed page numbers."""
    found = scans.find_noise(_blocks(spark, data_dir), load_table(spark, data_dir, "papers"))
    return found.select(F.col("block").alias("block_id"), "kind")


@query("p4_paragraphs")
def p4_paragraphs(spark: SparkSession, data_dir: str) -> DataFrame:
    """Clean continuous paragraphs of every paper."""
    return scans.clean_paragraphs(_blocks(spark, data_dir), load_table(spark, data_dir, "papers"))
