"""Further queries with their SQL: point and list lookups, listings, deletes, counts by list, statistics of chunks, gold with fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import text
from tarnwell.operators import boundaries, chunking, evaluation, retrieval, store
from tarnwell.plans.catalogue import _B, _C, _D, _METRICS, _P, _Q, _SEARCH, K, MODEL, _asked, _blocks, _cases, _chunks, _documents, _index, _metric_columns, _papers, _stamp, _text, query
from tarnwell.sources.tables import load_table, once

_FILES = "files AS (SELECT id AS paper_id, 'pdf' AS file_type, pdf_url AS path FROM p WHERE pdf_url <> '')"


@query(f"WITH {_P} SELECT id, title FROM p WHERE arxiv_id = (SELECT arxiv_id FROM p WHERE id = 2)")
def paper_by_arxiv_id(spark: SparkSession, d: str) -> DataFrame:
    """The paper of one arXiv id."""
    wanted = _papers(spark, d).where("id = 2").select("arxiv_id")
    return _papers(spark, d).join(F.broadcast(wanted), "arxiv_id", "left_semi").select("id", "title")


@query(f"WITH {_P} SELECT id, arxiv_id, title FROM p WHERE id = 1")
def paper_by_id(spark: SparkSession, d: str) -> DataFrame:
    """One paper; the condition reaches the scan."""
    return once(load_table(spark, d, "papers").where("id = 1").select("id", "arxiv_id", "title"), "id")


@query(f"WITH {_B} SELECT id, order_index, block_type FROM b WHERE paper_id = 1")
def blocks_of_paper(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of one paper in reading order; the condition reaches the scan."""
    return once(load_table(spark, d, "paper_blocks").where("paper_id = 1").select("id", "order_index", "block_type"), "id").orderBy("order_index", "id")


@query(f"WITH {_D} SELECT id, title, source, content_hash FROM d")
def documents_in_order(spark: SparkSession, d: str) -> DataFrame:
    return once(load_table(spark, d, "paper_documents").select("id", "title", "source", "content_hash"), "id").orderBy("id")


@query(f"WITH {_C} SELECT id, document_id, chunk_index, content FROM c")
def chunks_in_order(spark: SparkSession, d: str) -> DataFrame:
    return once(load_table(spark, d, "document_chunks").select("id", "document_id", "chunk_index", "content"), "id").orderBy("document_id", "chunk_index", "id")


@query(f"WITH {_D} SELECT id FROM d WHERE source = (SELECT source FROM d WHERE id = 3)")
def document_ids_of_source(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).select("id", "source")
    return rows.join(F.broadcast(rows.where("id = 3").select("source")), "source", "left_semi").select("id")


@query(f"WITH {_P}, {_FILES} SELECT paper_id, arxiv_id, path, {_text("published_at AT TIME ZONE 'UTC'")} AS published_at FROM files JOIN p ON p.id = paper_id ORDER BY p.published_at DESC NULLS LAST, paper_id DESC LIMIT 20")
def files_by_recency(spark: SparkSession, d: str) -> DataFrame:
    """The files of the newest papers."""
    papers = _papers(spark, d)
    rows = store.paper_files(papers).join(papers.select(F.col("id").alias("paper_id"), "arxiv_id", "published_at"), "paper_id")
    return rows.orderBy(F.desc_nulls_last("published_at"), F.desc("paper_id")).limit(20).select("paper_id", "arxiv_id", "path", _stamp("published_at").alias("published_at"))


@query(f"WITH {_P}, {_FILES} SELECT paper_id, path FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY paper_id) AS n FROM files WHERE paper_id % 2 = 1 AND path NOT IN (SELECT path FROM files WHERE paper_id % 2 = 0)) WHERE n = 1")
def files_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Files of the papers with odd ids that a store with those of even ids takes."""
    files = store.paper_files(_papers(spark, d))
    return store.absent_rows(files.where("paper_id % 2 = 1"), files.where("paper_id % 2 = 0"), ["path"], [F.col("paper_id")]).select("paper_id", "path")


@query(f"WITH {_D}, {_P} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY source ORDER BY id) AS n FROM d WHERE source NOT IN (SELECT source_url FROM p WHERE id <= 40)) WHERE n = 1")
def documents_of_new_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose source no stored paper has, the first of each source."""
    stored = _papers(spark, d).where("id <= 40").select(F.col("source_url").alias("source"))
    return store.absent_rows(_documents(spark, d).select("id", "source"), stored, ["source"], [F.col("id")]).select("id")


@query(f"WITH {_D}, {_P} SELECT p.id, EXISTS (SELECT 1 FROM d WHERE d.source = p.source_url) AS stored FROM p")
def sources_stored(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document of each paper's source is stored."""
    known = _documents(spark, d).select(F.col("source").alias("source_url")).distinct().withColumn("known", F.lit(True))
    return _papers(spark, d).select("id", "source_url").join(known, "source_url", "left").select("id", F.coalesce("known", F.lit(False)).alias("stored"))


@query(f"WITH {_B} SELECT id FROM b WHERE paper_id <> 1")
def blocks_without_paper(spark: SparkSession, d: str) -> DataFrame:
    """The blocks that stay when those of one paper are deleted."""
    blocks = _blocks(spark, d).select("id", "paper_id")
    return store.without(blocks, spark.range(1, 2), "paper_id", "id").select("id")


@query(f"WITH {_D} SELECT id FROM d WHERE NOT starts_with(source, 'https://arxiv.org/abs/1') OR source IS NULL")
def documents_without_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay when those of a source prefix are deleted."""
    return _documents(spark, d).where(~F.coalesce(F.col("source").startswith("https://arxiv.org/abs/1"), F.lit(False))).select("id")


@query(f"WITH {_C}, {_D} SELECT count(*) AS n FROM c WHERE content_hash IN (SELECT content_hash FROM c WHERE id <= 200)")
def chunks_of_hash_list(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks have a hash of a list."""
    chunks = _chunks(spark, d).select("id", "content_hash")
    return chunks.join(chunks.where("id <= 200").select("content_hash").distinct(), "content_hash", "left_semi").agg(F.count("*").alias("n"))


@query(f"WITH {_Q}, wanted AS (SELECT DISTINCT unnest(gold_chunk_ids) AS chunk_id FROM q) SELECT count(DISTINCT chunk_id) AS n FROM chunk_embeddings JOIN wanted USING (chunk_id) WHERE model_name = '{MODEL}'")
def embeddings_of_list(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks of a list have a vector of the model."""
    wanted = _cases(spark, d).select(F.explode("gold_chunk_ids").alias("chunk_id")).distinct()
    rows = load_table(spark, d, "chunk_embeddings").where(F.col("model_name") == MODEL).select("chunk_id").distinct()
    return rows.join(wanted, "chunk_id", "left_semi").agg(F.count("*").alias("n"))


@query(f"WITH {_P}, {_Q} SELECT count(*) AS n FROM p WHERE arxiv_id IN (SELECT arxiv_id FROM q)")
def papers_of_list(spark: SparkSession, d: str) -> DataFrame:
    """How many papers are among the arXiv ids of the cases."""
    return _papers(spark, d).select("arxiv_id").join(_cases(spark, d).select("arxiv_id").distinct(), "arxiv_id", "left_semi").agg(F.count("*").alias("n"))


_WORDS = r"len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> ''))"


@query(rf"WITH {_C}, w AS (SELECT document_id, {_WORDS} AS n FROM c WHERE chunking_strategy <> 'fixed') SELECT document_id, count(*) AS chunks, round(avg(n), 2) AS avg_chunk_tokens, min(n) AS min_chunk_tokens, count(*) FILTER (WHERE n < 50) AS tiny_chunks FROM w GROUP BY 1")
def planner_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Number, mean and least size of the planned chunks of each document."""
    return chunking.planner_statistics(_chunks(spark, d).where("chunking_strategy <> 'fixed'"))


@query(
    f"""WITH c AS (SELECT DISTINCT ON (id) * FROM document_chunks), f AS (SELECT id, document_id, chunk_index, section_name, array_to_string(metadata.quality_flags, ',') AS reason, left(replace(content, E'\\n', ' '), 180) AS preview FROM c WHERE len(metadata.quality_flags) > 0)
SELECT * FROM f ORDER BY document_id, chunk_index, id LIMIT 20"""
)
def flagged_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 chunks with quality flags, as the quality report lists them."""
    return chunking.flagged(once(load_table(spark, d, "document_chunks").drop("created_at"), "id"), 20)


@query(
    rf"""WITH {_B}, t AS (SELECT id, regexp_replace(content, '^\s+|\s+$', '', 'g') AS t FROM b)
SELECT id,
    len(list_filter(string_split_regex(t, '\r\n|\n|\r'), lambda x: trim(x) <> '')) = 1 AND (starts_with(t, '## ') OR (len(string_split_regex(t, '\s+')) <= 12 AND NOT ends_with(t, '.') AND regexp_matches(t, '^(\d+(\.\d+)*\s+)?[A-Z][\w/&: -]+$'))) AS is_heading,
    t = '' OR contains(t, '@') OR regexp_matches(lower(t), 'university|department of|school of|institute|affiliation') OR regexp_full_match(t, '(19|20)\d{{2}}([-/]\d{{1,2}}){{0,2}}')
        OR (len(string_split_regex(t, '\s+')) <= 12 AND regexp_matches(lower(t), '\b(author|authors|copyright|license)\b')) AS is_metadata,
    t <> '' AND (regexp_matches(t, '(?i)(\band\s*\(\d+\)|\bsuch as|\bincluding|\bwhere|\bbecause|\blet|[:,;])\s*$') OR len(t) - len(replace(t, '(', '')) > len(t) - len(replace(t, ')', '')) OR len(t) - len(replace(t, '[', '')) > len(t) - len(replace(t, ']', ''))) AS breaks_off
FROM t"""
)
def block_edges(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that are a heading, that look like metadata, and that break off where a figure must not be bound to them."""
    content = F.col("content")
    return _blocks(spark, d).select("id", text.is_heading_text(content).alias("is_heading"), text.looks_like_metadata(content).alias("is_metadata"), text.breaks_off(content).alias("breaks_off"))


@query(
    f"""WITH {_C}, {_D}, {_P}, j AS (SELECT p.id AS paper_id, p.arxiv_id, c.id AS source_chunk_id, c.document_id, c.chunk_type,
    row_number() OVER (PARTITION BY p.id ORDER BY CASE WHEN c.chunk_type IN ('table', 'figure_caption', 'fused') THEN 0 ELSE 1 END, c.chunk_index, c.id) AS n
    FROM c JOIN d ON d.id = c.document_id JOIN p ON p.source_url = d.source WHERE c.chunking_strategy IN ('agentic', 'agentic_fusion') AND c.section_name IS NOT NULL)
SELECT 'ablation-' || arxiv_id || '-' || lpad(n::VARCHAR, 2, '0') AS id, paper_id, source_chunk_id, document_id, CASE WHEN chunk_type IN ('table', 'figure_caption', 'fused') THEN 'figure_table' ELSE 'method' END AS category FROM j WHERE n <= 5"""
)
def question_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The first five planned chunks of each paper to ask about, tables and figures first."""
    return evaluation.question_chunks(_chunks(spark, d), _documents(spark, d), _papers(spark, d), 5)


@query(
    f"""WITH {_SEARCH}, {_METRICS.split(', ')[0].split(' AS ')[0]} AS (SELECT id AS query_id, paper_id IS NULL AS by_document, CASE WHEN paper_id IS NULL THEN list_distinct(gold_document_ids) ELSE list_distinct(gold_chunk_ids) END AS relevant FROM q),
r AS (SELECT h.query_id, h.rank, h.chunk_id, idx.document_id FROM hybrid h JOIN idx USING (chunk_id)),
m AS (SELECT g.query_id, len(relevant) AS size, r.rank, coalesce(list_contains(relevant, CASE WHEN by_document THEN r.document_id ELSE r.chunk_id END), false) AS hit FROM g LEFT JOIN r USING (query_id) WHERE len(relevant) > 0)
SELECT query_id, {_metric_columns()} FROM m GROUP BY 1"""
)
def case_metrics_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each case by its gold chunks; by its gold documents where it has none, as those without a paper are taken to have."""
    index = retrieval.stored(_index(spark, d))
    found = retrieval.search("hybrid", _asked(spark, d), index, K, kept=True).join(_chunks(spark, d).select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id")
    cases = _cases(spark, d).select(F.col("id").alias("query_id"), F.when(F.col("paper_id").isNotNull(), F.col("gold_chunk_ids")).alias("chunks"), F.col("gold_document_ids").alias("documents"))
    return evaluation.metrics_with_fallback(found, cases, ["query_id"])


def _sources(spark: SparkSession, d: str) -> DataFrame:
    content = F.coalesce(F.nullif("markdown_content", F.lit("")), "content")
    return _blocks(spark, d).select("id", "paper_id", "order_index", "section_name", content.alias("text"))


@query()
def boundary_sources(spark: SparkSession, d: str) -> DataFrame:
    """Planned chunks built anew from their source blocks, headings with the text of their section."""
    found = boundaries.sources_repaired(_chunks(spark, d).where("chunking_strategy = 'agentic'"), _sources(spark, d))
    return found.select("id", "document_id", "chunk_index", "section_name", "content", "source_block_ids")


@query()
def boundaries_validated(spark: SparkSession, d: str) -> DataFrame:
    """Planned chunks after all passes over their boundaries."""
    found = boundaries.validated(_chunks(spark, d).where("chunking_strategy = 'agentic'"), _sources(spark, d))
    return found.select("id", "piece", "document_id", "chunk_index", "section_name", "content", "source_block_ids")
