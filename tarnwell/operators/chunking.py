"""Fixed windows and block groups, without Python workers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions.hashing import content_hash
from tarnwell.functions.text import field_of, sanitized, stripped, token_estimate

SIZE, OVERLAP = 800, 120
SINGLE = ("abstract", "figure_caption", "table", "table_caption", "code", "algorithm", "title", "section_title")
GROUPED = ("paragraph", "formula", "list")


def fixed_chunks(documents: DataFrame, doc: str = "id", content: str = "content", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows of ``size`` characters, each beginning ``overlap`` before the end of the one before; blank ones fall away."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    text = stripped(F.replace(F.col(content), F.lit("\r\n"), F.lit("\n")))
    step = size - overlap
    last = F.greatest(F.ceil((F.length("text") - size) / step), F.lit(0)).cast("int")
    windows = documents.select(F.col(doc).alias("document_id"), text.alias("text")).where(F.length("text") > 0)
    windows = windows.select("document_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    pieces = windows.select("document_id", "at", stripped(F.substring("text", F.col("at") * step + 1, F.lit(size))).alias("content")).where("content <> ''")
    order = Window.partitionBy("document_id").orderBy("at")
    pieces = pieces.withColumn("chunk_index", F.row_number().over(order) - 1).drop("at")
    return pieces.select("document_id", "chunk_index", "content", token_estimate(F.col("content")).alias("token_count"), content_hash(F.col("content")).alias("content_hash"), F.lit("fixed").alias("chunk_type"), F.lit("fixed").alias("chunking_strategy"))


def one_of_each_hash(chunks: DataFrame) -> DataFrame:
    """Insert if absent over the whole collection: of equal contents the first document's first chunk stays."""
    names = [c for c in chunks.columns if c != "content_hash"]
    best = chunks.groupBy("content_hash").agg(F.min_by(F.struct(*names), F.struct("document_id", "chunk_index")).alias("row"))
    return best.select("content_hash", "row.*").select(*chunks.columns)


def documents_by_arxiv(documents: DataFrame) -> DataFrame:
    """The first document that names each arXiv id on a line of its own; parts of documents are left out."""
    named = documents.where(~F.contains("source", F.lit("#block:"))).select(F.col("id").alias("document_id"), field_of(F.col("content"), "arXiv ID").alias("arxiv_id"))
    return named.where("arxiv_id IS NOT NULL").groupBy("arxiv_id").agg(F.min("document_id").alias("document_id"))


def block_chunks(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """One chunk for each caption, table, code or heading; running text is joined by document and section.

    References, footnotes, figures and kinds that are neither are left out. Texts follow the reading
    order; a chunk's index is that of its first block. The running text of one section is one value
    in the result and is gathered for that alone.
    """
    placed = blocks.join(documents_by_arxiv(documents), "arxiv_id").withColumn("section", F.coalesce(F.nullif("section_name", F.lit("")), F.lit("unknown")))
    single = placed.where(F.col("block_type").isin(*SINGLE)).select("document_id", F.col("order_index").alias("chunk_index"), F.col("block_type").alias("chunk_type"), "section", F.array("id").alias("source_block_ids"), "content")
    text = F.coalesce(F.nullif("markdown_content", F.lit("")), "content")
    parts = F.array_sort(F.collect_list(F.struct(F.col("order_index").alias("o"), F.col("id").alias("i"), text.alias("t"))))
    running = placed.where(F.col("block_type").isin(*GROUPED)).groupBy("document_id", "section").agg(F.min("order_index").alias("chunk_index"), parts.alias("parts"))
    running = running.select("document_id", "chunk_index", F.lit("paragraph").alias("chunk_type"), "section", F.transform("parts", lambda x: x.i).alias("source_block_ids"), F.array_join(F.transform("parts", lambda x: x.t), "\n\n").alias("content"))
    rows = single.unionByName(running).withColumn("content", stripped(sanitized(F.col("content"))))
    identity = F.concat_ws(":", F.lit("block"), F.col("document_id").cast("string"), "chunk_type", "section", F.array_join(F.transform("source_block_ids", lambda x: x.cast("string")), ","), "content")
    return rows.select("document_id", "chunk_index", "content", token_estimate(F.col("content")).alias("token_count"), content_hash(identity).alias("content_hash"), "chunk_type", F.col("section").alias("section_name"), "source_block_ids", F.lit("block").alias("chunking_strategy"))


def forward_filled_sections(chunks: DataFrame) -> DataFrame:
    """Each chunk with the last second-level heading met so far in its document."""
    named = F.regexp_extract_all("content", F.lit(r"(?m)^##\s+(.+)$"), F.lit(1))
    last = F.get(named, F.size(named) - 1)
    so_far = Window.partitionBy("document_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("section_name", F.last(stripped(last), ignorenulls=True).over(so_far))


def planning_windows(blocks: DataFrame, most: int = 800) -> DataFrame:
    """``id``, ``paper_id``, ``window``: blocks in reading order, a new window where the next one would go over ``most`` words.

    Whether a window ends depends on where it began, so blocks are folded in order, in segments of
    2,048 places of a paper.
    """
    segment = 2048

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values(["order_index", "id"])
        windows, held, at = [], 0, 0
        for n in own.words:
            if held and held + n > most:
                at, held = at + 1, 0
            held += n
            windows.append(at)
        return pd.DataFrame({"id": own.id, "paper_id": own.paper_id, "window": [int(key[1]) * segment + w for w in windows]})

    given = blocks.select("id", "paper_id", "order_index", token_estimate(F.col("content")).alias("words"), (F.col("order_index") / segment).cast("int").alias("segment"))
    return given.groupBy("paper_id", "segment").applyInPandas(fold, "id long, paper_id long, window int")


def neighbour_scores(chunks: DataFrame) -> DataFrame:
    """``document_id``, ``chunk_index``, ``next_index`` and the share of words that neighbours have in common."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"([a-z][\w-]{2,})"), F.lit(1)))
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    rows = chunks.select("document_id", "chunk_index", words.alias("w")).withColumn("next_index", F.lead("chunk_index").over(order)).withColumn("v", F.lead("w").over(order))
    both, least = F.size(F.array_intersect("w", "v")), F.least(F.size("w"), F.size("v"))
    union = F.size(F.array_union("w", "v"))
    score = F.greatest(F.when(union > 0, both / union).otherwise(0.0), F.when(least > 0, both / least).otherwise(0.0))
    return rows.where("next_index IS NOT NULL").select("document_id", "chunk_index", "next_index", F.round(score, 6).alias("score"))


def quality_report(chunks: DataFrame) -> DataFrame:
    """Counts of short, heading-only and unfinished chunks, and words of each strategy."""
    from tarnwell.functions.text import is_caption, word_count

    words = word_count(F.col("content"))
    unfinished = ~F.col("content").rlike(r"[.!?:;。！？)\]|`\"]\s*$") & ~is_caption(F.col("content"))
    return chunks.groupBy("chunking_strategy").agg(
        F.count("*").alias("chunks"),
        F.count_if(words < 50).alias("short_chunks"),
        F.count_if(F.col("content").rlike(r"^#+[^\n]*$")).alias("heading_only"),
        F.count_if(unfinished).alias("unfinished"),
        F.round(F.avg(words), 2).alias("avg_words"),
        F.min(words).alias("min_words"),
        F.max(words).alias("max_words"),
    )


def planner_statistics(chunks: DataFrame, tiny: int = 50) -> DataFrame:
    """``chunks``, ``avg_chunk_tokens``, ``min_chunk_tokens``, ``tiny_chunks`` of each document."""
    from tarnwell.functions.text import word_count

    words = word_count(F.col("content"))
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.round(F.avg(words), 2).alias("avg_chunk_tokens"), F.min(words).alias("min_chunk_tokens"), F.count_if(words < tiny).alias("tiny_chunks"))


def flagged(chunks: DataFrame, most: int) -> DataFrame:
    """The first ``most`` chunks with quality flags: their place, the flags as ``reason`` and the beginning of the text."""
    rows = chunks.where(F.size("metadata.quality_flags") > 0).orderBy("document_id", "chunk_index", "id").limit(most)
    preview = F.substring(F.replace("content", F.lit("\n"), F.lit(" ")), 1, 180)
    return rows.select("id", "document_id", "chunk_index", "section_name", F.array_join("metadata.quality_flags", ",").alias("reason"), preview.alias("preview"))
