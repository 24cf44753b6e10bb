"""Boundaries of planned chunks put right: each pass is a plan over all documents at once.

Chunks have ``id``, ``document_id``, ``chunk_index``, ``content``, ``section_name``, ``chunk_type``. Passes go by
(document, section), by neighbours in a document, or by short runs of neighbours; no document is folded as a whole.
"""

from __future__ import annotations


from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions import text as T
from tarnwell.session import cut

LOOK_AHEAD = 3
_PLACE = ("chunk_index", "id")


def section_key(section: Column) -> Column:
    return F.lower(F.trim(F.coalesce(F.nullif(section, F.lit("")), F.lit("unknown"))))


def _in_order(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*_PLACE)


def _is_title_like(content: Column) -> Column:
    """A few words without marks that end or part sentences."""
    one = T.stripped(T.sanitized(content))
    return (one != "") & ~one.startswith("## ") & (T.word_count(one) <= T.WORDS_OF_TITLE) & ~one.rlike(r"[.?!:;]")


def _is_source_noise(content: Column) -> Column:
    return T.is_noise(content) | T.looks_like_front_matter(content)


def sources_repaired(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chunks built anew from their source blocks (``id``, ``paper_id``, ``order_index``, ``section_name``, ``text``).

    Only known blocks of the first block's paper stay, in reading order and without those that are noise
    or front matter. A heading stays where it comes first and all behind it is of its section; any other goes to the next chunk
    (its own among them) of its document that is of its section, before that chunk's blocks. A chunk
    with no blocks left falls away; one that never had any stays as it is, unless it is front matter or a bare title without a
    section.
    """
    given = chunks.select("id", "document_id", "chunk_index", "section_name", F.posexplode(F.array_distinct(F.filter("source_block_ids", lambda x: x.isNotNull()))).alias("at", "block"))
    known = blocks.select(F.col("id").alias("block"), "paper_id", "order_index", F.col("section_name").alias("block_section"), "text")
    rows = given.join(known, "block")
    of_chunk = Window.partitionBy("id")
    rows = rows.withColumn("paper", F.first("paper_id").over(of_chunk.orderBy("at"))).where(F.col("paper_id") == F.col("paper"))
    touched = rows.select("id", "document_id", "chunk_index", "section_name").distinct()
    rows = rows.where(~_is_source_noise(F.col("text")))
    first_line = F.coalesce(T.first_line(T.sanitized(F.col("text"))), F.lit(""))
    heading = first_line.startswith("## ") | (section_key(F.col("block_section")) == section_key(first_line)) & _is_title_like(first_line)
    rows = rows.withColumn("n", F.row_number().over(of_chunk.orderBy("order_index", "at"))).withColumn("heading", heading).withColumn("key", section_key(F.col("block_section")))
    alike = (F.size(F.collect_set("key").over(of_chunk)) == 1) & (F.count("*").over(of_chunk) > 1)
    rows = rows.withColumn("moves", F.col("heading") & ~((F.col("n") == 1) & alike))

    # a title that moves meets the first chunk of its section at or behind its own place
    stops = touched.select("document_id", section_key(F.col("section_name")).alias("key"), "chunk_index", "id", F.lit(0).alias("title"), F.col("id").alias("target"), *[F.lit(None).cast(k).alias(c) for c, k in (("block", "long"), ("n", "int"))])
    titles = rows.where("moves").select("document_id", "key", "chunk_index", "id", F.lit(1).alias("title"), F.lit(None).cast("long").alias("target"), "block", "n")
    behind = Window.partitionBy("document_id", "key").orderBy(F.desc("chunk_index"), F.desc("id"), "title").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = stops.unionByName(titles).withColumn("goal", F.last("target", ignorenulls=True).over(behind)).where("title = 1 AND goal IS NOT NULL")
    moved = moved.select(F.col("goal").alias("id"), F.struct(F.lit(0).alias("turn"), F.col("chunk_index").alias("a"), F.col("id").alias("b"), F.col("n").cast("long").alias("c")).alias("o"), "block")
    stayed = rows.where("NOT moves").select("id", F.struct(F.lit(1).alias("turn"), F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), F.col("n").cast("long").alias("c")).alias("o"), "block")
    placed = moved.unionByName(stayed).join(known, "block").withColumn("heading", heading)
    parts = F.array_sort(F.collect_list(F.struct("o", "block", "order_index", "block_section", "text", "heading")))
    built = placed.groupBy("id").agg(parts.alias("parts")).select(
        "id",
        F.array_min(F.transform("parts", lambda x: x.order_index)).alias("new_index"),
        T.stripped(T.sanitized(F.array_join(F.transform("parts", lambda x: x.text), "\n\n"))).alias("new_content"),
        F.coalesce(F.get(F.filter("parts", lambda x: ~x.heading & (F.coalesce(x.block_section, F.lit("")) != "")), 0).block_section, F.col("parts")[0].block_section).alias("planned"),
        F.transform("parts", lambda x: x.block).alias("new_ids"),
    )
    kept = chunks.join(built, "id").withColumns({"section_name": T.section_of(F.col("new_content"), F.col("planned"), F.col("section_name")), "chunk_index": F.col("new_index"), "content": F.col("new_content"), "source_block_ids": F.col("new_ids")})
    others = chunks.join(touched.select("id"), "id", "left_anti")
    front = (section_key(F.col("section_name")) == "unknown") & (_is_source_noise(F.col("content")) | _is_title_like(F.col("content")))
    return kept.select(*chunks.columns).unionByName(others.where(~F.coalesce(front, F.lit(True))))


def headings_split(chunks: DataFrame) -> DataFrame:
    """A chunk with numbered headings of other sections within is cut before each; pieces take the heading's section. Adds ``piece``."""
    lines = F.split(T.stripped(T.sanitized(F.col("content"))), r"\r\n|\n|\r")
    number = lambda x: F.nullif(F.regexp_extract(x, r"^\s*(?:##\s+)?(\d+(?:\.\d+)*)\b", 1), F.lit(""))
    last = F.size(lines) - 1
    cuts = lambda x, i: (i > 0) & (i < last) & F.trim(x).rlike(T.NUMBERED_H2) & F.coalesce(number(F.trim(x)) != number(F.col("section_name")), F.lit(False))
    marked = F.transform(lines, lambda x, i: F.concat(F.when(cuts(x, i), F.lit("\f")).otherwise(F.lit("")), x))
    pieces = chunks.select(*chunks.columns, F.posexplode(F.split(F.array_join(marked, "\n"), "\f")).alias("piece", "_part")).withColumn("_part", T.stripped(F.col("_part"))).where("_part <> ''")
    several = F.count("*").over(Window.partitionBy("id")) > 1
    found = F.when(several, T.heading_section(F.col("_part")))
    return pieces.withColumns({"section_name": F.coalesce(found, "section_name"), "content": F.when(several, F.col("_part")).otherwise(F.col("content"))}).drop("_part")


def headings_moved(chunks: DataFrame) -> DataFrame:
    """A numbered heading at a chunk's end goes to the chunk behind it in the document, where that is of the heading's section or of the chunk's own; elsewhere it falls away, and so does a chunk that is nothing else."""
    plain = T.stripped(T.sanitized(F.col("content")))
    lines = T.filled_lines(plain)
    heading = F.when(F.try_element_at(lines, F.lit(-1)).rlike(T.NUMBERED_H2), F.try_element_at(lines, F.lit(-1)))
    name = lambda x: T.single_spaced(F.regexp_replace(F.lower(x), r"^\s*##\s+", ""))
    bare = lambda x: F.regexp_replace(name(x), r"^\d+(?:\.\d+)*\s+", "")
    order = Window.partitionBy("document_id").orderBy("chunk_index", "id", "piece")
    heads = chunks.select("document_id", "chunk_index", "id", "piece", "section_name", heading.alias("_heading"))  # neighbours meet without their texts
    heads = heads.withColumn("_before", F.lag("_heading").over(order)).withColumn("_section_before", F.lag("section_name").over(order)).drop("chunk_index", "section_name")
    rows = chunks.join(heads, ["document_id", "id", "piece"])
    own = F.coalesce(F.col("section_name"), F.lit(""))
    fits = (F.trim(own) != "") & ((name(F.col("_before")) == name(own)) | (bare(F.col("_before")) == bare(own)))
    fits = F.coalesce(F.col("_before").isNotNull() & (fits | (name(F.coalesce("_section_before", F.lit(""))) == name(own))), F.lit(False))
    body = F.when(F.col("_heading").isNull(), F.col("content")).otherwise(T.stripped(F.substring(plain, F.lit(1), F.length(plain) - F.length("_heading"))))
    taken = F.regexp_replace(F.col("_before"), r"^##\s+", "")
    rows = rows.withColumns({"_body": body, "_fits": fits}).withColumn("content", F.when(F.col("_fits"), T.stripped(F.concat("_before", F.lit("\n\n"), "_body"))).otherwise(F.col("_body")))
    rows = rows.withColumn("section_name", F.when(F.col("_fits"), taken).otherwise(F.col("section_name")))
    return rows.where("content <> ''").select(*chunks.columns)


def trimmed(chunks: DataFrame) -> DataFrame:
    """Lines at either end that are page numbers, running headers or footnote marks fall away, and chunks of nothing else."""
    lines = F.split(T.stripped(T.sanitized(F.col("content"))), r"\r\n|\n|\r")
    good = F.transform(lines, lambda x: (F.trim(x) != "") & ~T.is_boundary_noise(x))
    first, behind = F.array_position(good, True), F.array_position(F.reverse(good), True)
    inner = F.array_join(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.greatest(F.size(lines) - behind - first + 2, F.lit(0)).cast("int")), "\n")
    return chunks.withColumn("content", F.when(first > 0, T.stripped(inner)).otherwise("")).where("content <> ''")


def sentences_joined(chunks: DataFrame) -> DataFrame:
    """A chunk that breaks off takes in the chunk its sentence goes on in: the next but figures and tables, up to three on, of its section.

    A chunk that was taken in takes in none. What one takes depends on those up to three before it alone, so a
    document falls into runs between which nothing depends; the places of each run are matched by themselves, without texts.
    """
    visual = F.coalesce(F.col("chunk_type").isin("figure_caption", "table"), F.lit(False)) | T.is_visual_text(F.col("content"))
    order = Window.partitionBy("document_id").orderBy("chunk_index", "id", "piece")
    flags = chunks.select("document_id", "chunk_index", "id", "piece", visual.alias("visual"), section_key(F.col("section_name")).alias("key"), (T.ends_open(F.col("content")) & ~visual).alias("open"))
    flags = flags.withColumn("at", F.row_number().over(order))
    near = F.coalesce(F.sum(F.col("open").cast("int")).over(order.rowsBetween(-LOOK_AHEAD, -1)), F.lit(0))
    flags = flags.withColumn("run", F.sum((near == 0).cast("int")).over(order))
    # a run of one that is not open takes and gives nothing
    busy = flags.withColumn("opens", F.max(F.col("open").cast("int")).over(Window.partitionBy("document_id", "run"))).where("opens = 1")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def done() -> list[tuple[int, int, int]]:
            taken: set[int] = set()
            out = []
            for i, (at, _, section, opened) in enumerate(held):
                if opened and at not in taken:
                    goal = next(((a, k) for a, v, k, _ in held[i + 1 : i + 1 + LOOK_AHEAD] if a not in taken and not v), None)
                    if goal and goal[1] == section:
                        taken.add(goal[0])
                        out.append((key[0], at, goal[0]))
            return out

        for rows in batches:
            out: list[tuple[int, int, int]] = []
            for document, run, *flags in zip(rows["document_id"], rows["run"], rows["at"], rows["visual"], rows["key"], rows["open"]):
                if (document, run) != key:
                    out += done()
                    key, held = (document, run), []
                held.append(flags)
            yield pd.DataFrame(out, columns=["document_id", "at", "goal"])
        yield pd.DataFrame(done(), columns=["document_id", "at", "goal"])

    busy = busy.select("document_id", "run", "at", "visual", "key", "open").repartition("document_id", "run").sortWithinPartitions("document_id", "run", "at")
    pairs = busy.mapInPandas(match, "document_id long, at int, goal int")
    placed = chunks.join(flags.select("document_id", "id", "piece", "at"), ["document_id", "id", "piece"])
    ids = [c for c in ("source_block_ids",) if c in chunks.columns]
    behind = placed.select("document_id", F.col("at").alias("goal"), F.col("content").alias("more"), *[F.col(c).alias("more_ids") for c in ids])
    joined = placed.join(pairs, ["document_id", "at"], "left").join(behind, ["document_id", "goal"], "left").join(pairs.select("document_id", F.col("goal").alias("at")), ["document_id", "at"], "left_anti")
    content = F.when(F.col("more").isNull(), F.col("content")).otherwise(T.stripped(T.sanitized(F.concat("content", F.lit("\n\n"), "more"))))
    joined = joined.withColumn("content", content)
    if ids:
        both = F.array_sort(F.array_distinct(F.concat(F.coalesce("source_block_ids", F.array().cast("array<long>")), F.coalesce("more_ids", F.array().cast("array<long>")))))
        joined = joined.withColumn("source_block_ids", F.when(F.col("more").isNull(), F.col("source_block_ids")).otherwise(both))
    return joined.select(*chunks.columns)


def validated(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """All passes in order: sources, headings within, headings at the end, noise lines, broken sentences."""
    split = headings_split(sources_repaired(chunks, blocks))
    return sentences_joined(cut(trimmed(headings_moved(cut(split)))))  # a pass reads what it is given more than once
