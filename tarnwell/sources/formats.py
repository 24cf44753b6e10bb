"""Readers of the formats that feed the tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tarnwell.functions.hashing import content_hash
from tarnwell.functions.text import filled_lines, single_spaced, stripped

GOLD = (
    "id string, query string, expected_answer string, category string, tags array<string>, difficulty string, paper_id long, arxiv_id string, gold_sections array<string>, gold_keywords array<string>, "
    "gold_chunk_ids array<long>, gold_chunk_ids_by_strategy map<string,array<long>>, gold_document_ids array<long>, gold_page_numbers array<int>, gold_visual_refs array<string>, "
    "answer_must_include array<string>, answer_must_not_include array<string>, source_chunk_id long, notes string"
)
JUDGES = "qa_id string, variant string, answer_correct boolean, citation_correct boolean, unsupported_claim boolean, score double, notes string"
CASES = "query string, relevant_chunk_ids array<long>, relevant_document_ids array<long>, category string, tags array<string>, expected_answer string, notes string"
PLAN = (
    "dataset string, experiments array<struct<id: string, claim: string, subset_filter: struct<categories: array<string>, tags: array<string>>, "
    "variants: array<struct<name: string, strategy: string, chunk_strategy: string, index_name: string, generate: boolean, use_hyde: boolean, use_rerank: boolean>>, metrics: array<string>>>"
)
FEED = (
    "id string, updated string, published string, title string, summary string, author array<struct<name: string>>, "
    "category array<struct<_term: string>>, link array<struct<_href: string, _rel: string, _title: string, _type: string>>"
)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``title``, ``source``, ``content``, ``content_hash`` of the .md and .txt files below a folder; empty ones are left out.

    The title is the first line that is not blank, without the marks of a Markdown heading, at most 120
    characters of plain text; failing that the name of the file.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,txt,MD,TXT}").select(F.col("_metadata.file_path").alias("source"), stripped("value").alias("content"))
    raw = raw.where("content <> ''")
    first = F.get(filled_lines(F.col("content")), 0)
    name = F.regexp_extract("source", r"([^/]+)\.[^.]+$", 1)
    heading = F.lower("source").endswith(".md") & first.startswith("#")
    title = F.when(heading, F.coalesce(F.nullif(stripped(F.regexp_replace(first, "^#+", "")), F.lit("")), name)).otherwise(F.substring(first, 1, 120))
    return raw.select(title.alias("title"), "source", "content", content_hash(F.col("content")).alias("content_hash"))


def atom_feed(spark: SparkSession, path: str) -> DataFrame:
    """Papers of a stored Atom feed, one row for each entry."""
    raw = spark.read.format("xml").option("rowTag", "entry").option("attributePrefix", "_").schema(FEED).load(path)
    return papers_of_entries(raw)


def papers_of_entries(raw: DataFrame) -> DataFrame:
    page = F.replace(F.replace(stripped("id"), F.lit("http://"), F.lit("https://")), F.lit("export."), F.lit(""))
    pdf = F.get(F.filter("link", lambda x: x["_title"] == "pdf"), 0)["_href"]
    return raw.select(
        F.element_at(F.split(page, "/"), -1).alias("arxiv_id"),
        single_spaced(F.col("title")).alias("title"),
        F.transform("author", lambda x: single_spaced(x["name"])).alias("authors"),
        single_spaced(F.col("summary")).alias("abstract"),
        F.transform("category", lambda x: x["_term"]).alias("categories"),
        F.try_to_timestamp("published").alias("published_at"),
        F.try_to_timestamp("updated").alias("updated_at"),
        F.coalesce(pdf, F.replace(page, F.lit("/abs/"), F.lit("/pdf/"))).alias("pdf_url"),
        page.alias("source_url"),
    )


def _json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=not lines)


def gold_cases(spark: SparkSession, path: str) -> DataFrame:
    """Gold cases of a JSON list; ids and categories that are missing get defaults, a case without a query stops the job."""
    raw = _json(spark, path, GOLD).withColumn("position", F.monotonically_increasing_id() + 1)
    query = stripped(F.coalesce("query", F.lit("")))
    checked = F.when(query != "", query).otherwise(F.raise_error(F.concat(F.lit("a gold case has no query: "), F.col("position").cast("string"))))
    return raw.withColumn("query", checked).withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.format_string("qa-%04d", "position"))).withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown"))).drop("position")


def judge_labels(spark: SparkSession, path: str) -> DataFrame:
    """Judgements of a JSON list with their ``position``; the last of each (case, variant) holds."""
    raw = _json(spark, path, JUDGES).withColumn("position", F.monotonically_increasing_id())
    best = raw.groupBy("qa_id", "variant").agg(F.max_by(F.struct("answer_correct", "citation_correct", F.coalesce("unsupported_claim", F.lit(False)).alias("unsupported_claim"), "score", "notes", "position"), "position").alias("j"))
    return best.select("qa_id", "variant", "j.*")


def relevance_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON-lines file; one without relevant ids stops the job."""
    raw = _json(spark, path, CASES, lines=True).where("query IS NOT NULL")
    some = (F.size(F.coalesce("relevant_chunk_ids", F.array().cast("array<long>"))) > 0) | (F.size(F.coalesce("relevant_document_ids", F.array().cast("array<long>"))) > 0)
    return raw.withColumn("query", F.when(some, F.col("query")).otherwise(F.raise_error(F.concat(F.lit("no relevant ids for: "), F.col("query")))))


def experiment_plan(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, PLAN)


def lenient_array(value: Column) -> Column:
    """An array of strings from JSON text that is an array or a single string."""
    return F.coalesce(F.from_json(value, "array<string>"), F.when(value.isNotNull() & (value != ""), F.array(value)), F.array().cast("array<string>"))


def lenient_vector(value: Column) -> Column:
    return F.from_json(value, "array<double>")


def smallest_files(spark: SparkSession, path: str, n: int, pattern: str = "*.pdf") -> DataFrame:
    """The ``n`` smallest files below a folder, by size and path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime").orderBy("length", "path").limit(n)


def file_hashes(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """``path``, ``length`` and SHA-256 of landed files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def pdf_text(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``text`` of PDF files, pages parted by form feeds; needs the optional package ``pypdf`` on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pypdf import PdfReader

        for batch in batches:
            texts = ["\f".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(c)).pages) for c in batch.content]
            yield pd.DataFrame({"path": batch.path, "text": texts})

    return files.mapInPandas(extract, "path string, text string")


class FeedSource(DataSource):
    """``spark.read.format("stored_feed").load(folder)``: the entries of stored Atom files, one partition for each file."""

    @classmethod
    def name(cls) -> str:
        return "stored_feed"

    def schema(self) -> str:
        return "file string, entry string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _FeedReader(self.options.get("path", "."))


class _FeedReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def _storage(self):
        """The file system of the folder, whatever storage it is on, and the folder's path there."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else os.path.abspath(self.path))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        storage, folder = self._storage()
        return [InputPartition(f.path) for f in sorted(storage.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path) if f.path.endswith(".xml")]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        import re

        with self._storage()[0].open_input_stream(partition.value) as f:
            for m in re.finditer(r"<entry\b.*?</entry>", f.read().decode("utf-8"), re.S):
                yield partition.value, m[0]
