"""The knowledge pipeline: parse, chunk, embed, index, as steps that are written, retried and resumed."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators import chunking, retrieval, store, units


@dataclass
class Outcome:
    step: str
    status: str
    rows: int = 0
    attempts: int = 0
    seconds: float = 0.0
    error: str | None = None


@dataclass
class Summary:
    outcomes: list[Outcome] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return all(o.status != "failed" for o in self.outcomes)


def run_steps(steps: Iterable[tuple[str, Callable[[], int]]], skip: Iterable[str] = (), attempts: int = 3, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Summary:
    """Each step in order; a failing one is tried again after ``backoff`` times the attempt, and the first that stays failed ends the run."""
    summary, skipped = Summary(), set(skip)
    for name, step in steps:
        if name in skipped:
            summary.outcomes.append(Outcome(name, "skipped"))
            continue
        started, error = time.perf_counter(), None
        for attempt in range(1, attempts + 1):
            try:
                rows = step()
                summary.outcomes.append(Outcome(name, "ok", rows, attempt, time.perf_counter() - started))
                break
            except Exception as e:  # noqa: BLE001 - whatever a step raises is reported
                error = f"{type(e).__name__}: {e}"
                if attempt < attempts:
                    sleep(backoff * attempt)
        else:
            summary.outcomes.append(Outcome(name, "failed", 0, attempts, time.perf_counter() - started, error))
            return summary
    return summary


def chunk_step(documents: DataFrame, blocks: DataFrame, strategy: str = "agentic", planner: units.Planner | None = units.planned) -> DataFrame:
    """Chunks by the wanted strategy: planned units, else block chunks without a planner; fixed windows for documents that get none."""
    columns = ["document_id", "chunk_index", "content", "token_count", "content_hash", "chunk_type", "chunking_strategy"]
    if strategy == "fixed":
        return chunking.fixed_chunks(documents).select(*columns)
    made = units.build_units(documents, blocks, planner) if strategy == "agentic" and planner else chunking.block_chunks(documents, blocks)
    rest = documents.join(made.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti")
    return made.select(*columns).unionByName(chunking.fixed_chunks(rest).select(*columns))


def embed_step(chunks: DataFrame, stored: DataFrame, model: str, embedder: Callable[[DataFrame, str], DataFrame] = retrieval.hashed_vectors) -> DataFrame:
    """``chunk_id``, ``model_name``, ``embedding`` of chunks that have none of the model."""
    todo = store.missing(chunks.select(F.col("id").alias("chunk_id"), "content"), stored.where(F.col("model_name") == model), [("chunk_id", "chunk_id")])
    return embedder(todo, "content").where("vector IS NOT NULL").select("chunk_id", F.lit(model).alias("model_name"), F.col("vector").alias("embedding"))


def reconcile(index: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """One row: chunks in the index, embeddings of the model, and whether they agree."""
    a = index.agg(F.countDistinct("chunk_id").alias("indexed"))
    b = embeddings.where(F.col("model_name") == model).agg(F.countDistinct("chunk_id").alias("embedded"))
    return a.crossJoin(F.broadcast(b)).withColumn("agree", F.col("indexed") == F.col("embedded"))


def written(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path).count()


def run_pipeline(spark: SparkSession, documents: DataFrame, blocks: DataFrame, folder: str, model: str = "hashed-64", strategy: str = "agentic", skip: Iterable[str] = ()) -> Summary:
    """Chunk, embed and index into ``folder``; a later run reads what an earlier one wrote for the steps it skips."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}")

    def chunk() -> int:
        made = chunking.one_of_each_hash(chunk_step(documents, blocks, strategy))
        return written(made.withColumn("id", F.xxhash64("content_hash")), f"{folder}/chunks")

    def embed() -> int:
        none = read("chunks").select(F.col("id").alias("chunk_id"), F.lit(model).alias("model_name")).limit(0)
        return written(embed_step(read("chunks"), none, model), f"{folder}/embeddings")

    def index() -> int:
        rows = read("embeddings").join(read("chunks").select(F.col("id").alias("chunk_id"), "document_id", "content", "chunk_type", "chunking_strategy"), "chunk_id")
        n = written(rows, f"{folder}/index")
        if not reconcile(read("index"), read("embeddings"), model).first().agree:
            raise ValueError("the index does not hold every embedding")
        return n

    return run_steps([("chunk", chunk), ("embed", embed), ("index", index)], skip)
