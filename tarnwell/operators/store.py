"""Write rules of the stores as transformations: new rows in, whole new table out (or the rows to append)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. Only the least row of a key leaves each task."""
    names = [c for c in rows.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(n) for n in names]), ranked).alias("row"))
    return best.select(*keys, *[F.col(f"row.`{n}`").alias(n) for n in names]).select(*rows.columns)


def absent_rows(new: DataFrame, stored: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert if absent: new rows whose key is not stored, the first of each key. A null key is never stored twice either."""
    known = stored.select(*keys).distinct()
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return first_of_each(new, keys, order).alias("n").join(known.alias("s"), condition, "left_anti")


def latest_wins(stored: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert by key: a new row takes the place of a stored one, later rows that of earlier ones."""
    both = stored.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    names = [c for c in stored.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct("_turn", *order)).alias("row"))
    return best.select(*keys, *[F.col(f"row.`{n}`").alias(n) for n in names]).select(*stored.columns)


def upsert_keeping_least_id(stored: DataFrame, new: DataFrame, key: str, row_id: str, order: str) -> DataFrame:
    """Update by key: of several stored rows the one with the least id takes the new values and keeps its id; unknown keys are added with a null id."""
    changing = [c for c in stored.columns if c not in (key, row_id)]
    last = new.groupBy(key).agg(F.max_by(F.struct(*changing), order).alias("row"))
    least = stored.groupBy(key).agg(F.min(row_id).alias("_least"))
    joined = stored.alias("s").join(least, key, "left").join(last, key, "full_outer")
    touched = F.col("row").isNotNull() & ((F.col(f"s.{row_id}") == F.col("_least")) | F.col(f"s.{row_id}").isNull())
    return joined.select(F.col(f"s.{row_id}").alias(row_id), key, *[F.when(touched, F.col(f"row.`{c}`")).otherwise(F.col(f"s.`{c}`")).alias(c) for c in changing]).select(*stored.columns)


def without(stored: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    """Delete by key."""
    keys = gone.select(F.col(gone_key or key).alias(key)).distinct()
    return stored.join(keys, key, "left_anti")


def delete_with_dependants(parents: DataFrame, children: DataFrame, gone: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Delete parents and the rows that refer to them."""
    kept = without(parents, gone, parent_key)
    lost = gone.select(F.col(parent_key).alias(child_key)).distinct()
    return kept, children.join(lost, child_key, "left_anti")


def missing(rows: DataFrame, done: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Backfill: rows without a counterpart."""
    keys = done.select(*[F.col(b).alias(f"_{i}") for i, (_, b) in enumerate(on)]).distinct()
    condition = None
    for i, (a, _) in enumerate(on):
        one = F.col(a) == F.col(f"_{i}")
        condition = one if condition is None else condition & one
    return rows.join(keys, condition, "left_anti")


def newest(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of a log; each task sends on its own ``n`` at most."""
    return rows.orderBy(*order).limit(n)


def latest_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(window)).where("_place = 1").drop("_place")


def live_entries(cache: DataFrame, now: Column) -> DataFrame:
    """Cache rows that have not expired."""
    return cache.where(F.col("expires_at") > now)


def in_order_of(ids: DataFrame, position: str, key: str, rows: DataFrame) -> DataFrame:
    """Rows for a list of ids in its order; an id without a row stops the job."""
    joined = ids.join(rows.withColumn("_there", F.lit(True)), key, "left")
    known = F.when(F.col("_there").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string"))).cast("boolean"))
    return joined.where(known).drop("_there").orderBy(position)


def paper_files(papers: DataFrame) -> DataFrame:
    """``paper_id``, ``file_type``, ``path`` of the files that papers name."""
    return papers.where(F.col("pdf_url") != "").select(F.col("id").alias("paper_id"), F.lit("pdf").alias("file_type"), F.col("pdf_url").alias("path"))


def put_vectors(stored: DataFrame, new: DataFrame, size: int, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The index with new entries in place of old ones of their key; a vector of another length than ``size`` is an error."""
    checked = new.withColumn(vector, F.when(F.size(vector) == size, F.col(vector)).otherwise(F.raise_error(F.lit(f"vectors must have {size} components"))))
    return latest_wins(stored, checked, [key], [])
