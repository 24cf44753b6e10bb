"""Tables of a data directory, and the rule for rows that were delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """``<data_dir>/<name>.parquet``, a file or a folder."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: a redelivered row repeats an earlier one with the same values.

    Select the needed columns first; only those are shuffled, and copies meet before the shuffle.
    """
    return df.dropDuplicates(list(keys))


def spread(scan: DataFrame) -> DataFrame:
    """A scan with far fewer partitions than there are cores, dealt out to all; any larger one as it is.

    For small files in front of Python stages. Select the needed columns first.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() * 2 <= cores else scan
