"""Texts packed into containers of fixed capacity, by patterns over the histogram of their lengths."""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.session import cut

CAPACITY = 2048


def default_ranks() -> str:
    """Place of the byte-pair ranks of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def load_tokenizer(ranks_path: str, pattern: str | None = None):
    """The tokenizer of a file of ranks; each Python worker reads it once."""
    import tiktoken

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, doc: str = "doc_id", text: str = "text", ranks_path: str | None = None) -> DataFrame:
    """``doc`` and ``n_tokens`` of each row; a null text has none."""
    path = ranks_path or default_ranks()
    given = df.select(F.col(doc).alias("doc"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc", "n_tokens"])

    schema = T.StructType([T.StructField("doc", given.schema["doc"].dataType), T.StructField("n_tokens", T.LongType())])
    return given.mapInArrow(count, schema)


@dataclass
class Pattern:
    """``count`` containers that each hold ``times`` items of every listed length."""

    count: int
    left: int
    items: list[tuple[int, int]] = field(default_factory=list)

    def extended(self, count: int, length: int, times: int) -> Pattern:
        items = list(self.items)
        if items and items[-1][0] == length:
            items[-1] = (length, items[-1][1] + times)
        else:
            items.append((length, times))
        return Pattern(count, self.left - length * times, items)


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold each length as often as ``histogram`` says: longest lengths first, each to the shortest packs.

    The shortest packs are those with most space left; where none has room, a new one is filled with
    the length before another is opened. A pattern that only part of the items fill is split in two.
    The work depends on the number of lengths, not on the number of items.
    """
    by_left: dict[int, list[Pattern]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"no container of {capacity} holds an item of {length}")
        todo = histogram[length]
        while todo:
            left = max((x for x, packs in by_left.items() if packs), default=0)
            if left >= length:
                old, times = by_left[left].pop(), 1
            else:  # no pack has room: a new one is the shortest until it is filled
                left, times = capacity, min(todo, capacity // length)
                old = Pattern(todo // times, capacity)
            count = min(old.count, todo // times)
            new = old.extended(count, length, times)
            by_left[new.left].append(new)
            todo -= count * times
            if count < old.count:
                by_left[left].append(Pattern(old.count - count, left, old.items))
    return [p for packs in by_left.values() for p in packs]


def _slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank behind the last, first container, items per container, place in the container)."""
    ranks: dict[int, int] = defaultdict(int)
    container, rows = 0, []
    for p in patterns:
        at = 0
        for length, times in p.items:
            first = ranks[length]
            ranks[length] = first + times * p.count
            rows.append((length, first, ranks[length], container, times, at))
            at += length * times
        container += p.count
    return rows


def pack(df: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """``container_id``, ``place``, ``doc``, ``piece_index``, ``first_token``, ``n_tokens`` of each packed item.

    ``place`` is the item's first token in its container, ``first_token`` that in its document. A
    text larger than a container is cut into full containers and a rest; all others stay whole.
    Rows with equal ``doc`` count once. A null or empty text takes no room: its container is null.
    Only the histogram (at most ``capacity`` rows) comes to the driver, and the slots that go back
    are bounded by it. Items are ranked within (length, salt), so a length of a third of all items
    is spread over as many tasks as there are shuffle partitions.
    """
    spark = df.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = cut(token_counts(df, doc, text, ranks_path).dropDuplicates(["doc"]))
    pieces = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int")
    items = sizes.select("doc", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece_index"), F.col("n_tokens").alias("all_tokens"))
    items = items.withColumn("first_token", F.col("piece_index").cast("long") * capacity)
    items = items.withColumn("n_tokens", F.least(F.lit(capacity), F.col("all_tokens") - F.col("first_token"))).drop("all_tokens")
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc", "piece_index"), F.lit(salts)).cast("int"))

    counts = items.where("n_tokens > 0").groupBy("n_tokens", "salt").count()
    histogram = {r[0]: r[1] for r in counts.groupBy("n_tokens").agg(F.sum("count")).collect()}
    slots = spark.createDataFrame(
        _slots(pack_histogram(histogram, capacity)), "n_tokens long, first long, behind long, container long, times long, at long"
    )
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("n_tokens", "salt").orderBy("doc", "piece_index")
    ranked = items.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["n_tokens", "salt"], "left")
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("ahead")).alias("i")
    placed = ranked.join(
        F.broadcast(slots).alias("s"),
        F.expr("i.n_tokens = s.n_tokens AND i.rank >= s.first AND i.rank < s.behind"),
        "left",
    )
    turn = F.col("i.rank") - F.col("s.first")
    return placed.select(
        (F.col("s.container") + F.floor(turn / F.col("s.times"))).alias("container_id"),
        (F.col("s.at") + F.pmod(turn, F.col("s.times")) * F.col("i.n_tokens")).alias("place"),
        F.col("i.doc").alias(doc),
        "i.piece_index",
        "i.first_token",
        F.col("i.n_tokens"),
    )


def container_usage(packed: DataFrame) -> DataFrame:
    """``container_id``, ``n_items``, ``n_tokens`` of each container."""
    return packed.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
