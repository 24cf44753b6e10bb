"""Occurrences and record counts of all phrases, from suffix arrays with common-prefix intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.session import cut

RARE_BELOW, COMMON_PERCENT = 3, 5


def normal_terms(phrases: Column) -> Column:
    """Lower case, trimmed, white space single; nulls and empty terms fall away, repeats stay."""
    one = F.transform(phrases, lambda x: F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " ")))
    return F.filter(one, lambda x: x.isNotNull() & (x != ""))


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling. The last token must be unlike all others."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while n and rank.max() < n - 1:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + follow, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return np.argsort(rank, kind="stable")


def common_prefixes(tokens: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the prefix each suffix shares with the one before it in ``order``, up to ``most``."""
    shared = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for k in range(most):
        a, b = order[live] + k, order[live - 1] + k
        inside = (a < len(tokens)) & (b < len(tokens))
        live, a, b = live[inside], a[inside], b[inside]
        live = live[tokens[a] == tokens[b]]
        if not len(live):
            break
        shared[live] += 1
    return shared


def _stream(terms: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Tokens of all records (0 ends a term, a number above all words ends a record), their record, the tokens left in the term, and the words."""
    flat = terms.flatten().dictionary_encode()
    texts, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
    words: dict[str, int] = {}
    spelled = [np.array([words.setdefault(w, len(words) + 1) for w in t.split(" ")], np.int64) for t in texts]
    per_term = np.array([len(s) for s in spelled], np.int64)
    counts = np.diff(terms.offsets.to_numpy())
    size = per_term[codes] + 1
    record = np.repeat(np.arange(len(counts)), counts)
    # each record: 0, words, 0, words, 0, end
    begins = np.concatenate([[0], np.cumsum(size)])[:-1] + 2 * record
    total = int(size.sum()) + 2 * len(counts)
    tokens = np.zeros(total, np.int64)
    if len(codes):
        run = np.concatenate([spelled[c] for c in codes])
        first = np.repeat(begins + 1 - np.concatenate([[0], np.cumsum(per_term[codes])[:-1]]), per_term[codes])
        tokens[first + np.arange(len(run))] = run
    lengths = np.bincount(record, weights=size, minlength=len(counts)).astype(np.int64) + 2
    ends = np.cumsum(lengths) - 1
    tokens[ends] = len(words) + 1 + np.arange(len(ends))
    return tokens, np.repeat(np.arange(len(counts)), lengths), ends, list(words)


def _groups(order: np.ndarray, same: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First suffix, occurrences and records of each interval; ``same`` says that a suffix continues the interval before it.

    Two neighbours of one record within an interval count that record twice; each such pair is taken off.
    """
    group = np.cumsum(~same) - 1
    occurrences = np.bincount(group)
    by_record = np.lexsort((np.arange(len(order)), record[order]))
    r, g = record[order][by_record], group[by_record]
    twice = np.zeros(len(order), bool)
    twice[1:] = (r[1:] == r[:-1]) & (g[1:] == g[:-1])
    return order[~same], occurrences, occurrences - np.bincount(g[twice], minlength=len(occurrences))


def _whole(terms: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    tokens, record, _, words = _stream(terms)
    stops = np.flatnonzero(tokens == 0)
    reach = np.zeros(len(tokens), np.int64)
    reach[stops[:-1]] = np.diff(stops) + 1
    order = suffix_array(tokens)
    shared = common_prefixes(tokens, order, int(reach.max(initial=0)))
    starts = (tokens[order] == 0) & (tokens[np.minimum(order + 1, len(tokens) - 1)] <= len(words))
    at = order[starts]
    same = shared[starts] >= reach[at]
    same[:1] = False
    first, occurrences, records = _groups(at, same, record)
    return [" ".join(words[t - 1] for t in tokens[i + 1 : i + reach[i] - 1]) for i in first], occurrences, records


def _parts(terms: pa.ListArray, most: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    tokens, record, _, words = _stream(terms)
    stops = np.flatnonzero((tokens == 0) | (tokens > len(words)))
    left = stops[np.searchsorted(stops, np.arange(len(tokens)))] - np.arange(len(tokens))
    most = most or int(left.max(initial=0))
    order = suffix_array(tokens)
    shared = common_prefixes(tokens, order, most)
    grams: list[str] = []
    found = []
    for n in range(1, most + 1):
        inside = left[order] >= n
        at, same = order[inside], shared[inside] >= n
        same[:1] = False
        first, occurrences, records = _groups(at, same, record)
        grams += [" ".join(words[t - 1] for t in tokens[i : i + n]) for i in first]
        found.append((occurrences, records))
    return grams, np.concatenate([o for o, _ in found]), np.concatenate([r for _, r in found])


def _counted(df: DataFrame, field: str, record: str, phrases: str, most: int | None) -> DataFrame:
    """Counts of each batch of records. A row with a null term has the number of records with a term."""
    given = df.select(F.col(record).alias("record"), F.col(phrases).alias("phrases")).dropDuplicates(["record"])
    given = given.select(normal_terms(F.col("phrases")).alias("terms")).where(F.size("terms") > 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            if not len(column):
                continue
            terms, occurrences, records = _whole(column) if most is None else _parts(column, most)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([field] * (len(terms) + 1)),
                    pa.array([*terms, None], pa.string()),
                    pa.array(np.append(occurrences, 0), pa.int64()),
                    pa.array(np.append(records, len(column)), pa.int64()),
                ],
                ["field_name", "term", "occurrences", "records"],
            )

    return given.mapInArrow(count, "field_name string, term string, occurrences long, records long")


def phrase_counts(fields: list[tuple[DataFrame, str, str, str]], parts_up_to: int | None = None) -> DataFrame:
    """``field_name``, ``term``, ``occurrences`` and ``records`` of every term; a null term has the number of records with a term.

    ``fields`` has (table, name of the field, record column, column with an array of phrases). Rows of
    one record count once. With
    ``parts_up_to`` all word n-grams within the phrases up to that length (0: of any length) are counted instead.
    Each task builds the suffix array of the records it holds; a record is whole in one task, so the
    counts of the tasks add up, and a term that half of all records hold is one row per task.
    Null and empty arrays, null and blank phrases do not count; no rows give no rows.
    """
    counted = [_counted(df, name, record, phrases, parts_up_to) for df, name, record, phrases in fields]
    rows = counted[0]
    for more in counted[1:]:
        rows = rows.unionByName(more)
    summed = rows.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return summed


def cut_counts(fields: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """``phrase_counts`` written to the shared folder, as counts and totals are both read from it."""
    return cut(phrase_counts(fields))


def with_totals(summed: DataFrame) -> DataFrame:
    """``phrase_counts`` with the number of records of each field (one row for each field, so it is sent to all)."""
    totals = summed.where(F.col("term").isNull()).select("field_name", F.col("records").alias("all_records"))
    return summed.where(F.col("term").isNotNull()).join(F.broadcast(totals), "field_name")


def mark(records: Column, all_records: Column, rare_below: int = RARE_BELOW, common_percent: int = COMMON_PERCENT) -> Column:
    """``rare``, ``common`` or null for a term worth keeping."""
    return F.when(records < rare_below, "rare").when(records * 100 > all_records * common_percent, "common")
