"""Documents that hold passages of evaluation items, by a hash set of the items' word windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, ITEM_WINDOWS_AT_ONCE = 13, 2_000_000

_WORD = re.compile(r"[^\W_]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` ids."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _PRIME + ids[k : k + len(out)].astype(np.uint64) + np.uint64(1)
        out ^= out >> np.uint64(29)
    return out


def words_of(text: str) -> list[str]:
    """The words of a text, in lower case. Each comes from one word of the text as written, so they can be counted there."""
    low = text.lower()
    return _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]


class ItemIndex:
    """Words of a block of items and, sorted by hash, their windows: what is sent to every task."""

    def __init__(self, items: list[tuple[int, str]], window: int) -> None:
        self.words: dict[str, int] = {}
        ids, owner, size = [], [], []
        for item, text in items:
            own = [self.words.setdefault(w, len(self.words)) for w in words_of(text or "")]
            if own:
                ids += own
                owner.append(item)
                size.append(len(own))
        self.ids = np.array(ids, np.int32)
        size, owner = np.array(size, np.int64), np.array(owner, np.int64)
        first = np.cumsum(size) - size
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by length: hash, first word, item
        self.filters: dict[int, np.ndarray] = {}
        for n in np.unique(np.minimum(size, window)).tolist():
            use = np.flatnonzero(np.minimum(size, window) == n)
            count = size[use] - n + 1
            at = np.repeat(first[use] - np.cumsum(count) + count, count) + np.arange(count.sum())
            hashes = rolling(self.ids, n)[at]
            order = np.argsort(hashes, kind="stable")
            self.windows[n] = (hashes[order], at[order].astype(np.int32), np.repeat(owner[use], count)[order])
            self.filters[n] = np.zeros(1 << 20, bool)
            self.filters[n][(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, texts: list[str | None]) -> np.ndarray:
        """Columns (text, item, first word, last word) of each verified window."""
        get = self.words.get
        ids: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                own = [get(w, -1) for w in words_of(t)]
                counts[i] = len(own)
                ids += own
            ids.append(-1)  # no window reaches over the end of a text
        stream = np.array(ids, np.int64)
        starts = np.concatenate([[0], np.cumsum(counts + 1)])
        unknown = np.concatenate([[0], np.cumsum(stream < 0)])
        found = [np.zeros((0, 4), np.int64)]
        for n, (known, at, item) in self.windows.items():
            if len(stream) < n:
                continue
            places = np.flatnonzero(unknown[n:] == unknown[:-n])
            hashes = rolling(stream, n)[places]
            near = self.filters[n][(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)]
            places, hashes = places[near], hashes[near]
            low, high = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
            met = high - low
            place = np.repeat(places, met)
            window = np.repeat(low - np.cumsum(met) + met, met) + np.arange(met.sum())
            for k in range(n):  # word by word
                same = stream[place + k] == self.ids[at[window] + k]
                place, window = place[same], window[same]
            text = np.searchsorted(starts, place, "right") - 1
            found.append(np.stack([text, item[window], place - starts[text], place - starts[text] + n - 1], axis=1))
        return np.concatenate(found)


def _blocks(items: DataFrame, item: str, text: str, at_once: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of a bounded number of windows, read partition by partition."""
    block, size = [], 0
    for key, value in items.select(item, text).where(F.col(item).isNotNull() & F.col(text).isNotNull()).toLocalIterator():
        block.append((key, value))
        size += len(value) // 2 + 1
        if size >= at_once:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(
    documents: DataFrame,
    items: DataFrame,
    doc: str = "doc_id",
    doc_text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    at_once: int = ITEM_WINDOWS_AT_ONCE,
) -> DataFrame:
    """``doc``, ``item``, ``n_windows``, ``first_word``, ``last_word`` for each document that holds a passage of an item.

    A word is a longest run of letters and digits, in lower case. A passage is ``window`` successive
    words of an item, or all words of a shorter one. Each hash hit is verified word by word. Items go
    to the tasks in blocks of at most ``at_once`` windows, one pass over the documents for each, so
    what is sent is bounded however many items there are; documents are never shuffled. Null and
    empty texts hold nothing; items without words are found nowhere; repeated document rows give one row.
    """
    spark = documents.sparkSession
    given = documents.select(F.col(doc).alias("doc"), F.col(doc_text).alias("text"))
    kind = given.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, item long, n_windows long, first_word long, last_word long"
    found = None
    for block in _blocks(items, item, item_text, at_once):
        shared = spark.sparkContext.broadcast(ItemIndex(block, window))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                spans: dict[tuple[int, int], list[int]] = {}
                for text, one, first, last in index.hits(batch.column(1).to_pylist()).tolist():
                    span = spans.setdefault((text, one), [0, first, last])
                    span[0] += 1
                    span[1], span[2] = min(span[1], first), max(span[2], last)
                keys = list(spans)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([k[0] for k in keys], pa.int64())),
                        pa.array([k[1] for k in keys], pa.int64()),
                        *[pa.array([s[i] for s in spans.values()], pa.int64()) for i in range(3)],
                    ],
                    ["doc", "item", "n_windows", "first_word", "last_word"],
                )

        rows = given.mapInArrow(search, schema)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.dropDuplicates(["doc", "item"]).withColumnsRenamed({"doc": doc, "item": item})


def without_leaks(
    documents: DataFrame,
    items: DataFrame,
    doc: str = "doc_id",
    doc_text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    at_once: int = ITEM_WINDOWS_AT_ONCE,
) -> DataFrame:
    """``doc``, ``clean_text`` and ``removed_words`` of every document: leaked passages cut out, the rest as it was.

    Blocks of items follow one another, each adds the passages it finds in the whole text; all are cut
    out at once at the end, so the result is the same for any ``at_once``. A word goes with the marks and
    white space behind it. A null text stays null.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(doc).alias("doc"), F.col(doc_text).alias("clean_text"), F.lit(None).cast("binary").alias("spans"))
    for block in _blocks(items, item, item_text, at_once):
        shared = spark.sparkContext.broadcast(ItemIndex(block, window))

        def mark(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                hits = index.hits(batch.column(1).to_pylist())
                spans = batch.column(2)
                if len(hits):
                    hits = np.unique(hits[:, [0, 2, 3]], axis=0)
                    held = spans.to_pylist()
                    edges = np.flatnonzero(np.concatenate([[True], hits[1:, 0] != hits[:-1, 0], [True]]))
                    for low, high in zip(edges, edges[1:]):
                        held[hits[low, 0]] = (held[hits[low, 0]] or b"") + hits[low:high, 1:].tobytes()
                    spans = pa.array(held, pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans], ["doc", "clean_text", "spans"])

        rows = rows.mapInArrow(mark, rows.schema)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = batch.column(1).to_pylist(), [0] * batch.num_rows
            for i, spans in enumerate(batch.column(2).to_pylist()):
                if spans:
                    texts[i], removed[i] = _without_words(texts[i], np.frombuffer(spans, np.int64).reshape(-1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], ["doc", "clean_text", "removed_words"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(remove, f"doc {kind}, clean_text string, removed_words long").withColumnRenamed("doc", doc)


def _without_words(text: str, spans: np.ndarray) -> tuple[str, int]:
    """The text without the words of the spans (first and last), each with what stands behind it, and their number."""
    starts = np.array([m.start() for m in _WORD.finditer(text)] + [len(text)], np.int64)
    covered = np.zeros(len(starts) + 1, np.int64)
    np.add.at(covered, spans[:, 0], 1)
    np.add.at(covered, spans[:, 1] + 1, -1)
    gone = np.cumsum(covered)[: len(starts) - 1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    kept, at = [], 0
    for low, high in edges.reshape(-1, 2).tolist():
        kept.append(text[at : starts[low]])
        at = int(starts[high])
    return "".join([*kept, text[at:]]), int(gone.sum())
