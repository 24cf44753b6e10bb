"""Oversized texts cut into overlapping pieces at the deepest valleys of lexical cohesion."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_WORDS, MAX_CHARS, OVERLAP = 320, 2400, 120

_WORD = re.compile(r"\S+")
_TERM = re.compile(r"[^\W\d_]{3,}")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_LINE = re.compile(r"\n[^\S\n]*")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s+(?=[^\W_]|[\"'“‘«(\[#|*-])|[。！？][”’」』）]*\s*")
_ABBREVIATION = re.compile(r"(?:^|[\s(])(?:[^\W\d_]|e\.g|i\.e|al|cf|vs|Fig|Figs|Eq|Sec|Tab|No|Nos|Vol|pp|Dr|Mr|Mrs|Ms|Prof|St|bzw|Nr|Abb)$")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힯]")


def is_oversized(text: Column, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS) -> Column:
    """Whether a text breaks a limit. Words are counted only where the length leaves it open."""
    length = F.length(text)
    return (length > max_chars) | ((length > 2 * max_words) & (F.regexp_count(text, F.lit(r"(?U)\S+")) > max_words))


def natural_boundaries(text: str) -> dict[int, str]:
    """Positions where a paragraph, line or sentence begins, with the strongest kind of each."""
    found: dict[int, str] = {}
    for m in _SENTENCE.finditer(text):
        if text[m.start()] != "." or not _ABBREVIATION.search(text, max(0, m.start() - 12), m.start()):
            found[m.end()] = "sentence"
    for m in _LINE.finditer(text):
        found[m.end()] = "line"
    for m in _PARAGRAPH.finditer(text):
        found[m.end()] = "paragraph"
    return {at: kind for at, kind in found.items() if 0 < at < len(text)}


def valley_depths(text: str, boundaries: list[int], block: int = 3) -> list[float]:
    """How far the similarity of the blocks on either side falls at each boundary below the peaks around it."""
    edges = [0, *boundaries, len(text)]
    units = [Counter(w.lower() for w in _TERM.findall(text, a, b)) for a, b in zip(edges, edges[1:])]
    similar = []
    for i in range(1, len(units)):
        left, right = Counter(), Counter()
        for u in units[max(0, i - block) : i]:
            left.update(u)
        for u in units[i : i + block]:
            right.update(u)
        norm = math.sqrt(sum(v * v for v in left.values()) * sum(v * v for v in right.values()))
        similar.append(sum(v * right[w] for w, v in left.items()) / norm if norm else 0.0)

    def peaks(values: list[float]) -> list[float]:
        best, out = 0.0, []
        for i, v in enumerate(values):
            best = max(best, v) if i and v <= values[i - 1] else v
            out.append(best)
        return out

    ahead = peaks(similar)
    behind = peaks(similar[::-1])[::-1]
    return [a + b - 2 * s for a, b, s in zip(ahead, behind, similar)]


def _overlap_start(text: str, begin: int, end: int, overlap: int) -> int:
    """Where the next piece begins: at a whole word within the last ``overlap`` characters before ``end``."""
    at = max(begin, end - overlap)
    if at > begin and not text[at - 1].isspace() and not (_CJK.match(text, at) or _CJK.match(text, at - 1)):
        while at < end and not text[at].isspace():
            at += 1
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def split_text(text: str, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(begin, end, kind of the cut at the end) of each piece of ``text``.

    A window reaches from half of what still fits to the last character that fits; the deepest
    valley among its natural boundaries is the cut, failing that the deepest before the window,
    then the last word, then the last character. White space alone is one empty piece.
    """
    starts = [m.start() for m in _WORD.finditer(text)]
    if len(text) <= max_chars and len(starts) <= max_words:
        return [(0, len(text), "end")]
    kinds = natural_boundaries(text)
    places = sorted(kinds)
    depths = valley_depths(text, places)
    pieces: list[tuple[int, int, str]] = []
    begin = fresh = 0
    while True:
        first_word = bisect_right(starts, begin - 1)
        limit = begin + max_chars
        if first_word + max_words < len(starts):
            limit = min(limit, starts[first_word + max_words])
        if limit >= len(text):
            pieces.append((begin, len(text), "end"))
            return pieces
        low, high = bisect_right(places, fresh), bisect_right(places, limit)
        middle = bisect_right(places, fresh + (limit - fresh) // 2)
        window = range(middle, high) if middle < high else range(low, high)
        if window:
            best = max(window, key=lambda i: (depths[i], i))
            cut, kind = places[best], kinds[places[best]]
        else:
            word = bisect_right(starts, limit) - 1
            cut, kind = (starts[word], "word") if word >= 0 and starts[word] > fresh else (limit, "character")
        end = begin + len(text[begin:cut].rstrip())
        if end > begin:
            pieces.append((begin, end, kind))
        rest = cut
        while rest < len(text) and text[rest].isspace():
            rest += 1
        if rest >= len(text):
            return pieces or [(0, 0, "end")]
        begin, fresh = min(_overlap_start(text, begin, end, overlap), rest), rest


def split_oversized(
    df: DataFrame, keys: list[str], text: str = "content", max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP
) -> DataFrame:
    """The pieces of every oversized text: ``keys``, ``piece_index``, ``begin``, ``end``, ``cut``, ``n_words``, ``piece``.

    Rows with equal keys count once. Null, empty and fitting texts have no pieces. Columns besides
    ``keys`` and ``text`` are left out, whatever their names. Every piece is a stretch of the text;
    together they cover all of it but white space at cuts. A word longer than a piece is cut within.
    """
    if overlap * 2 > max_chars or max_words < 2:
        raise ValueError("the overlap must leave room for new text")
    given = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("text"))
    names = [f"k{i}" for i in range(len(keys))]
    given = given.where(is_oversized(F.col("text"), max_words, max_chars)).dropDuplicates(names)
    fields = [T.StructField(n, given.schema[n].dataType) for n in names]
    fields += [T.StructField("piece_index", T.IntegerType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]
    fields += [T.StructField("cut", T.StringType()), T.StructField("n_words", T.IntegerType()), T.StructField("piece", T.StringType())]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, value in batch.itertuples(index=False, name=None):
                for i, (a, b, kind) in enumerate(split_text(value, max_words, max_chars, overlap)):
                    rows.append((*key, i, a, b, kind, len(value[a:b].split()), value[a:b]))
            yield pd.DataFrame(rows, columns=[f.name for f in fields])

    return given.mapInPandas(pieces, T.StructType(fields)).toDF(*keys, "piece_index", "begin", "end", "cut", "n_words", "piece")
