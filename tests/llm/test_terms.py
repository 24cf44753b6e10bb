from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwell.llm import terms


def clean(phrases):
    return [t for t in (" ".join(p.lower().split()) for p in phrases if p is not None) if t]


def test_terms(spark):
    rows = [("a", ["Dense Index", " dense  index ", "dense", None, ""]), ("b", ["index dense", "dense"]), ("b", ["index dense", "dense"]), ("c", None), ("d", []), ("e", ["  ", None]), ("f", ["dense index of dense index", "x"])]
    df = spark.createDataFrame(rows, "id string, keywords array<string>")
    found = {(r.term): (r.occurrences, r.records, r.all_records) for r in terms.with_totals(terms.cut_counts([(df, "k", "id", "keywords")])).collect()}
    assert found == {"dense index": (2, 1, 3), "dense": (2, 2, 3), "index dense": (1, 1, 3), "dense index of dense index": (1, 1, 3), "x": (1, 1, 3)}
    assert terms.phrase_counts([(df.limit(0), "k", "id", "keywords")]).count() == 0


def test_phrase_parts(spark):
    rows = [(i, [" ".join("ab"[(i * k + j) % 2] for j in range(k + 1)) for k in range(4)] * (1 + i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, keywords array<string>")
    occurrences, records = Counter(), Counter()
    for _, phrases in rows:
        own = Counter()
        for p in clean(phrases):
            w = p.split()
            own.update(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
        occurrences.update(own)
        records.update(own.keys())
    found = {r.term: (r.occurrences, r.records) for r in terms.phrase_counts([(df, "k", "id", "keywords")], parts_up_to=3).where("term IS NOT NULL").collect()}
    assert found == {t: (occurrences[t], records[t]) for t in occurrences}


def test_mark(spark):
    df = spark.createDataFrame([(2, 100), (3, 100), (5, 100), (6, 100)], "r long, n long")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(terms.mark(F.col("r"), F.col("n"))).collect()] == ["rare", None, None, "common"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=40))
def test_suffix_array(values):
    tokens = np.array([*values, 9], np.int64)
    order = terms.suffix_array(tokens)
    suffixes = [tuple(tokens[i:]) for i in order]
    assert suffixes == sorted(suffixes)
    shared = terms.common_prefixes(tokens, order, 5)
    for k in range(1, len(order)):
        a, b = suffixes[k - 1], suffixes[k]
        n = 0
        while n < min(len(a), len(b), 5) and a[n] == b[n]:
            n += 1
        assert shared[k] == n
