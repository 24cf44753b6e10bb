import numpy as np
from pyspark.sql import functions as F

from tarnwell.llm import vectors

SCHEMA = "id long, model_name string, embedding array<float>"
DIMENSIONS = {"m": 8, "n": 4}


def exact(rows, k):
    out = {}
    for model, size in DIMENSIONS.items():
        good = sorted((i, np.array(v, np.float64)) for i, m, v in {r[0]: r for r in rows}.values() if m == model and v is not None and len(v) == size and None not in v and np.isfinite(v).all() and np.any(v))
        if not good:
            continue
        ids, x = np.array([i for i, _ in good]), np.stack([v / np.linalg.norm(v) for _, v in good])
        s = x @ x.T
        np.fill_diagonal(s, -9)
        for i, row in zip(ids, s):
            out[int(i)] = [int(ids[j]) for j in np.argsort(-row, kind="stable")[:k] if row[j] > -9]
    return out


def test_recall_and_places(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 8))
    rows = [(i, "m", (centres[i % 12] + 0.3 * rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = vectors.neighbours(df, dimensions=DIMENSIONS, k=5, leaf=150, sample=1000).toPandas()
    truth = exact(rows, 5)
    got = {i: set(g.neighbour_id) for i, g in found.groupby("vector_id")}
    assert all(len(g) == 5 for g in got.values()) and set(got) == set(truth)
    assert np.mean([len(got[i] & set(t)) / 5 for i, t in truth.items()]) >= 0.9
    several = vectors.neighbours(df, dimensions=DIMENSIONS, k=5, leaf=50, region=300, sample=1000).toPandas()  # more than one region
    got = {i: set(g.neighbour_id) for i, g in several.groupby("vector_id")}
    assert all(len(g) == 5 for g in got.values()) and set(got) == set(truth) and not several.duplicated(["vector_id", "neighbour_id"]).any()
    assert np.mean([len(got[i] & set(t)) / 5 for i, t in truth.items()]) >= 0.95
    some = vectors.neighbours(df, dimensions=DIMENSIONS, k=5, leaf=150, sample=1000, queries=F.col("id") % 50 == 0).toPandas()
    assert set(some.vector_id) == {i for i in truth if i % 50 == 0} and (some.groupby("vector_id").place.max() == 5).all()


def test_recall_with_many_cells(spark):
    """The more cells there are, the more a query visits: recall holds however small a share a cell is."""
    rng = np.random.default_rng(6)
    rows = [(i, "m", rng.standard_normal(8).astype(np.float32).tolist()) for i in range(4000)]
    found = vectors.neighbours(spark.createDataFrame(rows, SCHEMA), dimensions=DIMENSIONS, k=5, leaf=12, sample=4000, queries=F.col("id") % 8 == 0).toPandas()
    truth = {i: t for i, t in exact(rows, 5).items() if i % 8 == 0}
    got = {i: set(g.neighbour_id) for i, g in found.groupby("vector_id")}
    assert np.mean([len(got.get(i, set()) & set(t)) / 5 for i, t in truth.items()]) >= 0.97


def test_cells_follow_the_number_of_rows():
    """Where the sample is too small to cut cells further, they are halved on; every vector has one home among them."""
    rng = np.random.default_rng(1)
    sample = rng.standard_normal((500, 8)).astype(np.float32)
    for rows in (1_000, 100_000, 10_000_000):
        tree = vectors.HashTree(sample, rows, 1_000, 3)
        assert rows / 1_000 <= tree.leaves <= max(1, 16 * rows / 1_000)
        others = rng.standard_normal((20_000, 8)).astype(np.float32)
        home = tree.visits(others, 1)[:, 0]
        assert np.bincount(home).max() <= max(1, 12 / tree.leaves) * 20_000
        seen = tree.visits(others[:50], 5)
        assert (seen[:, 0] == home[:50]).all() and all(len(set(r)) == len(r) for r in seen.tolist())


def test_one_vector_a_third_of_all_rows(spark):
    rng = np.random.default_rng(2)
    hot = [1.0] * 8
    rows = [(i, "m", hot if i % 3 == 0 else rng.standard_normal(8).astype(np.float32).tolist()) for i in range(900)]
    found = vectors.neighbours(spark.createDataFrame(rows, SCHEMA).repartition(3), k=4).toPandas()
    assert (found.groupby("vector_id").size() == 4).all() and found.vector_id.nunique() == 900
    got = {i: g.sort_values("place").neighbour_id.tolist() for i, g in found.groupby("vector_id")}
    assert got[0] == [3, 6, 9, 12] and got[6] == [0, 3, 9, 12] and got[897] == [0, 3, 6, 9]
    # a model's length is the one most of its vectors have
    assert set(vectors.neighbours(spark.createDataFrame([(1, "z", [1.0, 2.0]), (2, "z", [2.0, 1.0]), (3, "z", [1.0])], SCHEMA)).toPandas().vector_id) == {1, 2}


def test_cases(spark):
    one = [1.0] * 8
    rows = [(i, "m", one) for i in range(1, 15)] + [(20, "m", [2.0] * 7 + [1.0]), (21, "m", None), (22, "m", [0.0] * 8), (23, "m", [float("nan")] + [1.0] * 7), (24, "m", [1.0]), (25, "m", [float("inf")] + [1.0] * 7)]
    rows += [(30, "n", [1.0, 0.0, 0.0, 0.0]), (31, "n", [0.5, 0.5, 0.0, 0.0]), (32, "other", [1.0] * 8), (33, None, [1.0] * 8), (1, "m", one), (34, "n", [None, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).withColumn("vector", F.lit(1))
    found = vectors.neighbours(df, dimensions=DIMENSIONS, k=10).toPandas()
    got = {i: g.sort_values("place").neighbour_id.tolist() for i, g in found.groupby("vector_id")}
    assert set(got) == {*range(1, 15), 20, 30, 31}
    assert got[1] == list(range(2, 12)) and got[14] == list(range(1, 11))  # copies first, by id
    assert got[20] == list(range(1, 11)) and got[30] == [31] and got[31] == [30]
    pairs = [tuple(r) for r in vectors.pairs(vectors.neighbours(df, dimensions=DIMENSIONS, k=10)).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs) and (30, 31) in pairs
    assert vectors.neighbours(df.limit(0), dimensions=DIMENSIONS).count() == 0


def test_asking_vectors_come_in_parts(spark):
    """However few of the vectors that ask in a region are held at a time, each finds what it finds when all are held."""
    rng = np.random.default_rng(8)
    rows = [(i, "m", rng.standard_normal(8).astype(np.float32).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows + rows[:100], SCHEMA).repartition(5)
    found = [sorted((r.vector_id, r.neighbour_id) for r in vectors.neighbours(df, dimensions=DIMENSIONS, k=5, leaf=50, region=300, sample=1000, visits=40, at_once=n).collect()) for n in (16, 10**6)]
    assert len(found[0]) == len(set(found[0])) == 6000
    assert len(set(found[0]) & set(found[1])) >= 5990  # equal but for cosines that rounding tells apart
