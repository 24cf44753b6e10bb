"""Nearest neighbours of every vector: multiprobe p-stable hashing in two levels, then exact cosines.

A first tree of p-stable hash functions deals all vectors out to regions of bounded size, so its depth
follows the number of rows. A vector lies in one region and asks there; where regions are many it also
asks in the next likeliest ones. Within a region several hash tables are visited in order of estimated
success, and what they bring is ranked by exact cosines. Only a vector itself is shuffled, once for each
region it asks in; candidates never leave the task that found them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.session import cut

NEIGHBOURS, TABLES, VISITS, LEAF, REGION, SAMPLE = 10, 4, 4, 2048, 65_536, 20_000
RECALL, ASKED, ASKED_WITHIN, ASKED_AT_ONCE, SALTS = 0.99, 256, 128, 32_768, 64


class HashTree:
    """p-stable functions floor((a·v + b) / w), applied one after another until a cell is small.

    Fitted on a bounded sample, which fixes the widths; every vector has a cell. Where the sample runs
    out the cells are halved on by further functions at the medians met last, so the depth follows the
    number of rows and not the size of the sample.
    """

    def __init__(self, sample: np.ndarray, rows: int, cell: int, seed: int, fewest: int = 16) -> None:
        rng = np.random.default_rng(seed)
        self.most_depth = 24 + int(np.ceil(np.log2(max(2.0, rows / cell))))
        self.directions = rng.standard_normal((self.most_depth, sample.shape[1])).astype(np.float32)
        shifts = rng.random(self.most_depth)
        projected = sample @ self.directions.T
        nodes: list[tuple[int, np.ndarray, list[int]]] = []  # depth, inner edges, children; a child below 0 is leaf ~child
        self.leaves = 0

        def grow(own: np.ndarray, expected: float, depth: int) -> int:
            if expected <= cell or depth == self.most_depth or not len(own):
                self.leaves += 1
                return ~(self.leaves - 1)
            p = projected[own, depth]
            low, high = np.quantile(p, [0.05, 0.95])
            width = (high - low) / 2
            if width <= 0:
                return grow(own, expected, depth + 1)
            at = len(nodes)
            nodes.append((depth, np.empty(0), []))
            if len(own) < fewest:
                nodes[at] = (depth, np.array([np.median(p)]), [grow(own, expected / 2, depth + 1) for _ in range(2)])
                return at
            code = np.floor((p - low) / width + shifts[depth])
            cells = np.unique(code)
            if len(cells) == 1:
                nodes.pop()
                return grow(own, expected, depth + 1)
            edges = (cells[1:] - shifts[depth]) * width + low
            nodes[at] = (depth, edges, [grow(own[code == c], expected * np.mean(code == c), depth + 1) for c in cells])
            return at

        self.root = grow(np.arange(len(sample)), float(rows), 0)
        most = max([len(n[2]) for n in nodes], default=1)
        self.depth = np.array([n[0] for n in nodes], np.int64)
        self.edges = np.full((len(nodes), most + 1), np.inf, np.float32)
        self.children = np.zeros((len(nodes), most), np.int64)
        self.has = np.zeros((len(nodes), most), bool)
        for i, (_, inner, children) in enumerate(nodes):
            self.edges[i, 0] = -np.inf
            self.edges[i, 1 : len(children)] = inner
            self.children[i, : len(children)] = children
            self.has[i, : len(children)] = True

    def visits(self, vectors: np.ndarray, most: int, at_once: int = 4096) -> np.ndarray:
        """Leaves to visit, home first: by squared distance along the functions used, the smaller the likelier a success.

        Of the cells on the way down only the ``2 * most`` nearest are kept, which holds the work to the depth of the tree.
        """
        most = min(most, self.leaves)
        out = np.zeros((len(vectors), most), np.int64)
        for first in range(0, len(vectors), at_once) if len(self.depth) else ():
            projected = vectors[first : first + at_once] @ self.directions.T
            rows = np.arange(len(projected))[:, None]
            node, score = np.full((len(projected), 1), self.root), np.zeros((len(projected), 1), np.float32)
            while (node >= 0).any():
                inner = node >= 0
                at = np.where(inner, node, 0)
                p = projected[rows, self.depth[at]][..., None]
                away = np.maximum(np.maximum(self.edges[at][..., :-1] - p, p - self.edges[at][..., 1:]), 0)
                reach = np.where(inner[..., None] & self.has[at], score[..., None] + away * away, np.inf)
                reach[..., 0] = np.where(inner, reach[..., 0], score)
                child = np.where(np.isfinite(reach), self.children[at], -1)  # what is no cell is a leaf that is never near
                child[..., 0] = np.where(inner, child[..., 0], node)
                node, score = child.reshape(len(child), -1), reach.reshape(len(child), -1)
                if node.shape[1] > 2 * most:
                    near = np.argpartition(score, 2 * most - 1, axis=1)[:, : 2 * most]
                    node, score = node[rows, near], score[rows, near]
            order = np.argsort(score, axis=1, kind="stable")[:, :most]
            out[first : first + at_once] = ~node[rows, order]
        return out


def _best(cosines: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest cosines of each row, in order, and what goes with them."""
    order = np.argsort(-cosines, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(cosines, order, 1), others[np.arange(len(others))[:, None], order]


def _needed_visits(trees: list[HashTree], asked: np.ndarray, true: list[np.ndarray], least: int, recall: float) -> int:
    """Cells a query must visit in each tree so that ``recall`` of the true neighbours (vectors for each of ``asked``) come up in one of them."""
    turns = []
    for one, near in zip(asked, true):
        if len(near):
            orders = [np.argsort(t.visits(one[None], t.leaves)[0]) for t in trees]  # of each leaf its turn
            turns.append(np.min([order[t.visits(near, 1)[:, 0]] for t, order in zip(trees, orders)], axis=0))
    if not turns:
        return least
    turns = np.sort(np.concatenate(turns))
    return max(least, int(turns[min(len(turns), int(np.ceil(recall * len(turns)))) - 1]) + 1)


class Found:
    """The best ``k`` candidates of each query so far; only what beats the last of them is kept."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.data, self.cosine = np.full((queries, k), -1, np.int64), np.full((queries, k), -np.inf, np.float32)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, rows: np.ndarray, data: np.ndarray, cosines: np.ndarray) -> None:
        if len(rows):
            self.held.append((rows, data, cosines))
            self.count += len(rows)
            if self.count > 4 * self.data.size + 1_000_000:
                self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        old = np.flatnonzero(self.data.ravel() >= 0)
        parts = [(old // self.k, self.data.ravel()[old], self.cosine.ravel()[old]), *self.held]
        rows, data, cosines = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((data, -cosines, rows))
        rows, data, cosines = rows[order], data[order], cosines[order]
        again = np.zeros(len(rows), bool)  # one pair from several tables has one cosine up to rounding: told apart by its data
        by_pair = np.lexsort((data, rows))
        again[by_pair[1:]] = (rows[by_pair[1:]] == rows[by_pair[:-1]]) & (data[by_pair[1:]] == data[by_pair[:-1]])
        rows, data, cosines = rows[~again], data[~again], cosines[~again]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        use = place < self.k
        self.data.fill(-1)
        self.cosine.fill(-np.inf)
        self.data[rows[use], place[use]], self.cosine[rows[use], place[use]] = data[use], cosines[use]
        self.held, self.count = [], 0


class Region:
    """Multiprobe tables over the data of a region; queries are answered in parts of any size.

    As many cells are visited as find ``recall`` of the true neighbours of up to ``ASKED_WITHIN`` of the first queries, compared with all data of the region.
    """

    def __init__(self, data: np.ndarray, tables: int, leaf: int) -> None:
        self.data, self.visits = data, 0
        every = max(1, len(data) // SAMPLE)
        self.trees = [HashTree(data[::every], len(data), leaf, 7919 * t + 17) for t in range(tables)] if len(data) else []
        self.homes = []
        for tree in self.trees:
            home = tree.visits(data, 1)[:, 0]
            by_leaf = np.argsort(home, kind="stable")
            self.homes.append((by_leaf, np.searchsorted(home[by_leaf], np.arange(tree.leaves + 1))))

    def measure(self, queries: np.ndarray, own: np.ndarray, k: int, visits: int, recall: float) -> None:
        data, self.visits = self.data, max(visits, self.visits)
        if len(queries) and self.trees and max(t.leaves for t in self.trees) > visits:
            some = np.unique(np.linspace(0, len(queries) - 1, min(ASKED_WITHIN, len(queries))).astype(int))
            cosines = queries[some] @ data.T
            cosines[own[some] >= 0, own[some][own[some] >= 0]] = -np.inf
            most = min(k, len(data))
            near = np.argpartition(-cosines, most - 1, axis=1)[:, :most]
            good = np.isfinite(np.take_along_axis(cosines, near, 1))
            self.visits = max(self.visits, _needed_visits(self.trees, queries[some], [data[n[g]] for n, g in zip(near, good)], visits, recall))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, block: int = 1 << 21) -> Found:
        """The ``k`` data rows most similar to each query; ``own`` is a query's own place in the data or -1."""
        found, data = Found(len(queries), k), self.data
        if not len(queries):
            return found
        for tree, (by_leaf, edges) in zip(self.trees, self.homes):
            seen = tree.visits(queries, self.visits)
            cells, turn = seen.ravel(), np.arange(seen.size) // seen.shape[1]
            asking = np.argsort(cells, kind="stable")
            bounds = np.searchsorted(cells[asking], np.arange(tree.leaves + 1))
            for cell in range(tree.leaves):
                members = by_leaf[edges[cell] : edges[cell + 1]]
                asked = turn[asking[bounds[cell] : bounds[cell + 1]]]
                if not len(members) or not len(asked):
                    continue
                there = data[members]
                for i in range(0, len(asked), max(1, block // len(members))):
                    rows = asked[i : i + max(1, block // len(members))]
                    cosines = queries[rows] @ there.T
                    least = found.cosine[rows, -1]
                    fresh = np.flatnonzero(np.isneginf(least))
                    if len(fresh) and len(members) > k:  # no bound yet: the k-th best of this cell
                        least = least.copy()
                        least[fresh] = np.partition(cosines[fresh], len(members) - k - 1, axis=1)[:, len(members) - k - 1]
                    at = np.flatnonzero((cosines >= least[:, None]).ravel())  # flat places are much faster than pairs
                    row, column = rows[at // len(members)], members[at % len(members)]
                    other = own[row] != column
                    found.add(row[other], column[other], cosines.ravel()[at][other])
            found.settle()
        return found


def _usable(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of that length and the vectors."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    fits = np.flatnonzero(pa.compute.equal(pa.compute.list_value_length(vectors), size).fill_null(False).to_numpy(zero_copy_only=False))
    flat = vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), size) + 0.0
    good = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
    return fits[good], flat[good]


def _units(batches: Iterator[pa.RecordBatch], dimensions: dict[str, int]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Model, ids, asked, keys (equal for equal vectors) and unit vectors of the usable rows of each batch (id, model, vector, asked)."""
    for batch in batches:
        models = np.array(batch.column(1).to_pylist(), object)
        for name in set(models.tolist()) & dimensions.keys():
            rows = np.flatnonzero(models == name)
            part = batch.take(pa.array(rows))
            at, flat = _usable(part.column(2), dimensions[name])
            if len(at):
                keys = np.array([xxhash.xxh3_64_intdigest(v.tobytes(), len(name)) for v in flat], np.uint64).astype(np.int64)
                flat /= np.abs(flat).max(axis=1, keepdims=True)
                flat /= np.linalg.norm(flat, axis=1, keepdims=True)
                yield name, part.column(0).to_numpy()[at], part.column(3).to_numpy(zero_copy_only=False)[at].astype(bool), keys, flat.astype(np.float32)


def _lists(counts: np.ndarray, *fields: tuple[str, pa.Array]) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([f for _, f in fields], names=[n for n, _ in fields]))


def _places(groups: np.ndarray) -> np.ndarray:
    """Place of each entry within its run of equal groups."""
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, np.int64)
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))


_ROUTED = "region long, key long, id long, asked boolean, asks boolean, unit binary"
_COMPARED = "key long, own array<struct<id: long, asked: boolean>>, near array<struct<away: float, id: long>>"


def neighbours(
    df: DataFrame,
    vector_id: str = "id",
    model: str = "model_name",
    vector: str = "embedding",
    dimensions: dict[str, int] | None = None,
    k: int = NEIGHBOURS,
    queries: Column | None = None,
    tables: int = TABLES,
    visits: int = VISITS,
    leaf: int = LEAF,
    region: int = REGION,
    sample: int = SAMPLE,
    recall: float = RECALL,
    at_once: int = ASKED_AT_ONCE,
) -> DataFrame:
    """``vector_id``, ``neighbour_id``, ``cosine``, ``place`` of the ``k`` most similar usable vectors of the same model.

    Regions of about ``region`` vectors at most are cut by a tree fitted on about ``sample`` vectors a
    model; every vector is indexed in one. A query asks in as many regions, and in each visits as many cells
    of about ``leaf`` vectors in each of ``tables`` tables, as find ``recall`` of the true neighbours of some
    vectors that are compared with all rows. Cosines are exact. A task holds the vectors of a region and at most
    about ``at_once`` of those that ask in it, however many ask.

    Equal vectors are searched once: each has its copies as neighbours first, by id, then the others; of
    equal vectors only the ``k + 1`` least ids of each batch travel, so a vector with a third of all rows
    is a few rows. ``dimensions`` gives the models and the length of their vectors; without it every model
    counts, with the length most of its vectors have. Unusable vectors (null, of another length, with null,
    NaN or infinite components, all zero) and other models have no rows; with fewer than ``k`` others all
    are given. A row that comes again counts once. ``queries`` (a condition on the columns of ``df``) leaves
    out other query rows, never rows of the index. Other columns are left out.
    """
    spark = df.sparkSession
    wanted = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    given = df.select(F.col(vector_id).cast("long").alias("id"), F.col(model).cast("string").alias("model"), F.col(vector).cast("array<float>").alias("vector"), wanted.alias("asked"))
    given = given.where(F.col("id").isNotNull() & F.col("model").isNotNull() & (F.size("vector") > 0))

    rows_of: dict[str, tuple[int, int]] = {}  # a row for each model and length
    for name, size, n in given.groupBy("model", F.size("vector").alias("size")).count().orderBy("model", "size").collect():
        if size == dimensions.get(name) if dimensions is not None else n > rows_of.get(name, (0, 0))[1]:
            rows_of[name] = (size, n)
    sizes = {name: size for name, (size, _) in rows_of.items()}

    regions: dict[str, HashTree] = {}
    asks_in: dict[str, int] = {}
    for name, (size, n) in rows_of.items():
        some = np.zeros((1, size), np.float32)
        if n > region:
            part = given.where((F.col("model") == name) & (F.pmod(F.xxhash64("id"), F.lit(max(1, n // sample))) == 0))
            parts = part.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([u.tobytes()], pa.binary())], ["u"]) for *_, u in _units(batches, sizes)), "u binary").collect()
            some = np.frombuffer(b"".join(r[0] for r in parts), np.float32).reshape(-1, size) if parts else some
        regions[name] = HashTree(some, n, region, 4241)
        asks_in[name] = 1
        if regions[name].leaves > 1:
            asked = some[np.linspace(0, len(some) - 1, min(ASKED, len(some))).astype(int)]
            asks_in[name] = _needed_visits([regions[name]], asked, _true_neighbours(given.where(F.col("model") == name), asked, sizes, k), 1, recall)
    shared = spark.sparkContext.broadcast((regions, asks_in))
    names = sorted(regions)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, most = shared.value
        for name, ids, asked, keys, units in _units(batches, sizes):
            order = np.lexsort((ids, keys))
            order = order[np.concatenate([[True], (keys[order[1:]] != keys[order[:-1]]) | (ids[order[1:]] != ids[order[:-1]])])]
            place = _places(keys[order])
            firsts = order[place == 0]
            asks = np.logical_or.reduceat(asked[order], np.flatnonzero(place == 0))
            homes = trees[name].visits(units[firsts], most[name]) * len(names) + names.index(name)
            inner = np.cumsum(place == 0) - 1
            use = place <= k
            put = [(homes[inner[use], 0], order[use], place[use] == 0, np.ones(use.sum(), bool), asks[inner[use]])]
            for v in range(1, homes.shape[1]):
                at = np.flatnonzero(asks)
                put.append((homes[at, v], firsts[at], np.ones(len(at), bool), np.zeros(len(at), bool), asks[at]))
            cells, at, whole, home, asks = (np.concatenate(p) for p in zip(*put))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells), pa.array(keys[at]), pa.array(ids[at], mask=~home), pa.array(asked[at]), pa.array(asks), pa.array([units[i].tobytes() if w else None for i, w in zip(at, whole)], pa.binary())],
                ["region", "key", "id", "asked", "asks", "unit"],
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that lie in the region come first, then those that only ask in it, by key: of these, few are held at a time."""
        home: list[pa.RecordBatch] = []
        asking: list[pa.RecordBatch] = []
        answer = None
        for batch in batches:
            here = batch.num_rows - batch.column("id").null_count
            home += [batch.slice(0, here)] if here else []
            if here == batch.num_rows:
                continue
            asking.append(batch.slice(here))
            if sum(len(x) for x in asking) < at_once:
                continue
            table = pa.Table.from_batches(asking)
            keys = table.column("key").to_numpy()
            cut_at = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if cut_at:
                if answer is None:
                    answer = Answers(home, table.schema)
                    yield from answer.at_home()
                yield answer.elsewhere(table.slice(0, cut_at))
                asking = table.slice(cut_at).to_batches()
        if answer is None and home + asking:
            answer = Answers(home, (home + asking)[0].schema)
            home = []
            yield from answer.at_home()
        if asking:
            yield answer.elsewhere(pa.Table.from_batches(asking))

    class Answers:
        def __init__(self, home: list[pa.RecordBatch], schema: pa.Schema) -> None:
            table = pa.Table.from_batches(home, schema)
            key, asked, ids = table.column("key").to_numpy(), table.column("asked").to_numpy(zero_copy_only=False).astype(bool), table.column("id").to_numpy()
            asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            self.keys, units = unit_rows(table)
            at = np.searchsorted(self.keys, key)
            self.asker = np.flatnonzero(np.bincount(at, weights=asks, minlength=len(self.keys)) > 0)
            # the least ids of each key
            order = np.lexsort((~asked, ids, at))
            order = order[np.concatenate([[True], (at[order[1:]] != at[order[:-1]]) | (ids[order[1:]] != ids[order[:-1]])])] if len(order) else order
            order = order[_places(at[order]) <= k]
            self.copies = np.bincount(at[order], minlength=len(self.keys))
            self.starts = np.cumsum(self.copies) - self.copies
            self.ids, self.asked = ids[order], asked[order]
            self.region = Region(units, tables, leaf)
            self.measured = False

        def at_home(self) -> Iterator[pa.RecordBatch]:
            units = self.region.data
            self.region.measure(units[self.asker], self.asker, k, visits, recall)
            for i in range(0, len(self.asker), at_once):
                own = self.asker[i : i + at_once]
                yield self.rows(self.keys[own], units[own], own)

        def elsewhere(self, table: pa.Table) -> pa.RecordBatch:
            keys, units = unit_rows(table)
            other = ~np.isin(keys, self.keys)
            keys, units = keys[other], units[other]
            if not self.measured:
                self.region.measure(units, np.full(len(keys), -1), k, visits, recall)
                self.measured = True
            return self.rows(keys, units, np.full(len(keys), -1))

        def rows(self, keys: np.ndarray, units: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            found = self.region.search(units, own, k)
            row, place = np.nonzero(found.data >= 0)
            near = found.data[row, place]
            # from keys to ids: every copy counts, until there are k
            row, near, cosine = (np.repeat(x, self.copies[near]) for x in (row, near, found.cosine[row, place]))
            turn = np.arange(len(row)) - np.repeat(*_run_starts(row, near)) if len(row) else np.zeros(0, np.int64)
            neighbour = self.ids[self.starts[near] + turn]
            use = _places(row) < k
            row, neighbour, cosine = row[use], neighbour[use], cosine[use]
            copies = np.where(own >= 0, self.copies[own], 0) if len(self.copies) else np.zeros(len(own), np.int64)
            mine = np.repeat(np.where(own >= 0, self.starts[own], 0), copies) + _places(np.repeat(np.arange(len(own)), copies)) if copies.any() else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys),
                    _lists(copies, ("id", pa.array(self.ids[mine])), ("asked", pa.array(self.asked[mine]))),
                    _lists(np.bincount(row, minlength=len(own)), ("away", pa.array(-cosine, pa.float32())), ("id", pa.array(neighbour))),
                ],
                ["key", "own", "near"],
            )

    def unit_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The keys in order, each once, and their vectors."""
        key, packed = table.column("key").to_numpy(), table.column("unit").combine_chunks()
        whole = np.flatnonzero(packed.is_valid().to_numpy(zero_copy_only=False))
        keys, first = np.unique(key[whole], return_index=True)
        if not len(keys):
            return keys, np.zeros((0, 1), np.float32)
        packed = packed.take(pa.array(whole[first]))
        low, high = (np.frombuffer(packed.buffers()[1], np.int32)[packed.offset + i] for i in (0, len(packed)))
        return keys, np.frombuffer(packed.buffers()[2], np.uint8)[low:high].view(np.float32).reshape(len(keys), -1)

    routed = given.mapInArrow(route, _ROUTED).repartition("region").sortWithinPartitions("region", F.col("id").isNull(), "key")
    compared = routed.groupBy("region").applyInArrow(compare, _COMPARED)
    # regions hold different vectors, so their lists only have to be put in one order
    near = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    merged = cut(compared.groupBy("key").agg(F.max("own").alias("own"), near.alias("near")))

    def listed(rows: DataFrame) -> DataFrame:
        others = F.transform(F.filter("own", lambda x: x.id != F.col("vector_id")), lambda x: F.struct(F.lit(-1.0).cast("float").alias("away"), x.id.alias("id")))
        wide = rows.select("vector_id", F.posexplode(F.slice(F.concat(others, "near"), 1, k)).alias("at", "n"))
        return wide.select("vector_id", F.col("n.id").alias("neighbour_id"), (-F.col("n.away")).alias("cosine"), (F.col("at") + 1).alias("place"))

    out = listed(merged.select("own", "near", F.explode("own").alias("o")).where("o.asked").select(F.col("o.id").alias("vector_id"), "own", "near"))
    large = merged.where(F.size("own") > k)
    if large.limit(1).count():  # copies beyond the first k + 1: their rows are found by key, in salted parts

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, ids, asked, keys, _ in _units(batches, sizes):
                yield pa.RecordBatch.from_arrays([pa.array(keys[asked]), pa.array(ids[asked])], ["key", "vector_id"])

        rest = given.where("asked").mapInArrow(members, "key long, vector_id long").withColumn("salt", F.pmod(F.xxhash64("vector_id"), F.lit(SALTS)))
        salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rest = rest.dropDuplicates(["key", "vector_id"]).join(salted, ["key", "salt"])
        out = out.unionByName(listed(rest.where(~F.exists("own", lambda x: x.id == F.col("vector_id")))))
    return out


def _run_starts(row: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of one (row, near)."""
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (near[1:] != near[:-1])]))
    return first, np.diff(np.append(first, len(row)))


def _true_neighbours(given: DataFrame, asked: np.ndarray, sizes: dict[str, int], k: int) -> list[np.ndarray]:
    """The ``k`` vectors most similar to each of ``asked`` among all rows, compared one by one in one pass; ``ASKED`` lists come to the driver."""
    size = asked.shape[1]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cosines, rows = np.empty((len(asked), 0), np.float32), np.empty((len(asked), 0, size), np.float32)
        for *_, units in _units(batches, sizes):
            for i in range(0, len(units), 4096):
                part = np.unique(units[i : i + 4096], axis=0)
                new = asked @ part.T
                most = min(2 * k + 1, len(part))
                near = np.argpartition(-new, most - 1, axis=1)[:, :most]
                cosines, rows = _best(np.concatenate([cosines, np.take_along_axis(new, near, 1)], 1), np.concatenate([rows, part[near]], 1), 2 * k + 1)
        if cosines.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(asked)), pa.int32()), pa.array([c.tobytes() for c in cosines], pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())], ["n", "cosines", "rows"])

    def merged(group: pa.Table) -> pa.Table:
        cosines = np.frombuffer(b"".join(group.column("cosines").to_pylist()), np.float32)[None]
        rows = np.frombuffer(b"".join(group.column("rows").to_pylist()), np.float32).reshape(1, -1, size)
        return pa.table({"n": group.column("n")[:1], "rows": pa.array([_best(cosines, rows, 2 * k + 1)[1].tobytes()], pa.binary())})

    found = given.mapInArrow(nearest, "n int, cosines binary, rows binary").groupBy("n").applyInArrow(merged, "n int, rows binary").collect()
    out = [np.zeros((0, size), np.float32)] * len(asked)
    for n, rows in found:
        near = np.unique(np.frombuffer(rows, np.float32).reshape(-1, size), axis=0)
        near = near[np.argsort(-(near @ asked[n]), kind="stable")]
        out[n] = near[1 : k + 1]  # the first is the vector itself
    return out


def pairs(found: DataFrame) -> DataFrame:
    """Unordered pairs of ``neighbours``, smaller id first, each once."""
    low, high = F.least("vector_id", "neighbour_id"), F.greatest("vector_id", "neighbour_id")
    return found.select(low.alias("vector_id_a"), high.alias("vector_id_b")).distinct()
