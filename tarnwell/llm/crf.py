"""A linear-chain conditional random field in numpy: features of token types at offsets, batched training and decoding."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np

BARRED = -1e4


class Chain:
    """Weights for each (offset, feature, label), for each step from label to label, and bars on steps that cannot be."""

    def __init__(self, labels: list[str], features_of: Callable[[str], list[str]], reach: int = 4) -> None:
        self.labels, self.features_of, self.reach = labels, features_of, reach
        self.features: dict[str, int] = {}
        self.kept: set[str] = set()
        k = len(labels)
        self.bars = np.zeros((k, k))
        self.first_bars = np.zeros(k)
        for j, to in enumerate(labels):
            if to.startswith("I-"):
                self.first_bars[j] = BARRED
                for i, origin in enumerate(labels):
                    if origin[2:] != to[2:] or origin == "O":
                        self.bars[i, j] = BARRED
        self.steps = np.zeros((k, k))
        self.weights = np.zeros((0, 2 * reach + 1, k))

    def numbers(self, token: str, grow: bool = False) -> list[int]:
        if grow:
            return [self.features.setdefault(f, len(self.features)) for f in self.features_of(token) if f in self.kept]
        known = self.features
        return [known[f] for f in self.features_of(token) if f in known]

    def table(self, tokens: list[str]) -> np.ndarray:
        """(offset, token, label) scores that each token type adds at each offset."""
        out = np.zeros((2 * self.reach + 1, len(tokens), len(self.labels)), np.float32)
        weights = self.weights.astype(np.float32)
        for first in range(0, len(tokens), 8192):
            owned = [self.numbers(t) for t in tokens[first : first + 8192]]
            some = np.array([i for i, own in enumerate(owned) if own], np.int64)
            if len(some):
                starts = np.cumsum([0] + [len(owned[i]) for i in some])[:-1]
                flat = np.array([f for own in owned for f in own], np.int64)
                out[:, first + some] = np.add.reduceat(weights[flat], starts, axis=0).transpose(1, 0, 2)
        return out

    def emissions(self, table: np.ndarray, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of the labels at places ``at`` of a stream of types that is padded by ``reach`` at both ends."""
        out = np.zeros((len(at), len(self.labels)), np.float32)
        for o in range(2 * self.reach + 1):
            out += table[o][padded[at + o]]
        return out

    def fit(self, examples: list[tuple[list[str], list[int]]], epochs: int = 12, batch: int = 192, rate: float = 0.08, decay: float = 2e-4, often: int = 8, few: int = 5, seed: int = 5) -> Chain:
        """Maximum likelihood by Adam over batches of whole examples. Words met less than ``often``, names say, are known by their other features only."""
        rng = np.random.default_rng(seed)
        types: dict[str, int] = {"": 0}
        seen = Counter(f for tokens, _ in examples for t in tokens for f in self.features_of(t))
        self.kept = {f for f, n in seen.items() if n >= (often if f.startswith("word=") else few)}
        coded = [(np.array([types.setdefault(t, len(types)) for t in tokens], np.int64), np.array(labels)) for tokens, labels in examples]
        per_type = [self.numbers(t, grow=True) for t in types]
        self.kept = set()
        width, k, r = max(map(len, per_type)), len(self.labels), self.reach
        none = len(self.features)
        matrix = np.full((len(types), width), none)
        for i, own in enumerate(per_type):
            matrix[i, : len(own)] = own
        self.weights = np.zeros((none + 1, 2 * r + 1, k))
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (self.weights, self.steps)]
        turn, turns = 0, epochs * max(1, len(coded) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(coded))
            order = np.concatenate([part[np.argsort([len(coded[i][0]) for i in part], kind="stable")] for part in np.array_split(order, max(1, len(order) // (8 * batch)))])
            for own in np.array_split(order, max(1, len(order) // batch)):
                turn += 1
                slower = rate * max(0.03, 1 - turn / turns)
                some = [coded[i] for i in own]
                lengths = np.array([len(t) for t, _ in some])
                long = int(lengths.max())
                grid = np.zeros((len(some), long + 2 * r), np.int64)
                gold = np.zeros((len(some), long), np.int64)
                for i, (t, y) in enumerate(some):
                    grid[i, r : r + len(t)], gold[i, : len(t)] = t, y
                inside = np.arange(long) < lengths[:, None]
                used, at = np.unique(grid, return_inverse=True)
                at = at.reshape(grid.shape)
                scores = self.weights[matrix[used]].sum(axis=1)
                emit = sum(scores[at[:, o : o + long], o] for o in range(2 * r + 1))
                chance, pairs = self._marginals(emit, lengths)
                slope = (chance - np.eye(k)[gold]) * inside[..., None]
                by_type = np.zeros((len(used), 2 * r + 1, k))
                for o in range(2 * r + 1):
                    places = at[:, o : o + long].ravel()
                    for j in range(k):
                        by_type[:, o, j] = np.bincount(places, weights=slope[..., j].ravel(), minlength=len(used))
                step_slope = pairs - np.bincount((gold[:, :-1] * k + gold[:, 1:])[inside[:, 1:]], minlength=k * k).reshape(k, k)
                rows = matrix[used].ravel()
                order = np.argsort(rows, kind="stable")
                starts = np.flatnonzero(np.concatenate([[True], np.diff(rows[order]) > 0]))
                touched, total = rows[order][starts], np.add.reduceat(by_type[order // width], starts, axis=0)
                for weight, slope_of, (m, v), part in ((self.weights, total, moments[0], touched), (self.steps, step_slope, moments[1], slice(None))):
                    g = slope_of / len(some) + decay * weight[part]
                    m[part] = 0.9 * m[part] + 0.1 * g
                    v[part] = 0.99 * v[part] + 0.01 * g * g
                    weight[part] -= slower * (m[part] / (1 - 0.9**turn)) / (np.sqrt(v[part] / (1 - 0.99**turn)) + 1e-6)
                self.weights[none] = 0
        self.weights = self.weights[:none]
        return self

    def _marginals(self, emit: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chance of each label at each place, and expected steps from label to label."""
        n, long, k = emit.shape
        steps = np.exp(self.steps + self.bars)
        weight = np.exp(emit - emit.max(axis=2, keepdims=True))
        ahead, behind = np.zeros_like(weight), np.ones_like(weight)
        scale = np.ones((n, long))
        ahead[:, 0] = weight[:, 0] * np.exp(self.first_bars)
        for t in range(long):
            if t:
                ahead[:, t] = (ahead[:, t - 1] @ steps) * weight[:, t]
            scale[:, t] = ahead[:, t].sum(axis=1)
            ahead[:, t] /= scale[:, t, None]
        onward = np.zeros((n, k))
        pairs = np.zeros((k, k))
        for t in range(long - 2, -1, -1):
            live = (t + 1 < lengths)[:, None]
            onward = np.where(live, weight[:, t + 1] * behind[:, t + 1] / scale[:, t + 1, None], 0)
            behind[:, t] = np.where(live, onward @ steps.T, 1)
            pairs += ahead[:, t].T @ onward
        return ahead * behind, pairs * steps

    def decode(self, emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at_once: int = 4096, cells: int = 1 << 21) -> np.ndarray:
        """Likeliest labels of many runs; ``emit`` holds the runs one behind the other. Runs of like lengths go together, ``cells`` places at once."""
        out = np.zeros(len(emit), np.int8)
        steps = (self.steps + self.bars).astype(np.float32)
        order = np.argsort(-lengths, kind="stable")
        i = 0
        while i < len(order):
            own = order[i : i + max(1, min(at_once, cells // max(1, int(lengths[order[i]]))))]
            i += len(own)
            begin, size = starts[own], lengths[own]
            long = int(size[0])
            back = np.zeros((long, len(own), len(self.labels)), np.int8)
            score = emit[begin] + self.first_bars.astype(np.float32)
            live = np.array([np.count_nonzero(size > t) for t in range(long)])
            final = score.copy()
            for t in range(1, long):
                m = live[t]
                moves = score[:m, :, None] + steps
                back[t, :m] = moves.argmax(axis=1)
                score = np.take_along_axis(moves, back[t, :m, None, :].astype(np.int64), 1)[:, 0] + emit[begin[:m] + t]
                final[:m] = score
            label = final.argmax(axis=1)
            for t in range(long - 1, -1, -1):
                m = live[t]
                out[begin[:m] + t] = label[:m]
                if t:
                    label[:m] = back[t, np.arange(m), label[:m]]
        return out
