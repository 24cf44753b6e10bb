import itertools

import numpy as np

from tarnwell.llm.crf import Chain


def chain(seed):
    rng = np.random.default_rng(seed)
    c = Chain(["O", "B-x", "I-x"], lambda t: [t])
    c.steps = rng.standard_normal((3, 3))
    return c, rng


def paths(c, emit):
    for y in itertools.product(range(3), repeat=len(emit)):
        score = emit[0, y[0]] + c.first_bars[y[0]] + sum(emit[t, b] + c.steps[a, b] + c.bars[a, b] for t, (a, b) in enumerate(zip(y, y[1:]), 1))
        if score > -1e3:
            yield y, score


def test_marginals_and_decoding_match_enumeration():
    for seed in range(6):
        c, rng = chain(seed)
        lengths = np.array([5, 3, 1])
        emit = rng.standard_normal((3, 5, 3)) * 2
        chance, pairs = c._marginals(emit, lengths)
        expected_pairs = np.zeros((3, 3))
        flat, starts = np.concatenate([emit[i, :n] for i, n in enumerate(lengths)]), np.array([0, 5, 8])
        decoded = c.decode(flat.astype(np.float32), starts, lengths)
        for i, n in enumerate(lengths):
            found = list(paths(c, emit[i, :n]))
            total = sum(np.exp(s) for _, s in found)
            expected = np.zeros((n, 3))
            for y, s in found:
                for t in range(n):
                    expected[t, y[t]] += np.exp(s) / total
                for a, b in zip(y, y[1:]):
                    expected_pairs[a, b] += np.exp(s) / total
            assert np.allclose(chance[i, :n], expected, atol=1e-9)
            assert tuple(decoded[starts[i] : starts[i] + n]) == max(found, key=lambda f: f[1])[0]
        assert np.allclose(pairs, expected_pairs, atol=1e-9)


def test_fit_learns_a_pattern():
    rows = [(["the", "cat", "sat"], [0, 1, 0]), (["a", "big", "cat", "cat"], [0, 0, 1, 2]), (["the", "dog"], [0, 0])] * 30
    c = Chain(["O", "B-x", "I-x"], lambda t: ["word=" + t] if t else ["edge"], reach=1).fit(rows, epochs=30, batch=16, often=1, few=1)
    table = c.table(["", "my", "cat", "cat"])
    emit = c.emissions(table, np.array([0, 1, 2, 3, 0]), np.array([1, 2, 3]) - 1)
    assert c.decode(emit, np.array([0]), np.array([3])).tolist() == [0, 1, 2]
