from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from emberstream.llm import hmm


def whole(seq, p, into):
    """Expected counts of one sequence by the textbook's recursions, without scaling."""
    alpha, beta = [p.start * p.emit[seq[0]]], [np.ones(len(p.start))]
    for s in seq[1:]:
        alpha.append((alpha[-1] @ p.move) * p.emit[s])
    for s in seq[:0:-1]:
        beta.insert(0, p.move @ (p.emit[s] * beta[0]))
    z = alpha[-1].sum()
    into[0] += alpha[0] * beta[0] / z
    for t, s in enumerate(seq):
        into[2][s] += alpha[t] * beta[t] / z
        if t:
            into[1] += p.move * np.outer(alpha[t - 1], p.emit[s] * beta[t]) / z
    return np.log(z)


def test_long_texts_are_trained_on_as_whole_sequences(monkeypatch):
    rng = np.random.default_rng(3)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    k, n, sizes = 3, 7, [200, 64, 65, 1, 129, 30]
    p = hmm.Parameters(norm(rng.random(k), 0), norm(rng.random((k, k)) ** 4, 1), norm(rng.random((n, k)), 0))
    texts = [rng.integers(0, n, s).astype("<u2") for s in sizes]
    want = [np.zeros(k), np.zeros((k, k)), np.zeros((n, k))]
    total = sum(whole(t, p, want) for t in texts)
    for stretch, together, long in ((64, 4096, 4096), (7, 5, 4096), (1000, 2, 4096), (64, 4096, 0), (7, 5, 100), (7, 3, 1)):
        monkeypatch.setattr(hmm, "LONG", long)
        monkeypatch.setattr(hmm, "STRETCH", stretch)
        monkeypatch.setattr(hmm, "TOGETHER", together)
        batch = pa.record_batch([pa.array([t.tobytes() for t in texts], pa.binary())], names=["symbols"])
        (out,) = hmm._expectations(SimpleNamespace(value=p))([batch])
        rows = np.zeros((1 + k + n + 1, k))
        rows[out.column(0).to_numpy()] = np.stack([out.column(1 + j).to_numpy() for j in range(k)], 1)
        assert np.allclose(rows[0], want[0]) and np.allclose(rows[1 : 1 + k], want[1]) and np.allclose(rows[1 + k : -1], want[2])
        assert np.isclose(rows[-1].sum(), total)
