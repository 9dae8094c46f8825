"""A two-state linear-chain conditional random field over hashed word features.

All documents of a slice form one chain in which every document start resets the state,
so forward and backward run as a blocked scan: rows of the reshaped chain advance side
by side in numpy, and a short pass over the rows' 2x2 products joins them. The result
is that of the textbook recursions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from quarry.llm._words import SEPARATES, Texts, byte_codes, rolling

BITS, WIDTH = 18, 128
#: Words whose recursions are held at once in training.
CHUNK = 1 << 17
#: Prefixes of a word in bytes; 0 is the word itself.
PREFIXES = (0, 4, 5, 6, 7, 8)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[Texts, np.ndarray]:
    """Normalised words, and for each the hashed features (a column per entry of PREFIXES)."""
    texts = Texts(data, offsets, SEPARATES)
    codes, roll = byte_codes(True)[data], rolling(0xD6E8FEB86659FD93)
    columns = []
    for k, size in enumerate(PREFIXES):
        ends = np.minimum(texts.ends, texts.starts + size) if size else texts.ends
        hashed = roll.runs(codes, texts.starts, ends) ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        columns.append((hashed >> np.uint64(64 - BITS)).astype(np.int32))
    return texts, np.stack(columns, 1) if len(texts.starts) else np.zeros((0, len(PREFIXES)), np.int32)


@dataclass
class Field:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = -4.0
    #: Log potentials of the transitions from state i to j, and of the first state.
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(1, dtype=np.float64) + self.bias

    def marginals(self, features: np.ndarray, starts: np.ndarray, pairs: bool = False):
        """Probability of state 1 for each word; with ``pairs`` also the expected moves and first states."""
        n = len(features)
        if not n:
            return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if pairs else np.zeros(0)
        rows = -(-n // WIDTH)
        lift = np.exp(np.clip(self.scores(features), -30, 30))
        a, s = np.exp(self.moves), np.exp(self.first)
        m = np.empty((4, rows * WIDTH))
        m[0, :n], m[1, :n], m[2, :n], m[3, :n] = a[0, 0], a[0, 1] * lift, a[1, 0], a[1, 1] * lift
        m[0, starts] = m[2, starts] = s[0]
        m[1, starts] = m[3, starts] = s[1] * lift[starts]
        m[:, n:] = 1.0
        m = np.ascontiguousarray(m.reshape(4, rows, WIDTH).transpose(2, 0, 1))
        p = np.repeat(np.array([[1.0], [0.0], [0.0], [1.0]]), rows, 1)
        for c in range(WIDTH):
            q = m[c]
            p = np.stack([p[0] * q[0] + p[1] * q[2], p[0] * q[1] + p[1] * q[3], p[2] * q[0] + p[3] * q[2], p[2] * q[1] + p[3] * q[3]])
            p /= p.sum(0)
        ahead, behind = np.empty((2, rows)), np.empty((2, rows))
        v = np.array([1.0, 0.0])
        products = p.T.reshape(rows, 2, 2)
        for r in range(rows):
            ahead[:, r] = v
            v = v @ products[r]
            v /= v.sum()
        v = np.array([0.5, 0.5])
        for r in range(rows - 1, -1, -1):
            behind[:, r] = v
            v = products[r] @ v
            v /= v.sum()
        forward = np.empty((WIDTH, 2, rows))
        f0, f1 = ahead
        for c in range(WIDTH):
            q = m[c]
            f0, f1 = f0 * q[0] + f1 * q[2], f0 * q[1] + f1 * q[3]
            t = f0 + f1
            f0, f1 = f0 / t, f1 / t
            forward[c, 0], forward[c, 1] = f0, f1
        backward = np.empty((WIDTH, 2, rows))
        b0, b1 = behind
        for c in range(WIDTH - 1, -1, -1):
            backward[c, 0], backward[c, 1] = b0, b1
            q = m[c]
            b0, b1 = q[0] * b0 + q[1] * b1, q[2] * b0 + q[3] * b1
            t = b0 + b1
            b0, b1 = b0 / t, b1 / t
        both = forward * backward
        p1 = (both[:, 1] / both.sum(1)).T.reshape(-1)[:n]
        if not pairs:
            return p1
        f = forward.transpose(2, 0, 1).reshape(-1, 2)[:n]
        b = backward.transpose(2, 0, 1).reshape(-1, 2)[:n]
        inner = np.ones(n, bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        joint = f[at - 1][:, :, None] * (a[None] * np.stack([np.ones(len(at)), lift[at]], 1)[:, None, :]) * b[at][:, None, :]
        moves = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        return p1, moves, np.array([(1 - p1[starts]).sum(), p1[starts].sum()])

    def fit(self, features: np.ndarray, starts: np.ndarray, labels: np.ndarray, rounds: int = 20, rate: float = 0.3, decay: float = 1e-4,
        chunk: int = CHUNK) -> Field:
        """Full-batch Adagrad on the conditional log likelihood of the labels. Documents are
        gone through in chunks of about ``chunk`` words, which bounds what is held at once."""
        n = len(features)
        inner = np.ones(n, bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        seen = np.bincount(2 * labels[at - 1] + labels[at], minlength=4).reshape(2, 2).astype(float)
        begun = np.array([(~labels[starts]).sum(), labels[starts].sum()], float)
        self.bias = 0.0
        self.moves = np.log((seen + 1) / (seen + 1).sum(1, keepdims=True))
        self.first = np.log((begun + 1) / (begun + 1).sum())
        edges = np.unique(starts[np.minimum(np.searchsorted(starts, np.arange(0, n, chunk)), len(starts) - 1)])
        bounds = list(zip(edges, [*edges[1:], n], strict=True))
        square = np.full(len(self.weights), 1e-6)
        for _ in range(rounds):
            slope, moves, first = -decay * self.weights.astype(float), np.zeros((2, 2)), np.zeros(2)
            for low, high in bounds:
                own = features[low:high]
                mine = starts[np.searchsorted(starts, low) : np.searchsorted(starts, high)] - low
                p, m, f = self.marginals(own, mine, True)
                miss = labels[low:high] - p
                for column in own.T:
                    slope += np.bincount(column, miss, len(slope))
                moves += m
                first += f
            square += slope**2
            self.weights += (rate * slope / np.sqrt(square)).astype(np.float32)
            self.moves += 0.1 * (seen - moves) / (seen.sum(1, keepdims=True) + 1)
            self.first += 0.1 * (begun - first) / (begun.sum() + 1)
        return self
