"""Linear-chain conditional random fields over coded tokens: training on a small labelled table, Viterbi in numpy batches.

A token is a code in each of several slots, and has the sum of its codes' weights for each label; moves from label to label have
weights of their own. A sequence is a run of tokens; sequences stand one after the other, ``first`` says where each begins.
"""

from __future__ import annotations

import numpy as np

#: Tokens that are decoded side by side, padding included.
BATCH_CELLS = 200_000


def emissions(p: dict, codes: dict[str, np.ndarray]) -> np.ndarray:
    """(tokens, labels): the weights of every token's codes, slot by slot."""
    total = None
    for slot, at in codes.items():
        total = p[slot][at] if total is None else total + p[slot][at]
    return total


def _padded(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(np.append(first, n))
    idx = first[:, None] + np.arange(sizes.max())
    mask = np.arange(sizes.max()) < sizes[:, None]
    return np.where(mask, idx, 0), mask


def fit(codes: dict[str, np.ndarray], sizes: dict[str, int], y: np.ndarray, first: np.ndarray, n_labels: int, rounds: int, decay: float, rate: float) -> dict:
    """Weights (of each slot's codes, and "move") that maximise the conditional likelihood less decay times their squares, by gradient
    steps (Adam) on forward-backward expectations over all sequences at once."""
    p = {slot: np.zeros((sizes[slot], n_labels)) for slot in codes} | {"move": np.zeros((n_labels, n_labels))}
    idx, mask = _padded(first, len(y))
    gold, n_rows = np.eye(n_labels)[y], len(first)
    m, v = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}
    lse = lambda a, axis: np.log(np.exp(a - a.max(axis, keepdims=True)).sum(axis)) + a.max(axis)
    for step in range(1, rounds + 1):
        e = emissions(p, codes)[idx]  # sequences, t, labels
        n, t, _ = e.shape
        fwd, bwd = np.zeros((t, n, n_labels)), np.zeros((t, n, n_labels))
        fwd[0] = e[:, 0]
        for k in range(1, t):
            new = lse(fwd[k - 1][:, :, None] + p["move"], 1) + e[:, k]
            fwd[k] = np.where(mask[:, k, None], new, fwd[k - 1])
        for k in range(t - 2, -1, -1):
            new = lse(p["move"] + (e[:, k + 1] + bwd[k + 1])[:, None, :], 2)
            bwd[k] = np.where(mask[:, k + 1, None], new, bwd[k + 1])
        z = lse(fwd[-1], 1)
        marginal = np.exp(fwd + bwd - z[:, None]).transpose(1, 0, 2)[mask]
        flat = np.empty_like(marginal)
        flat[idx[mask]] = marginal
        diff = (gold - flat) / n_rows
        g = {k: np.zeros_like(w) for k, w in p.items()}
        for slot, at in codes.items():
            np.add.at(g[slot], at, diff)
        pair = np.zeros((n_labels, n_labels))
        for k in range(1, t):
            both = np.exp(fwd[k - 1][:, :, None] + p["move"] + (e[:, k] + bwd[k])[:, None, :] - z[:, None, None])
            pair += both[mask[:, k]].sum(0)
        inside = np.ones(len(y), bool)
        inside[first] = False
        seen = np.zeros_like(pair)
        np.add.at(seen, (y[:-1][inside[1:]], y[1:][inside[1:]]), 1)
        g["move"] = (seen - pair) / n_rows
        for k in p:
            grad = g[k] - decay * p[k]
            m[k] += 0.1 * (grad - m[k])
            v[k] += 0.01 * (grad * grad - v[k])
            p[k] += rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
    return {k: w.astype(np.float32) for k, w in p.items()}


def best_labels(e: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best label of every token: Viterbi over all sequences side by side, in batches of similar length that hold about BATCH_CELLS
    tokens with what they are padded by, so a long sequence stands beside few others."""
    n_labels = e.shape[1]
    out = np.zeros(len(e), np.int8)
    sizes = np.diff(np.append(first, len(e)))
    order = np.argsort(sizes, kind="stable")
    hi = len(order)
    while hi:
        t = int(sizes[order[hi - 1]])  # the longest first: it sets the padding
        lo = max(0, hi - max(1, BATCH_CELLS // t))
        part, hi = order[lo:hi], lo
        idx = np.minimum(first[part][:, None] + np.arange(t), len(e) - 1)
        mask = np.arange(t) < sizes[part][:, None]
        best = e[idx[:, 0]]
        back = np.zeros((t, len(part), n_labels), np.int8)
        for k in range(1, t):
            step = best[:, :, None] + move
            back[k] = step.argmax(1)
            best = np.where(mask[:, k, None], step.max(1) + e[idx[:, k]], best)
        label = best.argmax(1)
        rows = np.arange(len(part))
        for k in range(t - 1, -1, -1):
            live = mask[:, k]
            out[idx[live, k]] = label[live]
            if k:
                label = np.where(live, back[k, rows, label], label)
    return out


def sequences(plain: np.ndarray, every: int = 32) -> np.ndarray:
    """Where sequences begin: at 0 and at the first plain token from each multiple of every on."""
    n = len(plain)
    if not n:
        return np.zeros(0, np.int64)
    where = np.flatnonzero(plain)
    marks = np.searchsorted(where, np.arange(every, n, every))
    return np.unique(np.concatenate([[0], where[marks[marks < len(where)]]]))
