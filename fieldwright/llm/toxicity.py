"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own hashed embedding and the mean of those of its character trigrams. The network reads windows of 24
words that start every 12, so that every word is in two; a text's score is that of its most toxic window. Training has labels
of texts only: each toxic text teaches by the window that looks most toxic so far, each other one by its most toxic
looking window and by random ones.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, labelled, map_texts

WINDOW, STRIDE = 24, 12
WORD_BITS, CHAR_BITS = 14, 12
EMBED, HIDDEN = 8, 8
#: Words that a worker remembers at most; none is longer than 64 characters.
CACHED_WORDS = 200_000
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"


def words_of(text: str) -> list[str]:
    """The words between white space; one of more than 64 characters as pieces of 64 that start every 48, so that each character
    is read and what is no longer than 16 is whole in one piece."""
    words = text.split()
    if max(map(len, words), default=0) <= 64:
        return words
    return [w[k:k + 64] for w in words for k in range(0, max(1, len(w) - 16), 48)]


def word_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word, lower-cased and without marks at its ends: the row of its own embedding, and the rows of those of
    its character trigrams (edges count), with where each word's begin."""
    bare = [w.lower().strip(_EDGE) for w in words]
    own = np.array([xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) for w in bare], np.int64) & ((1 << WORD_BITS) - 1)
    u = np.frombuffer("".join([f"\x02{w}\x03" for w in bare]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in bare], np.int64)
    first = np.cumsum(sizes) - sizes
    u = np.concatenate([u, np.zeros(2, np.uint64)])
    h = (u[:-2] * np.uint64(0x9E3779B97F4A7C15) + u[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + u[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(64 - CHAR_BITS)
    keep = np.ones(len(h), bool)
    keep[first + sizes - 1] = False
    if len(sizes):
        keep[(first + sizes - 2)[sizes > 2]] = False
    counts = np.add.reduceat(keep.astype(np.int64), first) if len(first) else first
    return own, h[keep].astype(np.int64), np.cumsum(counts) - counts


def _sum_rows(n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """n rows: the sums of values by the row that at names."""
    return np.stack([np.bincount(at, values[:, c], n) for c in range(values.shape[1])], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters p by name; forward and backward passes over windows of word inputs."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        e, h = 2 * EMBED, HIDDEN
        draw = lambda *s: (rng.normal(size=s) * 0.3).astype(np.float32)
        self.p = {"word": draw(1 << WORD_BITS, EMBED) * 0.3, "char": draw(1 << CHAR_BITS, EMBED) * 0.6}
        for d in "fb":
            self.p |= {f"wx{d}": draw(e, 3 * h), f"wh{d}": draw(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}
        self.p |= {"att": draw(2 * h), "out": draw(2 * h), "bias": np.zeros(1, np.float32)}

    def inputs(self, words: list[str], ids: tuple | None = None) -> np.ndarray:
        own, grams, first = ids or word_ids(words)
        if not len(words):
            return np.zeros((0, 2 * EMBED), np.float32)
        counts = np.diff(np.append(first, len(grams)))
        chars = np.add.reduceat(self.p["char"][grams], first, axis=0) / counts[:, None]
        return np.concatenate([self.p["word"][own], chars], axis=1).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What a word adds to the gates of both directions: (words, 2, 3 x hidden)."""
        return np.stack([x @ self.p["wxf"] + self.p["bf"], x @ self.p["wxb"] + self.p["bb"]], axis=1).astype(np.float32)

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. gates: (n, t, 2, 3h); mask: (n, t), False beyond the text. A masked step leaves the state."""
        n, t, _, _ = gates.shape
        h = HIDDEN
        states = np.zeros((2, t, n, h), np.float32)
        trace: list = [[None] * t, [None] * t]
        for d in (0, 1):
            s, wh = np.zeros((n, h), np.float32), self.p["whf" if d == 0 else "whb"]
            for k in range(t) if d == 0 else range(t - 1, -1, -1):
                g = gates[:, k, d]
                u = s @ wh
                zr = _sigmoid(g[:, :2 * h] + u[:, :2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(g[:, 2 * h:] + r * u[:, 2 * h:])
                m = mask[:, k, None]
                new = np.where(m, z * s + (1 - z) * c, s)
                if keep:
                    trace[d][k] = (s, u, z, r, c, m)
                s = states[d, k] = new
        both = np.concatenate([states[0], states[1]], axis=2)  # t, n, 2h
        a = np.where(mask.T, both @ self.p["att"], -1e9)
        a = np.exp(a - a.max(0))
        a = a * mask.T / np.maximum((a * mask.T).sum(0), 1e-9)
        pooled = (a[:, :, None] * both).sum(0)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (trace, both, a, pooled)) if keep else logit

    def backward(self, kept: tuple, mask: np.ndarray, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the recurrent part's parameters, and those of the gates' inputs."""
        trace, both, a, pooled = kept
        h, (t, n, _) = HIDDEN, both.shape
        g = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()])}
        dpool = dlogit[:, None] * self.p["out"]
        da = (both * dpool).sum(2)
        ds = a * (da - (a * da).sum(0))
        dboth = a[:, :, None] * dpool + ds[:, :, None] * self.p["att"]
        g["att"] = (ds[:, :, None] * both).sum((0, 1))
        dgates = np.zeros((n, t, 2, 3 * h), np.float32)
        for d in (0, 1):
            name = "whf" if d == 0 else "whb"
            wh, dwh, carry = self.p[name], np.zeros_like(self.p[name]), np.zeros((n, h), np.float32)
            for k in range(t - 1, -1, -1) if d == 0 else range(t):
                s, u, z, r, c, m = trace[d][k]
                dnew = carry + dboth[k, :, d * h:(d + 1) * h]
                live = dnew * m
                dc = live * (1 - z) * (1 - c * c)
                dz = live * (s - c) * z * (1 - z)
                dr = dc * u[:, 2 * h:] * r * (1 - r)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                dgates[:, k, d] = np.concatenate([dz, dr, dc], axis=1)
                dwh += s.T @ du
                carry = dnew * ~m + live * z + du @ wh.T
            g[name] = dwh
        return g, dgates


def windows_of(n: int) -> np.ndarray:
    """Starts of the windows of a text of n words: every STRIDE, the last reaching the end."""
    return np.arange(0, max(1, n - STRIDE), STRIDE) if n else np.zeros(0, np.int64)


def _batch(windows: list[np.ndarray]) -> tuple:
    """The distinct word numbers of windows, ascending, where each window has them, and where it has words."""
    flat = np.unique(np.concatenate(windows))
    idx = np.zeros((len(windows), WINDOW), np.int64)
    mask = np.arange(WINDOW) < np.array([len(x) for x in windows])[:, None]
    idx[mask] = np.searchsorted(flat, np.concatenate(windows))
    return flat, idx, mask


def _step(net: Network, names: list[str], windows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, moments: dict, rate: float) -> float:
    numbers, idx, mask = _batch(windows)
    flat = [names[k] for k in numbers.tolist()]
    own, grams, first = ids = word_ids(flat)
    x = net.inputs(flat, ids)
    logit, kept = net.forward(net.gates(x)[idx], mask, keep=True)
    p = _sigmoid(logit)
    g, dgates = net.backward(kept, mask, ((p - y) * weight / len(y)).astype(np.float32))
    per_word = _sum_rows(len(flat), idx[mask], dgates[mask].reshape(-1, 6 * HIDDEN)).reshape(-1, 2, 3 * HIDDEN)
    dx = np.zeros_like(x)
    for d, name in enumerate("fb"):
        g[f"wx{name}"], g[f"b{name}"] = x.T @ per_word[:, d], per_word[:, d].sum(0)
        dx += per_word[:, d] @ net.p[f"wx{name}"].T
    counts = np.diff(np.append(first, len(grams)))
    g["word"] = _sum_rows(1 << WORD_BITS, own, dx[:, :EMBED])
    g["char"] = _sum_rows(1 << CHAR_BITS, grams, np.repeat(dx[:, EMBED:] / counts[:, None], counts, axis=0))
    moments["t"] = moments.get("t", 0) + 1
    for k, grad in g.items():
        m, v = moments.setdefault(k, [np.zeros_like(net.p[k]), np.zeros_like(net.p[k])])
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        net.p[k] -= rate * (m / (1 - 0.9 ** moments["t"])) / (np.sqrt(v / (1 - 0.99 ** moments["t"])) + 1e-6)
    return float((-(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)) * weight).mean())


class Scorer:
    """Text scores of a trained network; remembers at most CACHED_WORDS words' gates."""

    def __init__(self, p: dict, slope: float, offset: float):
        self.net = Network()
        self.net.p, self.slope, self.offset = p, slope, offset
        self.known: dict[str, int] = {}
        self.table = self.net.gates(np.zeros((1, 2 * EMBED), np.float32))

    def _rows(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = list({w for w in words if w not in known})
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            self.table = self.table[:1]
            new = list(set(words))
        if new:
            base = len(self.table)
            made = [self.net.gates(self.net.inputs(new[i:i + 20_000])) for i in range(0, len(new), 20_000)]
            self.table = np.concatenate([self.table, *made])
            known.update(zip(new, range(base, base + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def logits(self, texts: list[str], every: bool = False):
        """The largest logit of each text's windows (of none: -inf); with every, also all windows' by text."""
        split = [words_of(t) for t in texts]
        rows = self._rows([w for s in split for w in s])
        begin = np.cumsum([0] + [len(s) for s in split])
        starts = [windows_of(len(s)) for s in split]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        at = np.concatenate([s + begin[i] for i, s in enumerate(starts)] + [np.zeros(0, np.int64)]).astype(np.int64)
        end = begin[owner + 1]
        out = np.zeros(len(at), np.float32)
        for i in range(0, len(at), 4096):
            idx = at[i:i + 4096, None] + np.arange(WINDOW)
            mask = idx < end[i:i + 4096, None]
            idx = np.where(mask, rows[np.minimum(idx, len(rows) - 1)], 0)
            out[i:i + 4096] = self.net.forward(self.table[idx], mask)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, out)
        return (best, owner, out) if every else best

    def scores(self, texts: list[str]) -> np.ndarray:
        return np.where(np.isfinite(b := self.logits(texts)), _sigmoid(self.slope * b + self.offset), 0.0)


def fit(texts: list[str], y: np.ndarray, rounds: int = 3, steps: int = 110, batch: int = 256, rate: float = 0.02, seed: int = 5) -> tuple[dict, float, float]:
    """Parameters, slope and offset. A fifth of the texts is kept from the network and sets slope and offset.
    Each round takes about steps batches, however few the texts."""
    rng = np.random.default_rng(seed)
    y = np.asarray(y)
    net = Network(seed)
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return net.p, 0.0, float(np.log(share / (1 - share)))
    known: dict[str, int] = {}  # words as numbers: a text takes four bytes a word
    split = [np.fromiter((known.setdefault(w, len(known)) for w in words_of(t)), np.int32) for t in texts]
    names = list(known)
    learn = rng.random(len(y)) > 0.2
    # where to look first: words whose share of toxic texts is largest
    forms: dict[str, int] = {}
    bare = np.array([forms.setdefault(w.lower().strip(_EDGE), len(forms)) for w in names], np.int64)
    seen = np.zeros((2, len(forms)))
    for i in np.flatnonzero(learn):
        seen[y[i], np.unique(bare[split[i]])] += 1
    n1, n0 = max(1, int(y[learn].sum())), max(1, int((1 - y[learn]).sum()))
    odds = np.where(seen[1] >= 3, np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1)), 0.0)
    first = [max(windows_of(len(s)), key=lambda a, v=odds[bare[s]]: v[a:a + WINDOW].max(initial=-9), default=0) for s in split]
    moments: dict = {}
    picks = {i: int(first[i]) for i in range(len(y)) if len(split[i])}
    for turn in range(rounds):
        if turn:
            scorer = Scorer(net.p, 1.0, 0.0)
            ids = [i for i in range(len(y)) if learn[i] and len(split[i])]
            for j in range(0, len(ids), 500):
                part = ids[j:j + 500]
                _, owner, out = scorer.logits([texts[i] for i in part], every=True)
                for k, i in enumerate(part):
                    own = out[owner == k]
                    picks[i] = int(windows_of(len(split[i]))[own.argmax()])
        windows, target = [], []
        for i, at in picks.items():
            if not learn[i]:
                continue
            windows.append(split[i][at:at + WINDOW])
            target.append(y[i])
            if not y[i]:
                for a in rng.choice(windows_of(len(split[i])), 2):
                    windows.append(split[i][a:a + WINDOW])
                    target.append(0)
        t = np.array(target, np.float32)
        weight = np.where(t == 1, 0.5 / max(t.mean(), 1e-3), 0.5 / max(1 - t.mean(), 1e-3)).astype(np.float32)
        for _ in range(max(1, round(steps / -(-len(t) // batch)))):
            order = rng.permutation(len(t))
            for j in range(0, len(order), batch):
                o = order[j:j + batch]
                _step(net, names, [windows[i] for i in o], t[o], weight[o], moments, rate)
    scorer = Scorer(net.p, 1.0, 0.0)
    rest = [i for i in range(len(y)) if not learn[i] and len(split[i])]
    if min((y[rest] == 0).sum(), (y[rest] == 1).sum()) < 8:  # too few left out to tell
        rest = [i for i in range(len(y)) if len(split[i])]
    m = np.concatenate([scorer.logits([texts[i] for i in rest[j:j + 500]]) for j in range(0, len(rest), 500)] or [np.zeros(0)])
    n1, n0 = int((y[rest] == 1).sum()), int((y[rest] == 0).sum())
    t, slope, offset = np.where(y[rest] == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), 0.5, 0.0
    for _ in range(300):
        p = _sigmoid(slope * m + offset)
        r = p * (1 - p)
        g = np.array([((p - t) * m).mean() + 1e-3 * slope if len(t) else 0, (p - t).mean() if len(t) else 0])
        hess = np.array([[(r * m * m).mean() + 1e-3, (r * m).mean()], [(r * m).mean(), r.mean() + 1e-4]]) if len(t) else np.eye(2)
        d = np.clip(np.linalg.solve(hess, g), -1, 1)
        slope, offset = slope - d[0], offset - d[1]
        if np.abs(d).max() < 1e-7:
            break
    return net.p, float(slope), float(offset)


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_chars: int = 25_000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted (1 from 0.5 on).

    Learns from at most max_docs labelled texts, one an id, drawn by a hash of the id from all with crc32(id) mod 5 not 0 and
    max_chars characters at most: what the driver learns from is at most the product of both. Every text is scored whole, whatever its
    length. A null text or one without a word has no window: score 0. Without usable labels, or with labels of one class only, every text
    with words gets the smoothed share of toxic ones. Conflicting labels of a document count as toxic. Repeated rows give a row each, an
    empty table an empty result. Other columns are not used."""
    drawn = labelled(docs, labels, "toxic", 5, max_docs, max_chars).toPandas()  # at most max_docs x max_chars
    hold = docs.sparkSession.sparkContext.broadcast(fit(drawn["text"].tolist(), drawn["y"].to_numpy()))
    own: list[Scorer] = []

    def run(texts: list[str]) -> dict:
        if not own:
            own.append(Scorer(*hold.value))
        return {"score": own[0].scores(texts)}

    scored = map_texts(docs, ["doc_id"], run, "doc_id " + dict(docs.dtypes)["doc_id"] + ", score double")
    return scored.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
