"""A small causal self-attention model over subword ids, trained and run in numpy.

Position t sees the ids up to t and predicts the next one. One attention head with a
learned bias per distance; the output is a two-step softmax (class of the id, then the
id in its class). Since keys, queries and values depend on the id alone, they are tables
that are looked up. Texts are cut into windows of ``STRIDE`` scored positions with the
``STRIDE`` positions before them as context, so windows overlap and every id is scored
exactly once; windows of many texts are batched, with a mask for what lies outside.
"""

from __future__ import annotations

import numpy as np

STRIDE = 16
SPAN = 2 * STRIDE
_MASKED = np.float32(-1e9)


def windows(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of positions, valid keys, valid queries) of texts laid end to end in ``ids``.

    A text of n positions starting at s has ceil(n / STRIDE) windows of SPAN positions."""
    count = -(-lengths // STRIDE)
    text = np.repeat(np.arange(len(lengths)), count)
    first = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    rel = first[:, None] * STRIDE + np.arange(-STRIDE, STRIDE)
    ok = (rel >= 0) & (rel < lengths[text][:, None])
    place = np.where(ok, rel + starts[text][:, None], 0)
    return place, ok, ok[:, STRIDE:]


def causal_mask() -> np.ndarray:
    """0 where query i (position STRIDE + i of the window) may see key j, else a large negative."""
    i, j = np.arange(STRIDE)[:, None] + STRIDE, np.arange(SPAN)[None]
    return np.where(j <= i, np.float32(0), _MASKED)


def _sums(n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of ``values`` summed by ``at`` into ``n`` rows (``np.add.at``, but by a sort)."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(at):
        order = np.argsort(at.astype(np.uint16) if n <= 2**16 else at, kind="stable")
        key = at.take(order)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        rows = values.take(order, axis=0)
        if values.shape[1] % 2 == 0:  # two numbers in one addition
            rows = rows.view(np.result_type(values.dtype, np.complex64))
        out[key.take(first)] = np.add.reduceat(rows, first, axis=0).view(values.dtype)
    return out


_DISTANCE = np.clip(np.arange(STRIDE)[:, None] + STRIDE - np.arange(SPAN)[None], 0, SPAN - 1)
_SEEN = (causal_mask() == 0).astype(np.float32)
_SMALL = 40  # exp of what is no farther from 0 needs no shift


def _small(z: np.ndarray) -> bool:
    return bool(z.min(initial=0) > -_SMALL and z.max(initial=0) < _SMALL)


def _row_sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[-1], z.dtype)


class Attention:
    """Parameters by name; ids 0 .. classes * width - 1 (class = id // width)."""

    def __init__(self, classes: int, width: int, dim: int = 16, hidden: int = 24, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.classes, self.width, self.dim = classes, width, dim
        self.p = {
            "emb": draw(classes * width, dim, scale=0.3), "wq": draw(dim, dim, scale=0.2), "wk": draw(dim, dim, scale=0.2),
            "wv": draw(dim, dim, scale=0.25), "near": np.zeros(SPAN, np.float32),
            "wh": draw(2 * dim, hidden, scale=0.25), "bh": np.zeros(hidden, np.float32),
            "w1": draw(hidden, classes, scale=0.1), "b1": np.zeros(classes, np.float32),
            "w2": draw(classes, hidden, width, scale=0.1), "b2": np.zeros((classes, width), np.float32),
        }

    def _attend(self, tables, x: np.ndarray, ok: np.ndarray):
        """Attention of the window rows ``x`` (B, SPAN): weights not yet divided by their sums, the
        sums, queries, keys, values and mixed values."""
        q, k, v, near = tables
        query, keys, values = q.take(x[:, STRIDE:], axis=0), k.take(x, axis=0), v.take(x, axis=0)
        w = np.matmul(query, keys.transpose(0, 2, 1))
        w += near
        if not _small(w):
            w += causal_mask()
            w += np.where(ok, np.float32(0), _MASKED)[:, None, :]
            w -= w.max(2, keepdims=True)
        np.exp(w, out=w)
        w *= _SEEN
        if not ok.all():
            w *= ok.astype(np.float32)[:, None, :]
        total = _row_sums(w)[:, :, None]
        mixed = np.matmul(w, values)
        mixed /= total
        return w, total, query, keys, values, mixed

    def tables(self):
        p = self.p
        scale = np.float32(1 / np.sqrt(self.dim))
        return p["emb"] @ p["wq"] * scale, p["emb"] @ p["wk"], p["emb"] @ p["wv"], p["near"][_DISTANCE]

    def _by_class(self, goal: np.ndarray):
        """The order of targets by class, where the classes begin in it, and the targets' classes and
        places in them in that order."""
        cls = goal // self.width
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        cls = cls.take(order)
        return order, np.searchsorted(cls, np.arange(self.classes + 1)).tolist(), cls, goal.take(order) % self.width

    def _by_both_steps(self) -> np.ndarray:
        """For each class the weights of both steps of the output side by side; the last row is the bias."""
        p, hidden, n = self.p, len(self.p["w1"]), self.classes
        out = np.empty((n, hidden + 1, n + self.width), p["w2"].dtype)
        out[:, :hidden, :n], out[:, :hidden, n:] = p["w1"], p["w2"]
        out[:, hidden, :n], out[:, hidden, n:] = p["b1"], p["b2"]
        return out

    def _output(self, weights: np.ndarray, before: np.ndarray, ends: list[int], cls: np.ndarray, inner: np.ndarray):
        """From the hidden layer's input, rows in order of class: the layer with a column of ones, exp of
        the numbers of every class and of every id in the class, the sums of either, and minus the log
        probability of each row's target."""
        h = np.ones((len(before), before.shape[1] + 1), before.dtype)
        h[:, :-1] = np.tanh(before, out=before)
        z = np.empty((len(h), weights.shape[2]), h.dtype)
        for c, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            if b > a:
                np.matmul(h[a:b], weights[c], out=z[a:b])
        at = np.arange(len(z)) * z.shape[1]
        steps = np.zeros((z.shape[1], 2), z.dtype)  # which numbers belong to which step
        steps[:self.classes, 0] = steps[self.classes:, 1] = 1
        if not _small(z):
            for part in (z[:, :self.classes], z[:, self.classes:]):
                part -= part.max(1, keepdims=True)
        picked = z.ravel().take(at + cls) + z.ravel().take(at + self.classes + inner)
        np.exp(z, out=z)
        sums = z @ steps
        return h, z, sums, np.log(sums).sum(1) - picked

    def log_probs(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, targets: np.ndarray,
                  block: int = 256) -> np.ndarray:
        """Natural log probability of ``targets[t]`` after the ids up to t of the same text."""
        out = np.zeros(len(ids), np.float32)
        place, ok, scored = windows(ids, starts, lengths)
        tables, p, d = self.tables(), self.p, self.dim
        direct, weights = p["emb"] @ p["wh"][:d] + p["bh"], self._by_both_steps()
        for at in range(0, len(place), block):
            rows = place[at:at + block]
            x = ids.take(rows)
            mixed = self._attend(tables, x, ok[at:at + block])[-1]
            query = np.flatnonzero(scored[at:at + block])
            where = rows[:, STRIDE:].ravel().take(query)
            order, ends, cls, inner = self._by_class(targets.take(where))
            query, where = query.take(order), where.take(order)
            h = mixed.reshape(-1, d).take(query, axis=0) @ p["wh"][d:]
            h += direct.take(x[:, STRIDE:].ravel().take(query), axis=0)
            out[where] = -self._output(weights, h, ends, cls, inner)[-1]
        return out

    def _gradients(self, x: np.ndarray, ok: np.ndarray, scored: np.ndarray, goal: np.ndarray):
        """Mean negative log likelihood of a batch of windows, and its gradients.

        What follows the attention runs over the scored queries in order of their targets' class."""
        p, d = self.p, self.dim
        kind = p["emb"].dtype.type
        w, total, query, keys, values, mixed = self._attend(self.tables(), x, ok)
        order, ends, cls, inner = self._by_class(goal)
        at = np.flatnonzero(scored).take(order)
        both = np.empty((len(at), 2 * d), kind)
        both[:, :d] = p["emb"].take(x[:, STRIDE:].ravel().take(at), axis=0)
        both[:, d:] = mixed.reshape(-1, d).take(at, axis=0)
        before = both @ p["wh"]
        before += p["bh"]
        weights = self._by_both_steps()
        h, z, sums, loss = self._output(weights, before, ends, cls, inner)
        n, classes, line = kind(len(goal)), self.classes, np.arange(len(goal)) * z.shape[1]
        share = 1 / (n * sums)
        z[:, :classes] *= share[:, :1]
        z[:, classes:] *= share[:, 1:]
        flat = z.ravel()
        flat[line + cls] -= 1 / n
        flat[line + classes + inner] -= 1 / n
        gw, dz = np.zeros_like(weights), np.empty_like(h)
        for c, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            if b > a:
                np.matmul(h[a:b].T, z[a:b], out=gw[c])
                np.matmul(z[a:b], weights[c].T, out=dz[a:b])
        first = gw[:, :, :classes].sum(0)
        g = {"w1": first[:-1], "b1": first[-1], "w2": gw[:, :-1, classes:], "b2": gw[:, -1, classes:]}
        np.multiply(before, before, out=before)
        np.subtract(1, before, out=before)
        before *= dz[:, :-1]
        dz = before
        g["wh"], g["bh"] = both.T @ dz, np.ones(len(dz), kind) @ dz
        dboth = dz @ p["wh"].T
        dmixed = np.zeros((scored.size, d), kind)
        dmixed[at] = dboth[:, d:]
        dmixed = dmixed.reshape(mixed.shape)
        dmixed /= total  # since the weights are not divided by their sums
        ds = np.matmul(dmixed, values.transpose(0, 2, 1))
        ds -= _row_sums(dmixed * mixed)[:, :, None]
        ds *= w
        g["near"] = np.bincount(_DISTANCE.ravel(), np.ones(len(ds), kind) @ ds.reshape(len(ds), -1), SPAN).astype(kind)
        # gradients of keys and values, then of the scored ids and of queries, summed by id at once
        ids, keyed = len(p["emb"]), x.size
        parts = np.zeros((keyed + scored.size, 2 * d), kind)
        parts[:keyed, :d] = np.matmul(ds.transpose(0, 2, 1), query).reshape(-1, d)
        parts[:keyed, d:] = np.matmul(w.transpose(0, 2, 1), dmixed).reshape(-1, d)
        parts[keyed + at, :d] = dboth[:, :d]
        parts[keyed:, d:] = np.matmul(ds, keys).reshape(-1, d)
        sums = _sums(2 * ids, np.concatenate([x.ravel(), x[:, STRIDE:].ravel() + ids]), parts)
        demb = sums[ids:, :d]
        for name, part in (("wq", sums[ids:, d:] * kind(1 / np.sqrt(d))), ("wk", sums[:ids, :d]), ("wv", sums[:ids, d:])):
            g[name] = p["emb"].T @ part
            demb = demb + part @ p[name].T
        g["emb"] = demb
        return float(loss.sum() / n), g

    def start(self) -> np.ndarray:
        """State of training, one flat row each: weights, first and second moments."""
        flat = np.concatenate([v.ravel() for v in self.p.values()]).astype(np.float64)
        return np.stack([flat, np.zeros_like(flat), np.zeros_like(flat)])

    def load(self, state: np.ndarray) -> None:
        """Take the weights of a state."""
        self._view(state[0].astype(np.float32))

    def _view(self, flat: np.ndarray) -> None:
        """Let the weights be views of one flat row."""
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at:at + v.size].reshape(v.shape)
            at += v.size

    def train(self, state: np.ndarray, done: float, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
              targets: np.ndarray, rate: float = 0.01, batch: int = 192, seed: int = 2) -> int:
        """Adam over the shuffled windows of texts, once, from a state after ``done`` steps; the
        state is changed in place. A batch below ``batch`` windows steps less. Returns the steps made."""
        place, ok, scored = windows(ids, starts, lengths)
        if not len(place):
            return 0
        parts = np.array_split(np.random.default_rng(seed).permutation(len(place)), max(1, -(-len(place) // batch)))
        weights, first, second = state
        for t, rows in enumerate(parts, 1):
            self.load(state)
            s, own = scored.take(rows, axis=0), place.take(rows, axis=0)
            _, g = self._gradients(ids.take(own), ok.take(rows, axis=0), s, targets.take(own[:, STRIDE:][s]))
            g = np.concatenate([g[k].ravel() for k in self.p])
            change = g - first
            change *= 0.1
            first += change
            change = g * g - second
            change *= 0.02
            second += change
            np.divide(second, 1 - 0.98**(done + t), out=change)
            np.sqrt(change, out=change)
            change += 1e-8
            np.divide(first, change, out=change)
            change *= rate * min(1.0, len(rows) / batch) / (1 - 0.9**(done + t))
            weights -= change
        self.load(state)
        return len(parts)
