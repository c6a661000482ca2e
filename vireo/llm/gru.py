"""A small gated recurrent language model in NumPy.

Output is factored by classes: P(word | state) = P(class | state) P(word | class, state).
The most frequent words have input and output vectors of their own and stand in
classes by frequency; all other words stand in classes by their ending, share
their class's input vector, and divide its probability by their counts. The end
of a text is a class by itself. Training is truncated backpropagation through
time with Adam; the state is carried from window to window of a text and starts
at zero with each text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN = 32
WORDS = 2000
CLASS_WORDS = 50
ENDINGS = 128
WINDOW = 32
STREAMS = 48
EPOCHS = 1
RATE = 0.01
#: Rows of a softmax and numbers of an update that are worked on at once; results don't depend on it.
ROWS, CELLS = 2048, 1 << 14
#: Share of the recurrent model in the final mixture with the unigram base.
MIX = 0.95


@dataclass
class Shape:
    """Ids: words 0 .. words-1, then ENDINGS ending classes, then end; start is the last input."""

    words: int
    size: int = CLASS_WORDS

    @property
    def word_classes(self) -> int:
        return -(-self.words // self.size)

    @property
    def end(self) -> int:
        return self.words + ENDINGS

    @property
    def start(self) -> int:
        return self.end + 1

    @property
    def classes(self) -> int:
        return self.word_classes + ENDINGS + 1

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.words, ids // self.size, ids - self.words + self.word_classes)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In the place of ``x``."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # to infinity, whose reciprocal is 0
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log of the softmax of each row at ``at``, sums of rows); ``x`` is left as exponentials that sum to these."""
    x -= x.max(axis=1, keepdims=True)
    picked = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    sums = x @ np.ones(x.shape[1], dtype=x.dtype)
    return picked - np.log(sums), sums


class Model:
    def __init__(self, shape: Shape, counts: np.ndarray, hidden: int = HIDDEN, seed: int = 1):
        """``counts``: corpus counts of all ids but start (words, ending classes, end)."""
        rng = np.random.default_rng(seed)
        f = np.float32
        self.shape, self.hidden = shape, hidden
        c = shape.classes
        per_class = np.bincount(shape.class_of(np.arange(shape.end + 1)), weights=counts + 1.0, minlength=c)
        padded = np.full(shape.word_classes * shape.size, -1e4)
        padded[: shape.words] = np.log(counts[: shape.words] + 1.0)
        self.p = {
            "E": (rng.normal(size=(shape.start + 1, 3 * hidden)) * 0.1).astype(f),
            "U": (rng.normal(size=(hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f),
            "Wc": (rng.normal(size=(hidden, c)) * 0.05).astype(f),
            "bc": np.log(per_class / per_class.sum()).astype(f),
            "Ww": (rng.normal(size=(shape.word_classes, hidden, shape.size)) * 0.05).astype(f),
            "bw": padded.reshape(shape.word_classes, shape.size).astype(f),
        }

    def flat(self) -> np.ndarray:
        """All parameters in one row."""
        return np.concatenate([v.ravel() for v in self.p.values()])

    def add(self, change: np.ndarray) -> None:
        at = 0
        for v in self.p.values():
            v += change[at : at + v.size].reshape(v.shape)
            at += v.size

    def copy(self) -> Model:
        other = object.__new__(Model)
        other.shape, other.hidden, other.p = self.shape, self.hidden, {k: v.copy() for k, v in self.p.items()}
        return other

    def gates(self) -> np.ndarray:
        """U as three matrices, so that what is made of it is whole for each gate."""
        return np.ascontiguousarray(self.p["U"].reshape(self.hidden, 3, self.hidden).transpose(1, 0, 2))

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Input vectors of ids, by gate."""
        return np.ascontiguousarray(np.moveaxis(self.p["E"][x.ravel()].reshape(*x.shape, 3, self.hidden), -2, 0))

    @staticmethod
    def step(e: np.ndarray, u: np.ndarray, h: np.ndarray, out: np.ndarray) -> np.ndarray:
        """One recurrent step to ``out`` from states ``h``, for input vectors ``e`` by gate, which become the gates, and ``u``, h times ``gates``."""
        zr, n = e[:2], e[2]
        zr += u[:2]
        _sigmoid(zr)
        n += np.multiply(zr[1], u[2], out=out)
        np.tanh(n, out=n)
        np.subtract(h, n, out=out)
        out *= zr[0]
        out += n
        return out

    def log_probs(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log of P(class | h), times P(word | class, h) for ids with vectors of their own."""
        out = np.empty(len(ids), dtype=np.float64)
        for k in range(0, len(ids), ROWS):
            out[k : k + ROWS] = self._log_probs(h[k : k + ROWS], ids[k : k + ROWS])
        return out

    def _log_probs(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        cls = self.shape.class_of(ids)
        logits = h @ self.p["Wc"]
        logits += self.p["bc"]
        out = _softmax(logits, cls)[0].astype(np.float64)
        own, edge = self._by_class(ids, cls)
        if len(own):
            w = self._word_logits(h[own], cls[own], edge)
            out[own] += _softmax(w, ids[own] - cls[own] * self.shape.size)[0]
        return out

    def _by_class(self, ids: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """(places of the ids with vectors of their own, sorted by class; (class, from, to) of those)."""
        own = np.flatnonzero(ids < self.shape.words)
        own = own[np.argsort(cls[own], kind="stable")]
        edge = np.searchsorted(cls[own], np.arange(self.shape.word_classes + 1)).tolist()
        return own, [(k, i, j) for k, (i, j) in enumerate(zip(edge, edge[1:])) if i < j]

    def _word_logits(self, h: np.ndarray, cls: np.ndarray, edge: list[tuple[int, int, int]]) -> np.ndarray:
        """Within their classes, of rows sorted by class."""
        w, made = self.p["bw"][cls], np.empty((len(h), self.shape.size), dtype=h.dtype)
        for k, i, j in edge:
            np.matmul(h[i:j], self.p["Ww"][k], out=made[i:j])
        w += made
        return w

    def train(self, texts: list[np.ndarray], epochs: int = EPOCHS, streams: int = STREAMS, window: int = WINDOW, rate: float = RATE, seed: int = 2) -> list[float]:
        """Fit to id sequences (each ends with ``end``); returns the mean loss per window batch."""
        rng = np.random.default_rng(seed)
        flat = self.flat()
        self.p = self._views(flat)
        grad, spare, *moment = (np.zeros_like(flat) for _ in range(4))
        grads = self._views(grad)
        losses, turn = [], 0
        total_steps = max(1, epochs * sum(len(t) for t in texts) // (streams * window))
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            lanes: list[list[np.ndarray]] = [[] for _ in range(streams)]
            filled = np.zeros(streams)
            for i in order:
                k = int(filled.argmin())
                lanes[k].append(texts[i])
                filled[k] += len(texts[i])
            length = int(filled.max()) if len(texts) else 0
            target = np.full((length, streams), -1, dtype=np.int64)
            source = np.full((length, streams), self.shape.start, dtype=np.int64)
            fresh = np.zeros((length, streams), dtype=bool)
            for k, lane in enumerate(lanes):
                at = 0
                for t in lane:
                    target[at : at + len(t), k] = t
                    source[at + 1 : at + len(t), k] = t[:-1]
                    fresh[at, k] = True
                    at += len(t)
            h = np.zeros((streams, self.hidden), dtype=np.float32)
            for first in range(0, length, window):
                turn += 1
                part = slice(first, first + window)
                loss, _, h = self._window(source[part], target[part], fresh[part], h, grads)
                losses.append(loss)
                lr = rate * (1.0 - 0.9 * min(1.0, turn / total_steps))
                by, root = lr / (1 - 0.9**turn), (1 - 0.99**turn) ** -0.5
                for k in range(0, len(flat), CELLS):  # so many at a time stay in the processor's cache
                    g, m, v, t = (x[k : k + CELLS] for x in (grad, *moment, spare))
                    np.minimum(g, 1.0, out=g)
                    np.maximum(g, -1.0, out=g)
                    m *= 0.9
                    m += np.multiply(g, 0.1, out=t)
                    v *= 0.99
                    g *= g
                    g *= 0.01
                    v += g
                    np.sqrt(v, out=t)
                    t *= root
                    t += 1e-6
                    np.divide(m, t, out=t)
                    t *= by
                    flat[k : k + CELLS] -= t
        return losses

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parts of ``flat``, which is in the order of ``Model.flat``, in the parameters' shapes."""
        ends = np.cumsum([v.size for v in self.p.values()])
        return {k: x.reshape(self.p[k].shape) for k, x in zip(self.p, np.split(flat, ends[:-1]), strict=True)}

    def _window(self, source: np.ndarray, target: np.ndarray, fresh: np.ndarray, h: np.ndarray, grads: dict[str, np.ndarray] | None = None):
        """(loss, gradients, last states) of a window; the gradients are put in ``grads`` where it is given."""
        d, p, f = self.hidden, self.p, self.p["U"].dtype
        steps, streams = source.shape
        begins = fresh.any(axis=1).tolist()
        gates, by_gate = self.inputs(source), self.gates()
        before, after = (np.empty((steps, streams, d), dtype=f) for _ in range(2))
        inner = np.empty_like(gates)  # h U first, what goes back through U later
        for t in range(steps):
            before[t] = h
            if begins[t]:
                before[t][fresh[t]] = 0
            np.matmul(before[t], by_gate, out=inner[:, t])
            h = self.step(gates[:, t], inner[:, t], before[t], after[t])
        states, ids = after.reshape(-1, d), target.ravel()
        live = np.flatnonzero(ids >= 0)
        grads = grads or self._views(np.empty(sum(v.size for v in p.values()), dtype=f))
        for g in grads.values():
            g[...] = 0
        back = np.zeros_like(states)
        n = max(1, len(live))
        hs, own = states[live], ids[live]
        cls = self.shape.class_of(own)
        y = hs @ p["Wc"]
        y += p["bc"]
        logs, sums = _softmax(y, cls)
        loss = -logs.sum()
        y *= (1 / (sums * n))[:, None]
        y[np.arange(len(own)), cls] -= 1 / n
        np.matmul(hs.T, y, out=grads["Wc"])
        np.sum(y, axis=0, out=grads["bc"])
        dh = y @ p["Wc"].T
        at, edge = self._by_class(own, cls)
        if len(at):
            rows, kinds = hs[at], cls[at]
            w = self._word_logits(rows, kinds, edge)
            place = own[at] - kinds * self.shape.size
            logs, sums = _softmax(w, place)
            loss -= logs.sum()
            w *= (1 / (sums * n))[:, None]
            w[np.arange(len(at)), place] -= 1 / n
            more = np.empty_like(rows)
            for k, i, j in edge:
                np.matmul(rows[i:j].T, w[i:j], out=grads["Ww"][k])
                np.matmul(w[i:j], p["Ww"][k].T, out=more[i:j])
            grads["bw"][[k for k, _, _ in edge]] = np.add.reduceat(w, [i for _, i, _ in edge], axis=0)
            dh[at] += more
        back[live] = dh
        back = back.reshape(steps, streams, d)
        z, r, cand = gates
        rest = 1 - z
        by_z, by_n, by_r = (before - cand) * z * rest, rest * (1 - cand * cand), inner[2] * r * (1 - r)
        across = np.ascontiguousarray(by_gate.transpose(0, 2, 1))
        carry, spare = np.zeros_like(h), np.empty((3, streams, d), dtype=f)
        outers = np.empty_like(gates)
        for t in range(steps - 1, -1, -1):
            g, o, i = back[t], outers[:, t], inner[:, t]
            g += carry
            np.multiply(g, by_z[t], out=o[0])
            np.multiply(g, by_n[t], out=o[2])
            np.multiply(o[2], by_r[t], out=o[1])
            i[:2] = o[:2]
            np.multiply(o[2], r[t], out=i[2])
            np.matmul(i, across, out=spare)
            np.multiply(g, z[t], out=carry)
            for x in spare:
                carry += x
            if begins[t]:
                carry[fresh[t]] = 0
        grads["U"][...] = np.moveaxis(before.reshape(-1, d).T @ inner.reshape(3, -1, d), 0, 1).reshape(d, 3 * d)
        seats = np.arange(3 * d).reshape(3, 1, d) + source.reshape(1, -1, 1) * (3 * d)
        np.add.at(grads["E"].reshape(-1), seats.ravel(), outers.ravel())
        return float(loss / n), grads, h.copy()

    def score(self, ids: np.ndarray, bounds: np.ndarray, group: int = 2048, window: int = 64, cells: int = 1 << 16):
        """log_probs of all tokens of many texts, the state carried through each whole text.

        ``ids[bounds[i] : bounds[i+1]]`` is text i. Texts of like length go in
        lockstep; a window ends after ``window`` steps or ``cells`` tokens.
        """
        out = np.empty(len(ids), dtype=np.float64)
        lengths = np.diff(bounds)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        for first in range(0, len(order), group):
            docs = order[first : first + group]
            starts, longest = bounds[docs], lengths[docs]
            h, by_gate = np.zeros((len(docs), self.hidden), dtype=np.float32), self.gates()
            x = np.full(len(docs), self.shape.start)
            states, places, held = [], [], 0
            for t in range(int(longest[0])):
                live = int(np.searchsorted(-longest, -t, side="left"))
                h = h[:live]
                h = self.step(self.inputs(x[:live]), h @ by_gate, h, np.empty_like(h))
                place = starts[:live] + t
                x = ids[place]
                states.append(h)
                places.append(place)
                held += live
                if len(states) == window or held >= cells:
                    at = np.concatenate(places)
                    out[at] = self.log_probs(np.concatenate(states), ids[at])
                    states, places, held = [], [], 0
            if states:
                at = np.concatenate(places)
                out[at] = self.log_probs(np.concatenate(states), ids[at])
        return out
