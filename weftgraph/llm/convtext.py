"""A convolutional text classifier in numpy: embeddings, filters of several widths, max pooling over time, softmax.

Inputs are windows: integer arrays (fields, windows, length); the embeddings of a position's fields add up. The last
symbol of every field is padding. A window's pooled features are the maxima over its positions; texts of many windows
pool over them (``pool``). Gradients only touch the positions that won the maximum, so training is cheap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.common import slices

#: Rows of a shard that are put in a new order each round, and parameters in one message.
MIXED, PART = 2048, 1 << 15
#: Positions that one matrix product covers; bounds temporary memory at a few MB.
BLOCK = 1 << 16


class ConvText:
    def __init__(self, symbols: list[int], dim: int, widths: tuple[int, ...], filters: int, classes: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.span, self.dim, channels = max(widths), dim, filters * len(widths)
        self.tables = [np.vstack([r.normal(0, 0.3, (n, dim)), np.zeros((1, dim))]).astype(np.float32) for n in symbols]
        self.mask = np.zeros((channels, self.span, dim), np.float32)
        for i, w in enumerate(widths):
            self.mask[i * filters : (i + 1) * filters, :w] = 1
        self.kernel = (r.normal(0, 1, self.mask.shape) * self.mask / np.sqrt(self.mask.sum((1, 2), keepdims=True))).astype(np.float32)
        self.bias = np.zeros(channels, np.float32)
        self.out = (r.normal(0, 1, (channels, classes)) / np.sqrt(channels)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def features(self, ids: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maxima over positions (windows, channels), and the winning positions if asked for."""
        _, n, length = ids.shape
        step, room = max(1, BLOCK // length), length - self.span + 1
        flat = self.kernel.reshape(len(self.kernel), -1)
        best, at = np.empty((n, len(flat)), np.float32), np.empty((n, len(flat)), np.int32) if where else None
        columns = [np.ascontiguousarray(t.T) for t in self.tables]
        for lo in range(0, n, step):
            block = ids[:, lo : lo + step].reshape(len(ids), -1)
            m = block.shape[1]
            x = columns[0].take(block[0], axis=1)
            for t, row in zip(columns[1:], block[1:], strict=True):
                x += t.take(row, axis=1)
            stack = np.zeros((self.span * self.dim, m), np.float32)
            for k in range(self.span):
                stack[k * self.dim : (k + 1) * self.dim, : m - k] = x[:, k:]
            y = (flat @ stack).reshape(len(flat), -1, length)[:, :, :room]
            best[lo : lo + step] = y.max(axis=2).T
            if where:
                at[lo : lo + step] = y.argmax(axis=2).T
        return best + self.bias, at

    @staticmethod
    def pool(best: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Maxima over each text's windows; ``first`` holds each text's first window."""
        return np.maximum.reduceat(best, first, axis=0)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.out_bias

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = self.logits(pooled)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def train(self, ids: np.ndarray, first: np.ndarray, labels: np.ndarray, weights: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 11, decay: float = 0.0) -> None:
        """Adam on weighted cross-entropy. Text i has the windows first[i] to first[i + 1]."""
        r, ends, adam = np.random.default_rng(seed), np.append(first[1:], ids.shape[1]), Adam(self, rate, decay)
        for _ in range(epochs):
            order = r.permutation(len(first))
            for lo in range(0, len(order), batch):
                chosen = order[lo : lo + batch]
                windows = np.concatenate([np.arange(first[i], ends[i]) for i in chosen])
                starts = np.cumsum([0, *(ends[chosen] - first[chosen])[:-1]])
                adam.step(ids[:, windows], starts, labels[chosen], weights[chosen])

    def params(self) -> list[np.ndarray]:
        return [*self.tables, self.kernel, self.bias, self.out, self.out_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.params():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def _gradients(self, ids: np.ndarray, starts: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        best, at = self.features(ids, where=True)
        pooled = self.pool(best, starts)
        n, channels = pooled.shape
        owner = np.repeat(np.arange(n), np.diff(np.append(starts, len(best))))
        # The first window that reaches a text's maximum, by channel.
        reach = best >= pooled[owner]
        window = np.full((n, channels), len(best))
        rows, cols = np.nonzero(reach)
        np.minimum.at(window, (owner[rows], cols), rows)
        hidden = np.maximum(pooled, 0)
        d = self.probabilities(pooled)
        d[np.arange(n), labels] -= 1
        d *= weights[:, None] / n
        d_hidden = (d @ self.out.T) * (pooled > 0)
        position = at[window, np.arange(channels)]
        patch = ids[:, window[:, :, None], position[:, :, None] + np.arange(self.span)]
        x = sum(t[p] for t, p in zip(self.tables, patch, strict=True))
        d_kernel = np.einsum("nc,ncsd->csd", d_hidden, x, optimize=True).astype(np.float32) * self.mask
        d_x = d_hidden[:, :, None, None] * self.kernel[None]
        d_tables = []
        for t, p in zip(self.tables, patch, strict=True):
            g = np.zeros_like(t)
            np.add.at(g, p.ravel(), d_x.reshape(-1, self.dim))
            g[-1] = 0
            d_tables.append(g)
        return [*d_tables, d_kernel, d_hidden.sum(0), hidden.T @ d, d.sum(0)]


class Adam:
    """Steps of one network, changed in place."""

    def __init__(self, net: ConvText, rate: float, decay: float = 0.0):
        self.net, self.rate, self.decay, self.t = net, rate, decay, 0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params()]

    def step(self, ids: np.ndarray, starts: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        self.t += 1
        grads = self.net._gradients(ids, starts, labels, weights)
        for p, g, (m, v) in zip(self.net.params(), grads, self.moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-7) + self.decay * p)
        self.net.kernel *= self.net.mask


def train_rounds(net: ConvText, rows: DataFrame, read: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], rounds: int, batch: int = 64, rate: float = 0.01) -> None:
    """Trains on every row of a table, however large: in each round every shard (first column; its rows lie side by side) goes
    through its rows from the common parameters, and each parameter moves by the mean over the shards that changed it.

    ``read`` gives windows, first windows, labels and weights of some rows. A task holds the network and ``MIXED`` rows; the
    driver gets one set of parameters a round, summed in tasks.
    """
    for k in range(rounds):
        start, own = net.flat(), rate * (1 - k / (2 * rounds))

        def run(batches: Iterator[pa.RecordBatch], start=start, own=own, k=k) -> Iterator[pa.RecordBatch]:
            mixed, shard, adam = np.random.default_rng(k), None, None

            def moved() -> pa.RecordBatch:
                delta = net.flat() - start
                cuts = range(0, len(delta), PART)
                return pa.record_batch({"part": pa.array([c // PART for c in cuts], pa.int32()), "delta": pa.array([delta[c : c + PART].tobytes() for c in cuts], pa.binary())})

            for rows in slices(batches, MIXED):
                of = np.asarray(rows.column(0))
                for piece in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
                    if of[piece[0]] != shard:
                        if shard is not None:
                            yield moved()
                        shard = of[piece[0]]
                        net.load(start)
                        adam = Adam(net, own)
                    order = mixed.permutation(piece)
                    for lo in range(0, len(order), batch):
                        adam.step(*read(rows.take(pa.array(order[lo : lo + batch]))))
            if shard is not None:
                yield moved()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list[np.ndarray]] = {}
            for rows in batches:
                for part, delta in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    d = np.frombuffer(delta, np.float32)
                    held = total.setdefault(part, [np.zeros(len(d)), np.zeros(len(d), np.int64)])
                    held[0] += d
                    held[1] += d != 0
            for part, (d, n) in total.items():
                yield pa.record_batch({"part": pa.array([part], pa.int32()), "delta": pa.array([(d / np.maximum(n, 1)).astype(np.float32).tobytes()], pa.binary())})

        shifted = rows.mapInArrow(run, "part int, delta binary").repartition(8, "part").mapInArrow(add, "part int, delta binary")
        found = {r.part: r.delta for r in shifted.collect()}  # as many bytes as the network has
        net.load(start + np.concatenate([np.frombuffer(found[part], np.float32) for part in sorted(found)]) if found else start)
