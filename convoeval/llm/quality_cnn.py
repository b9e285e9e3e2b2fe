"""Quality classifier: a byte-level convolutional network.

Every byte has, for each place in a filter, a learned weight per filter. A filter's responses
are averaged over overlapping chunks that cover the whole document, the largest average of
each filter is kept, and a small dense layer combines these into one probability. Training
sees a bounded sample of labelled documents on the driver; scoring is one narrow stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoeval.llm.shared import held_out, labelled_sample, tidy


@dataclass(frozen=True)
class Options:
    """``sample_rows`` and ``sample_bytes`` bound what the driver trains on."""

    sample_rows: int = 3000
    sample_bytes: int = 12_000_000
    filters: int = 16
    width: int = 5
    hop: int = 32  # half a chunk
    hidden: int = 16
    epochs: int = 14
    rate: float = 0.01
    seed: int = 7


PAD = 256
SEGMENT = 1 << 17  # bytes of a text that are convolved at a time


class Network:
    def __init__(self, o: Options):
        rng = np.random.default_rng(o.seed)
        self.o = o
        f, h = o.filters, o.hidden
        self.p = {
            "taps": rng.normal(0, 0.3, (o.width, 257, f)).astype(np.float32),
            "bias": np.zeros(f, np.float32),
            "w1": rng.normal(0, (2 / f) ** 0.5, (f, h)).astype(np.float32),
            "b1": np.zeros(h, np.float32),
            "w2": rng.normal(0, (1 / h) ** 0.5, h).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }
        self.mean, self.scale = np.zeros(f, np.float32), np.ones(f, np.float32)

    def responses(self, x: np.ndarray, t: int) -> np.ndarray:
        """Of the filters at the first ``t`` places of ``x``, which is ``width - 1`` longer."""
        taps = self.p["taps"]
        a = np.take(taps[0], x[:t], axis=0)
        for j in range(1, self.o.width):
            a += np.take(taps[j], x[j : j + t], axis=0)
        a += self.p["bias"]
        return np.maximum(a, 0, out=a)

    def pooled(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For each filter, its largest average over a chunk, and where that chunk begins."""
        o, t = self.o, max(1, len(text))
        x = np.full(t + o.width - 1, PAD, np.int64)
        x[: len(text)] = np.frombuffer(text, np.uint8)
        best, at, last = None, None, None
        for start in range(0, t, SEGMENT):
            n = min(SEGMENT, t - start)
            halves = np.add.reduceat(self.responses(x[start : start + n + o.width - 1], n), np.arange(0, n, o.hop))
            first = start // o.hop
            if last is not None:
                halves, first = np.concatenate([last, halves]), first - 1
            last = halves[-1:]
            chunks = halves[:-1] + halves[1:] if len(halves) > 1 else halves
            k = chunks.argmax(axis=0)
            top = chunks[k, np.arange(o.filters)]
            if best is None:
                best, at = top, k + first
            else:
                at = np.where(top > best, k + first, at)
                best = np.maximum(top, best)
        return best / (2 * o.hop), at * o.hop

    def combine(self, z: np.ndarray) -> np.ndarray:
        z = (z - self.mean) / self.scale
        hidden = np.maximum(z @ self.p["w1"] + self.p["b1"], 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.p["w2"] + self.p["b2"], -30, 30)))

    def score(self, text: bytes) -> float:
        return float(self.combine(self.pooled(text)[0][None])[0])

    def fit(self, texts: list[bytes], y: np.ndarray, batch: int = 32) -> None:
        """Adam on the cross-entropy; both classes weigh the same only as far as the data do."""
        o, p, rng = self.o, self.p, np.random.default_rng(self.o.seed)
        first = np.array([self.pooled(t)[0] for t in texts[:256]])
        self.mean, self.scale = first.mean(axis=0), first.std(axis=0) + 1e-3
        m = {k: np.zeros_like(v) for k, v in p.items()}
        v = {k: np.zeros_like(x) for k, x in p.items()}
        step, size = 0, 257 * o.filters
        total = o.epochs * -(-len(texts) // batch)
        for _ in range(o.epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                ids = order[lo : lo + batch]
                both = [self.pooled(texts[i]) for i in ids]
                z = (np.array([b[0] for b in both]) - self.mean) / self.scale
                pre = z @ p["w1"] + p["b1"]
                hidden = np.maximum(pre, 0)
                out = 1 / (1 + np.exp(-np.clip(hidden @ p["w2"] + p["b2"], -30, 30)))
                d = ((out - y[ids]) / len(ids)).astype(np.float32)
                g = {"w2": hidden.T @ d, "b2": d.sum(keepdims=True)}
                dh = np.outer(d, p["w2"]) * (pre > 0)
                g["w1"], g["b1"] = z.T @ dh, dh.sum(axis=0)
                dz = dh @ p["w1"].T / self.scale / (2 * o.hop)
                taps, bias = np.zeros((o.width, size)), np.zeros(o.filters)
                for row, i in enumerate(ids):
                    self._back(texts[i], both[row][1], dz[row], taps, bias)
                g["taps"], g["bias"] = taps.reshape(o.width, 257, o.filters), bias
                step += 1
                rate = o.rate * (1 - (step - 1) / total)
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    change = m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                    p[k] -= (rate * change).astype(np.float32)

    def _back(self, text: bytes, at: np.ndarray, dz: np.ndarray, taps: np.ndarray, bias: np.ndarray) -> None:
        """Add the gradient of one text: only the chunk that won for a filter has one."""
        o, t = self.o, max(1, len(text))
        x = np.full(t + o.width - 1, PAD, np.int64)
        x[: len(text)] = np.frombuffer(text, np.uint8)
        place = at[:, None] + np.arange(2 * o.hop)[None]
        inside = place < t
        place = np.minimum(place, t - 1)
        which = np.arange(o.filters)[:, None]
        code = [x[place + j] for j in range(o.width)]
        a = self.p["bias"][:, None] + sum(self.p["taps"][j][code[j], which] for j in range(o.width))
        d = np.where((a > 0) & inside, dz[:, None], 0).ravel()
        bias += d.reshape(o.filters, -1).sum(axis=1)
        for j in range(o.width):
            taps[j] += np.bincount((code[j] * o.filters + which).ravel(), d, taps.shape[1])


def train(documents: DataFrame, labels: DataFrame, options: Options = Options()) -> Network:
    """A network trained on labelled documents that are not held out.

    ``labels`` has ``doc_id`` and ``quality``; null labels and ids are left out, and of a
    document with several labels each counts. Without any label the network stays as
    initialised, and so does its answer for a class that never occurs.
    """
    rows = labelled_sample(documents, labels, "quality", options.sample_rows, options.sample_bytes)
    net = Network(options)
    if rows:
        net.fit([t for t, _ in rows], np.array([y for _, y in rows], np.float32))
    return net


def score(documents: DataFrame, net: Network, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Add ``score`` and ``predicted`` (1 from ``threshold`` on) for every whole text.

    Columns of those names are replaced. A null text counts as empty, and an empty text has the
    score of one padded chunk. Rows are independent: repeated rows and null keys stay.
    """

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([net.score((t or "").encode()) for t in batch], dtype="float64")

    out = documents.drop("score", "predicted")
    out = out.withColumn("score", F.pandas_udf(tidy(scored), "double")(text))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(documents: DataFrame, labels: DataFrame, options: Options = Options()) -> DataFrame:
    """Train on ``labels`` and score every document; ``held_out`` marks what training never sees."""
    net = train(documents, labels, options)
    return score(documents, net).withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
