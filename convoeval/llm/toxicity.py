"""Toxicity by compression distance.

Two Zstandard dictionaries are trained, one on ordinary text and one on toxic text. The toxic
one is the ordinary one followed by the passages that toxic documents have and ordinary ones
lack, so that a window of ordinary text is about as long under either, and only toxic passages
shorten it. A document is scored by how much shorter its overlapping windows become: the shares
of windows that gain at least so many bytes go into a logistic function, fitted on labelled
documents that the dictionaries have not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoeval.llm.shared import held_out, labelled_sample


@dataclass(frozen=True)
class Options:
    """``sample_rows`` and ``sample_bytes`` bound, per class, what the driver trains on.

    The ordinary dictionary is trained on every k-th window of its sample, so that from
    ``train_windows`` to twice as many are left; fewer windows are all taken.
    """

    sample_rows: int = 2000
    sample_bytes: int = 7_000_000
    window: int = 48
    hop: int = 16
    level: int = 3
    train_windows: int = 60000
    ordinary_bytes: int = 65536
    toxic_bytes: int = 2048
    gains: tuple[int, ...] = (2, 3, 4, 5, 6, 8)
    prior: float = 0.25  # share of toxic documents that the probabilities are meant for


_RUN = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")  # letters, and all bytes beyond ASCII
_BATCH = 4096  # windows compressed in one call


@dataclass
class Model:
    options: Options
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    _compressors: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_compressors": []}  # made anew in each task

    def _lengths(self, windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not self._compressors:
            for content in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.options.level)
                self._compressors.append(
                    zstandard.ZstdCompressor(
                        level=self.options.level,
                        dict_data=d,
                        write_content_size=False,
                        write_checksum=False,
                        write_dict_id=False,
                    ).compress
                )
        plain, toxic = self._compressors
        return np.array([len(plain(w)) for w in windows]), np.array([len(toxic(w)) for w in windows])

    def features(self, text: bytes) -> np.ndarray:
        """Of the windows of the lower-cased text, how many gain that much: as number and share."""
        text = text.lower()
        o, n, found = self.options, 0, np.zeros(len(self.options.gains))
        starts = range(0, max(1, len(text) - o.window + o.hop), o.hop)
        for lo in range(0, len(starts), _BATCH):
            plain, toxic = self._lengths([text[i : i + o.window] for i in starts[lo : lo + _BATCH]])
            gain = plain - toxic
            n += len(gain)
            found += [(gain >= g).sum() for g in o.gains]
        return np.concatenate([[1.0], np.log1p(found), found / (n + 8) * 20, [np.log1p(n)]])

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))


def _heads(run: bytes) -> set[bytes]:
    """A run of letters and its beginnings: inflected words share those."""
    return {run, *(run[:n] for n in (4, 5, 6, 7) if n < len(run))}


def contrast(toxic: list[bytes], ordinary: list[bytes], most: int) -> bytes:
    """The passages of toxic texts that ordinary ones lack, the most frequent last.

    A passage is a run of letters, or its beginning, with the character before it. It counts if
    a fiftieth of the toxic documents have it and six times the share of the ordinary ones.
    """
    inside = Counter(h for t in toxic for h in {h for r in set(_RUN.findall(t)) for h in _heads(r)})
    outside = Counter(h for t in ordinary for h in {h for r in set(_RUN.findall(t)) for h in _heads(r)})
    told = {
        h
        for h, n in inside.items()
        if n >= max(3, len(toxic) / 50) and n * (len(ordinary) + 1) >= 6 * (outside[h] + 1) * (len(toxic) + 1)
    }
    passages: Counter = Counter()
    for t in toxic:
        for m in _RUN.finditer(t):
            for h in _heads(m.group()) & told:
                passages[t[max(0, m.start() - 1) : m.start() + len(h)]] += 1
    body = b""
    for p in sorted(passages, key=lambda p: (-passages[p], -len(p), p)):
        if p not in body and len(body) + len(p) <= most:
            body = p + body
    return body


def _windows(texts: list[bytes], o: Options) -> list[bytes]:
    return [t[i : i + o.window] for t in texts for i in range(0, max(1, len(t) - o.window + o.hop), o.hop)]


def _ordinary_dictionary(texts: list[bytes], o: Options) -> bytes:
    windows = _windows(texts, o)
    try:
        return zstandard.train_dictionary(o.ordinary_bytes, windows[:: max(1, len(windows) // o.train_windows)], k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from
        return b"".join(texts)[-o.ordinary_bytes :] or b"\n" * 8


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression with a ridge, by Newton steps; the constant is free."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[bytes], ordinary: list[bytes], o: Options = Options()) -> Model:
    """Dictionaries from two of three texts of each class, the logistic function from the third.

    With an empty class there is nothing to tell apart, and every score is the prior.
    """
    ordinary, toxic = [t.lower() for t in ordinary], [t.lower() for t in toxic]
    o_fit, t_fit = [t for i, t in enumerate(ordinary) if i % 3], [t for i, t in enumerate(toxic) if i % 3]
    base = _ordinary_dictionary(o_fit, o)
    model = Model(o, base, base + contrast(t_fit, o_fit, o.toxic_bytes), np.zeros(2 * len(o.gains) + 2))
    model.weights[0] = np.log(o.prior / (1 - o.prior))
    o_cal, t_cal = ordinary[::3], toxic[::3]
    if o_cal and t_cal:
        x = np.array([model.features(t) for t in t_cal + o_cal])
        y = np.array([1.0] * len(t_cal) + [0.0] * len(o_cal))
        n = len(y)
        weight = np.where(y == 1, o.prior * n / len(t_cal), (1 - o.prior) * n / len(o_cal))
        model.weights = _fit_logistic(x, y, weight)
    return model


def train(documents: DataFrame, labels: DataFrame, options: Options = Options()) -> Model:
    """A model from labelled documents that are not held out; equal texts count once."""
    classes = []
    for value in (1, 0):
        of = labels.filter(F.col("toxic") == value)
        rows = labelled_sample(documents, of, "toxic", options.sample_rows, options.sample_bytes)
        classes.append(list(dict.fromkeys(t for t, _ in rows)))
    return fit(*classes, options)


def score(documents: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """Add ``score`` and ``predicted`` (1 from ``threshold`` on) for every whole text.

    Columns of those names are replaced. A null text counts as empty; an empty text has one empty
    window, which gains nothing. Rows are independent: repeated rows and null keys stay.
    """

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.score((t or "").encode()) for t in batch], dtype="float64")

    out = documents.drop("score", "predicted")
    out = out.withColumn("score", F.pandas_udf(scored, "double")(text))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(documents: DataFrame, labels: DataFrame, options: Options = Options()) -> DataFrame:
    """Train on ``labels`` and score every document; ``held_out`` marks what training never sees."""
    model = train(documents, labels, options)
    return score(documents, model).withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
