"""What Python workers hold beside the work of the stages that follow."""

import re
import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers

from convoeval.llm import jaccard, shared
from convoeval.llm.encode import library_encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def own_mb() -> float:
    told = Path("/proc/self/smaps_rollup").read_text()
    return int(re.search(r"\nPss_Anon:\s+(\d+)", told)[1]) / 1024


def test_a_task_gives_back_what_it_freed():
    pins = []

    def task(batches):
        for batch in batches:
            some = [bytes(3000) for _ in range(batch)]  # of the C library's heap
            pins.append(bytes(3000))  # what lies above the freed ones and stays
            yield len(some)
            del some

    before = own_mb()
    assert list(shared.tidy(task)(iter([40_000, 30_000]))) == [40_000, 30_000]
    assert own_mb() - before < 30  # of some 115


def test_texts_are_encoded_so_many_bytes_at_a_time(monkeypatch):
    encoder, seen = library_encoder(PATH, 1 << 10, 1 << 12), []
    group = type(encoder)._group
    monkeypatch.setattr(encoder, "_group", lambda texts: seen.append(len(texts)) or group(encoder, texts))
    texts = [f"Some words of text {i}, été.\n" * 4 for i in range(300)]
    assert list(encoder.encode_all(texts)) == [encoder.encode(t) for t in texts]
    assert sum(seen) == 300 and max(seen) <= 1 + (1 << 12) // 100


class Read:
    """Stands for a table; keeps the function that reads it."""

    dtypes = [("doc_id", "bigint")]

    def select(self, *_):
        return self

    def mapInPandas(self, task, _):  # noqa: N802
        self.task = task
        return self

    def withColumn(self, *_):  # noqa: N802
        return self


def test_tokens_are_counted_without_copies(spark):
    def found(texts):
        table = jaccard.read_sets(Read(), jaccard.Options(words=1), "doc_id", "text")
        batch = pd.DataFrame({"_key": [str(i) for i in range(len(texts))], "_text": texts})
        return pd.concat(list(table.task(iter([batch]))))

    out = found(["a b c", "a b d", "a e", "b f", "x"])
    (row,) = out[out["n"] < 0].itertuples()
    one = {w: int(jaccard.Shingler(1)(w).view(np.int64)[0]) for w in "ab"}
    assert dict(zip(map(int, row.tokens), map(int, row.counts))) == {one["a"]: 3, one["b"]: 3}
    for texts in (["x"], ["x y"], ["x", "y"]):
        assert [len(t) for t in found(texts).query("n < 0")["tokens"]] == [0]

    texts = [" ".join(f"w{i}x{j}" for j in range(2000)) for i in range(300)]  # 600,000 tokens
    tracemalloc.start()
    found(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4.2 * 8 * 600_000, peak / (8 * 600_000)
