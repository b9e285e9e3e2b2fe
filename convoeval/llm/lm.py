"""Scoring texts by a bigram model whose successors lie in Elias-Fano tries.

Texts are cut once into blocks of local word numbers. A block asks shards of the vocabulary for
the counts of its distinct words, and shards of the model for its distinct pairs. A shard of the
model sums the training counts that all blocks sent, builds its trie, writes it to the shared
folder, maps it and answers each block by quantised probabilities: one byte for a pair. No task
holds more than one shard or one block, and nothing that grows goes through the driver.

The model interpolates: P(w | v) = max(c(v, w) - d, 0) / c(v) + d * T(v) / c(v) * P(w), where T
counts the distinct successors of v in training and P(w) is the smoothed share of w. A text begins
after an end. A context that never occurs leaves P(w).
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoeval.llm.elias_fano import BigramTrie
from convoeval.llm.shared import give_back, held_out, map_file, stored, tidy, work_folder, write_file

END = b" "  # no word has a space
UNSEEN, HOT = 255, 254  # codes besides the quantised levels
LEVELS = 254
ASKED = 1 << 18  # pairs that a shard looks up together


@dataclass(frozen=True)
class Options:
    discount: float = 0.75
    block_tokens: int = 1 << 20
    shard_tokens: int = 1 << 21
    # Contexts with at least this share of the tokens are spread over all shards of the model;
    # there are at most 1 / hot_share of them.
    hot_share: float = 2.0**-13


def _zip(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unzip(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def quantised(p: np.ndarray, lowest: float) -> np.ndarray:
    """Levels of log10 p in even steps from ``lowest`` to 0, the nearest one."""
    with np.errstate(divide="ignore"):
        level = np.rint((1 - np.log10(p) / lowest) * (LEVELS - 1))
    return np.clip(level, 0, LEVELS - 1).astype(np.uint8)


def probabilities(lowest: float) -> np.ndarray:
    """The probability of each level; of the unseen code 0."""
    p = 10 ** (lowest * (1 - np.arange(LEVELS) / (LEVELS - 1)))
    return np.concatenate([p, np.zeros(256 - LEVELS)])


def code_width(words: int) -> int:
    """Bytes of hash that tell so many words apart: fewer than one pair is expected to share its code."""
    return min(8, max(4, -(-2 * int(words).bit_length() // 8)))


# Keys travel as text, since pandas has no exact whole numbers beside nulls.
BLOCK = "block string, keys array<string>, lengths binary, train binary, words binary, tokens binary, n_tokens long, n_train long"


def blocks(documents: DataFrame, o: Options, key: str, text: str) -> DataFrame:
    """Runs of documents: distinct word hashes, and each token's place among them."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, train, lengths, numbers, tokens, n = [], [], [], None, [], 0

        def block() -> pd.DataFrame:
            size, learn = np.array(lengths, np.int64), np.array(train, bool)
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
            row = [
                uuid.uuid4().hex, keys, _zip(size), _zip(learn), words.tobytes(),
                _zip(np.concatenate(tokens)), int(size.sum()), int(size[learn].sum()),
            ]
            return pd.DataFrame([row], columns=columns)

        columns = [c.split(" ")[0] for c in BLOCK.split(", ")]
        for batch in batches:
            for k, t, out in zip(batch["_key"].tolist(), batch["_text"], batch["_out"]):
                if numbers is None:
                    numbers = defaultdict(count().__next__)
                    numbers[END]
                words = t.encode().lower().split()
                words.append(END)
                tokens.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                keys.append(k)
                train.append(not out)
                lengths.append(len(words))
                n += len(words)
                if n >= o.block_tokens:
                    yield block()
                    keys, train, lengths, numbers, tokens, n = [], [], [], None, [], 0
        if n:
            yield block()

    rows = documents.select(
        F.col(key).cast("string").alias("_key"), F.coalesce(text, F.lit("")).alias("_text"), held_out(F.col(key), 7, 2).alias("_out")
    )
    return rows.mapInPandas(tidy(cut), BLOCK)


class Block:
    """A stored block, unpacked."""

    def __init__(self, row):
        self.lengths, self.train = _unzip(row.lengths, "i8"), _unzip(row.train, "?")
        self.words = np.frombuffer(row.words, np.uint64)
        self.tokens = _unzip(row.tokens, "u4").astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.learn = self.train[self.doc]

    def by_shard(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words in the order in which they are sent, and where each shard begins."""
        shard = self.words % np.uint64(shards)
        order = np.lexsort((self.words, shard))
        return order, np.searchsorted(shard[order], np.arange(shards + 1).astype(np.uint64))

    def pairs(self, shards: int, width: int, hot: np.ndarray):
        """Distinct pairs in the order in which they are sent.

        Returns context and successor codes, training counts, where each shard begins, and for
        each token the place of its pair. Codes are the leading bits of the word hashes.
        """
        before = np.concatenate([[0], self.tokens[:-1]])
        before[np.concatenate([[0], np.cumsum(self.lengths)[:-1]])] = 0  # the end is word 0
        # Words are numbered anew in the order of their codes, so that pairs come in that order.
        code, number = np.unique(self.words >> np.uint64(64 - 8 * width), return_inverse=True)
        key, inverse = np.unique(number[before] * len(code) + number[self.tokens], return_inverse=True)
        counts = np.bincount(inverse, self.learn, len(key)).astype(np.uint32)
        a, b = code[key // len(code)], code[key % len(code)]
        spread = np.isin(a, hot)
        mixed = np.where(spread, b, a) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
        shard = (mixed % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.uint64)  # short ones sort faster
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        starts = np.searchsorted(shard[order], np.arange(shards + 1).astype(np.uint64))
        return a[order], b[order], counts[order], starts, place[inverse]


def _heads(a: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts as they are sent, once in each shard, and where the pairs of each begin."""
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    new[starts[starts < len(a)]] = True
    first = np.flatnonzero(new)
    return a[first], first


def _narrow(codes: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def word_counts(cut: DataFrame, shards: int, hot_count: float) -> DataFrame:
    """What the vocabulary's shards answer.

    A row (block, shard, counts) for each block, and a row without block for the shard itself:
    its numbers of distinct words and of those in training, and hashes and counts of those with
    ``hot_count``.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                b = Block(row)
                order, starts = b.by_shard(shards)
                counts = np.bincount(b.tokens[b.learn], minlength=len(b.words)).astype(np.uint32)[order]
                words = b.words[order]
                out = []
                for s in np.flatnonzero(np.diff(starts)).tolist():
                    lo, hi = starts[s], starts[s + 1]
                    out.append((row.block, s, words[lo:hi].tobytes(), _zip(counts[lo:hi])))
                yield pd.DataFrame(out, columns=["block", "shard", "words", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        words = [np.frombuffer(w, np.uint64) for w in pdf["words"]]
        counts = np.concatenate([_unzip(c, "u4") for c in pdf["counts"]]).astype(np.float64)
        known, inverse = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(inverse, counts, len(known)).astype(np.uint64)
        ends = np.cumsum([len(w) for w in words])
        each = [_zip(total[inverse[e - len(w) : e]]) for w, e in zip(words, ends)]
        shard = pdf["shard"].iloc[0]
        out = [(b, shard, c, 0, 0, None, None) for b, c in zip(pdf["block"], each)]
        often = total >= max(1.0, hot_count)
        out.append((None, shard, None, len(known), int((total > 0).sum()), known[often].tobytes(), total[often].tobytes()))
        return pd.DataFrame(out, columns=["block", "shard", "counts", "all_words", "distinct", "hot", "hot_counts"])

    sent = cut.select("block", "lengths", "train", "words", "tokens").mapInPandas(
        tidy(send), "block string, shard int, words binary, counts binary"
    )
    return sent.groupBy("shard").applyInPandas(
        answer, "block string, shard int, counts binary, all_words long, distinct long, hot binary, hot_counts binary"
    )


def pair_codes(
    cut: DataFrame, folder: str, discount: float, lowest: float, shards: int, width: int, hot: dict[int, int]
) -> DataFrame:
    """What the model's shards answer, after each has built and mapped its trie.

    A row (block, shard, pairs, contexts) of codes for each block, and a row without block that
    names the trie and tells how many distinct successors the shard has of each hot context.
    """
    hot_codes = np.array(sorted(hot), np.uint64)
    hot_counts = np.array([hot[int(c)] for c in hot_codes], np.float64)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                a, b, counts, starts, _ = Block(row).pairs(shards, width, hot_codes)
                a, b, out = _heads(a, starts), _narrow(b, width), []
                for s in np.flatnonzero(np.diff(starts)).tolist():
                    lo, hi = starts[s], starts[s + 1]
                    first = slice(*np.searchsorted(a[1], (lo, hi)))
                    runs = np.diff(a[1][first], append=hi).astype(np.uint32)
                    out.append((
                        row.block, s, _narrow(a[0][first], width), _zip(runs), b[lo * width : hi * width], _zip(counts[lo:hi]),
                    ))
                yield pd.DataFrame(out, columns=["block", "shard", "contexts", "runs", "successors", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        give_back()
        sent = [
            (_wide(r.contexts, width), _unzip(r.runs, "u4"), _wide(r.successors, width), _unzip(r.counts, "u4"))
            for r in pdf.itertuples()
        ]
        raw, successors = build_trie(sent, hot_codes, hot_counts, discount, lowest)
        name = f"trie-{pdf['shard'].iloc[0]}-{uuid.uuid4().hex}"
        write_file(folder, name, raw)
        del raw
        trie = BigramTrie(map_file(folder, name))
        out, shard, names = [], pdf["shard"].iloc[0], pdf["block"].tolist()
        ends = np.cumsum([len(b) for _, _, b, _ in sent])
        groups = np.searchsorted(ends, np.arange(0, ends[-1], ASKED), "right")
        for lo, hi in zip(np.unique(groups), [*np.unique(groups)[1:], len(sent)]):  # some blocks together
            asked = sent[lo:hi]
            contexts, runs, b = (np.concatenate([x[i] for x in asked]) for i in range(3))
            place = trie.find_contexts(contexts)
            at = trie.find(np.repeat(place, runs), b)
            codes = np.where(at >= 0, trie.codes[np.maximum(at, 0)] if trie.level.n else UNSEEN, UNSEEN).astype(np.uint8)
            back = np.where(place >= 0, trie.backoff[np.maximum(place, 0)] if trie.contexts.n else UNSEEN, UNSEEN)
            back = np.where(np.isin(contexts, hot_codes), HOT, back).astype(np.uint8)
            pairs, heads = (np.cumsum([0, *(len(x[i]) for x in asked)]) for i in (2, 0))
            for k, block in enumerate(names[lo:hi]):
                out.append((block, shard, _zip(codes[pairs[k] : pairs[k + 1]]), _zip(back[heads[k] : heads[k + 1]]), None))
        out.append((None, pdf["shard"].iloc[0], None, name.encode(), successors.tobytes()))
        return pd.DataFrame(out, columns=["block", "shard", "pairs", "contexts", "successors"])

    rows = cut.select("block", "lengths", "train", "words", "tokens").mapInPandas(
        tidy(send), "block string, shard int, contexts binary, runs binary, successors binary, counts binary"
    )
    return rows.groupBy("shard").applyInPandas(
        answer, "block string, shard int, pairs binary, contexts binary, successors binary"
    )


def build_trie(
    sent, hot_codes: np.ndarray, hot_counts: np.ndarray, discount: float, lowest: float
) -> tuple[bytes, np.ndarray]:
    """A shard's trie from what the blocks sent, and its distinct successors of each hot context."""
    a = np.repeat(np.concatenate([c for c, _, _, _ in sent]), np.concatenate([r for _, r, _, _ in sent]))
    b = np.concatenate([s for _, _, s, _ in sent])
    n = np.concatenate([c for _, _, _, c in sent]).astype(np.int64)
    a, b, n = a[n > 0], b[n > 0], n[n > 0]
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    a, b = a[at], b[at]
    n = np.add.reduceat(n, at) if len(at) else n
    head = np.ones(len(a), bool)
    head[1:] = a[1:] != a[:-1]
    first = np.flatnonzero(head)
    contexts, kinds = a[first], np.diff(np.concatenate([first, [len(a)]]))
    total = (np.add.reduceat(n, first) if len(first) else np.zeros(0)).astype(np.float64)
    hot_at = np.searchsorted(hot_codes, contexts)
    is_hot = np.zeros(len(contexts), bool)
    if len(hot_codes):
        hot_at = np.minimum(hot_at, len(hot_codes) - 1)
        is_hot = hot_codes[hot_at] == contexts
        total[is_hot] = hot_counts[hot_at[is_hot]]
    successors = np.zeros(len(hot_codes), np.int64)
    successors[hot_at[is_hot]] = kinds[is_hot]
    codes = quantised((n - discount) / np.repeat(total, kinds), lowest)
    backoff = quantised(discount * kinds / np.maximum(total, 1), lowest)
    return BigramTrie.encode(contexts, first, b, backoff, codes), successors


def score(documents: DataFrame, options: Options = Options(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every text: (key, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learns from documents whose CRC-32 of the key is not 2 modulo 7. A null or empty text has one
    token, the end. Rows without key are held out; repeated rows count and are scored each. If
    there is nothing to learn from, every probability is 1. An empty table gives no row.
    """
    o, spark = options, documents.sparkSession
    folder = work_folder(spark, "model")
    cut = stored(blocks(documents, o, key, text), f"{folder}/blocks")
    sums = cut.agg(F.sum("n_tokens"), F.sum("n_train")).first()
    tokens, train = sums[0] or 0, sums[1] or 0
    shards = max(4, -(-tokens // o.shard_tokens))

    words = stored(word_counts(cut, shards, o.hot_share * train), f"{folder}/words")
    sums = words.agg(F.sum("distinct"), F.sum("all_words")).first()
    vocabulary, width = sums[0] or 0, code_width(sums[1] or 0)
    hot: dict[int, int] = {}
    for r in words.filter(F.col("block").isNull()).select("hot", "hot_counts").toLocalIterator():
        for h, c in zip(np.frombuffer(r["hot"], np.uint64), np.frombuffer(r["hot_counts"], np.uint64)):
            code = int(h) >> (64 - 8 * width)
            hot[code] = hot.get(code, 0) + int(c)

    lowest = -1 - np.log10(train + 1)  # below the smallest discounted share there can be
    pairs = stored(pair_codes(cut, folder, o.discount, lowest, shards, width, hot), f"{folder}/pairs")
    hot_codes = np.array(sorted(hot), np.uint64)
    kinds = np.zeros(len(hot_codes), np.int64)
    for r in pairs.filter(F.col("block").isNull()).select("successors").toLocalIterator():
        kinds += np.frombuffer(r["successors"], np.int64)
    hot_counts = np.array([hot[int(c)] for c in hot_codes], np.float64)
    hot_backoff = np.minimum(1.0, o.discount * kinds / np.maximum(hot_counts, 1))
    level = probabilities(lowest)
    kind = dict(documents.dtypes)[key]

    def sum_up(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        give_back()
        row = next(block.itertuples())
        b = Block(row)
        order, _ = b.by_shard(shards)
        a, _, _, starts, place = b.pairs(shards, width, hot_codes)
        counts = np.empty(len(b.words))
        got = answers[answers["counts"].notna()].sort_values("shard")["counts"]
        counts[order] = np.concatenate([_unzip(c, "u8") for c in got])
        got = answers[answers["pairs"].notna()].sort_values("shard")
        alpha = level[np.concatenate([_unzip(c, "u1") for c in got["pairs"]])]
        sent = np.concatenate([_unzip(c, "u1") for c in got["contexts"]])
        back = np.where(sent == UNSEEN, 1.0, level[sent])
        # Contexts were sent once in each shard; they are in the order of the pairs.
        heads, first = _heads(a, starts)
        which = np.repeat(np.arange(len(first)), np.diff(first, append=len(a)))
        if len(hot_codes):
            at = np.minimum(np.searchsorted(hot_codes, heads), len(hot_codes) - 1)
            back = np.where(sent == HOT, hot_backoff[at], back)
        share = (counts + 1) / (train + vocabulary + 1)
        alone = share[b.tokens]
        p = alpha[place] + back[which[place]] * alone
        n = len(b.lengths)
        return pd.DataFrame(
            {
                key: list(row.keys),
                "held_out": ~b.train,
                "n_tokens": b.lengths,
                "n_known": np.bincount(b.doc, counts[b.tokens] > 0, n).astype(np.int64),
                "train_tokens": train,
                "base_score": np.bincount(b.doc, np.log10(alone), n),
                "score": np.bincount(b.doc, np.log10(p), n),
            }
        )

    missing = F.lit(None).cast("binary")
    answers = words.filter(F.col("block").isNotNull()).select(
        "block", "shard", "counts", missing.alias("pairs"), missing.alias("contexts")
    )
    answers = answers.unionByName(
        pairs.filter(F.col("block").isNotNull()).select("block", "shard", missing.alias("counts"), "pairs", "contexts")
    )
    scored = (
        cut.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInPandas(
            sum_up,
            f"`{key}` string, held_out boolean, n_tokens long, n_known long, train_tokens long, "
            "base_score double, score double",
        )
    )
    return scored.withColumn(key, F.col(key).cast(kind))
