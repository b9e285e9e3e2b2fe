"""Jaccard join on word n-grams with several global token orders.

Two sets can reach the threshold only if their prefixes share a token under every global order
of the tokens. One order puts n-grams of rare words first, so that texts which share common phrases
seldom meet; in the others tokens come in the order of a hash of their own, so that sets which share
a few tokens by chance fail under one order or another. Frequent tokens come last in each.

1. Every text becomes a set of hashed n-grams; equal sets are one node from here on. Words are
   counted meanwhile.
2. Prefix tokens under the order of rare words go to shards of the tokens as packed arrays. A shard
   emits the pairs of a token that few sets share; of a token that many share, only a chain.
3. The bitmaps of a pair's sets are compared. Each bit is the parity of the tokens that fall on it, so
   that sets differ in as many tokens as bits at least; this rules out most pairs that only a passage
   brought together. What is left and the chains make candidate clusters. The sets of clusters too
   large for a task are sent again, the tokens that many shared now being frequent ones, while
   that makes such clusters fewer.
4. The bitmaps of a cluster's sets meet, which makes smaller clusters.
5. The texts of such a cluster meet, each once. There, pairs must share a prefix token under all
   three orders before they are verified exactly. In 4 and 5, clusters too large for a task meet in
   pairs of blocks.
6. Links are joined to components, and each component takes its smallest key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoeval.llm.components import Union, components
from convoeval.llm.shared import give_back, join_spread, partitions_for, stored, tidy, work_folder


@dataclass(frozen=True)
class Options:
    words: int = 4
    percent: int = 85  # of the union that the intersection must reach
    frequent: int = 1 << 18  # tokens that are known to be frequent, at most
    counted: int = 1 << 21  # tokens that a task counts at a time
    few: int = 32  # sets that may share a token and still be paired
    shard_rows: int = 1 << 20
    block: int = 1024  # sets of a cluster that meet in a task, twice at most
    block_tokens: int = 1 << 21  # and their tokens on average
    bloom_bits: int = 1 << 25


MOST_BITS = 1 << 15  # of a bitmap; those of larger sets rule out less
PAIR, CHAIN, SHARED = 1, 2, 3  # kinds of candidates
AT_A_TIME = 256  # tokens of which the sets are looked up together
WORD_CELLS = 1 << 16  # counts of words, each of all words whose hashes fall on it
RARE = 3  # the order of n-grams of rare words; others go by hash
SENT = 1 << 18  # prefix tokens that a task sends at a time
ROUNDS = 4  # in which clusters are made smaller, at most


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))  # the contract's white space
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_WORD = 64  # bytes; longer words are hashed one by one
TEXT_BYTES = 1 << 18  # bytes of texts that are shingled together


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start, and a 64-bit hash of each. Upper-case letters stay what they are.

    All words are hashed at once, eight bytes after eight.
    """
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~WHITE[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(np.diff(inside))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    padded = text + bytes(8)
    eight = np.ndarray(len(text) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    h = _mixed(sizes.astype(np.uint64), 20)
    todo = np.flatnonzero(sizes <= LONG_WORD)
    for done in range(0, LONG_WORD, 8):
        left = sizes[todo] - done
        todo, left = todo[left > 0], left[left > 0]
        if not len(todo):
            break
        h[todo] = _mixed(h[todo] ^ (eight[starts[todo] + done] & LOW_BYTES[np.minimum(left, 8)]), 21 + done // 8)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(text[starts[i] : starts[i] + sizes[i]])
    return starts, h


MOST_COMMON = 1023  # the largest sum of levels


def _cells(words: np.ndarray) -> np.ndarray:
    """The cell of each word's hash."""
    return (words >> np.uint64(64 - (WORD_CELLS - 1).bit_length())).astype(np.int64)


class Shingler:
    """Texts to ascending arrays of distinct 64-bit n-gram hashes.

    ``counts``, if given, takes up the counts of the words by cell.
    """

    def __init__(self, words: int, counts: np.ndarray | None = None):
        self.n, self.counts = words, counts

    def _grams(self, h: np.ndarray, n: int) -> np.ndarray:
        """The hash of the n-gram that starts at each word but the last n - 1."""
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, n, np.uint64)  # shorter sequences differ from n-grams
            for i in range(n):
                out = out * np.uint64(0x100000001B3) + _mixed(h[i : len(h) - n + 1 + i], i)
        return _mixed(out, 0)

    def __call__(self, text: str) -> np.ndarray:
        return next(self.all([text]))

    def all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The set of each text. Texts that are short are worked on together."""
        for group in self._groups(texts):
            yield from self._together(group)

    def ranked(self, texts: Iterable[str | bytes], levels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The set of each text, and how common the words of each token are: the sum of their levels."""
        for group in self._groups(texts):
            yield from self._together(group, levels)

    def _groups(self, texts: Iterable[str | bytes]) -> Iterator[list[bytes]]:
        group, size = [], 0
        for t in texts:
            raw = t if isinstance(t, bytes) else t.encode()
            if group and size + len(raw) > TEXT_BYTES:
                yield group
                group, size = [], 0
            group.append(raw)
            size += len(raw) + 1
        if group:
            yield group

    def _together(self, texts: list[bytes], levels: np.ndarray | None = None) -> Iterator:
        starts, h = word_hashes(b"\n".join(texts).lower())  # of bytes: A-Z only
        ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])).tolist()
        grams = self._grams(h, self.n) if len(h) >= self.n else None
        if self.counts is not None:
            self.counts += np.bincount(_cells(h), minlength=WORD_CELLS)
        if levels is not None and grams is not None:
            each = np.concatenate([[0], np.cumsum(levels[_cells(h)], dtype=np.int64)])
            sums = np.minimum(each[self.n :] - each[: -self.n], MOST_COMMON).astype(np.uint64)
        lo = 0
        for hi in ends:
            words = hi - lo
            if words >= self.n:
                own = grams[lo : hi - self.n + 1]
                if levels is None:
                    own = np.sort(own)
                else:
                    by = np.argsort(own)
                    own, ranks = own[by], sums[lo : hi - self.n + 1][by]
                new = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=new[1:])
                yield own[new] if levels is None else (own[new], ranks[new])
            else:  # the whole sequence is one
                own = self._grams(h[lo:hi], words) if words else np.zeros(0, np.uint64)
                yield own if levels is None else (own, np.zeros(len(own), np.uint64))
            lo = hi


def set_id(tokens: np.ndarray) -> int:
    """A signed 64-bit number that stands for the set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens on each of 64, 128, 256 ... places: no fewer than tokens, up to a limit."""
    width = min(max(64, 1 << (len(tokens) - 1).bit_length()), MOST_BITS)
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Orders:
    """Global token orders: by hash, the frequent ones last and by frequency.

    The order ``RARE`` goes by the levels of the tokens' words before the hash.
    """

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, percent: int, levels: np.ndarray | None = None):
        by = np.argsort(frequent)
        self.tokens, self.counts, self.percent = frequent[by], counts[by].astype(np.uint64), percent
        self.levels = np.zeros(WORD_CELLS, np.uint8) if levels is None else levels

    def with_frequent(self, tokens: np.ndarray, counts: np.ndarray) -> Orders:
        """These orders with more frequent tokens."""
        new = ~np.isin(tokens, self.tokens)
        return Orders(
            np.concatenate([self.tokens, tokens[new]]), np.concatenate([self.counts, counts[new].astype(np.uint64)]), self.percent, self.levels
        )

    def prefix(self, tokens: np.ndarray, order: int) -> np.ndarray:
        return self.prefixes(tokens, (order,))[0]

    def prefixes(self, tokens: np.ndarray, orders: Iterable[int], ranks: np.ndarray | None = None) -> list[np.ndarray]:
        """The prefix of an ascending array of distinct tokens under each of these orders.

        ``ranks`` has the sum of levels of each token; only the order ``RARE`` asks for it.
        """
        n = len(tokens)
        size = n - (self.percent * n + 99) // 100 + 1
        if size >= n:
            return [tokens for _ in orders]
        known, last, out = np.zeros(0, np.int64), None, []
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            known = np.flatnonzero(self.tokens[at] == tokens)
            last = np.uint64(1 << 63) + self.counts[at[known]]
        for order in orders:
            key = _mixed(tokens, 10 + order) >> np.uint64(1)
            if order == RARE:
                key = (ranks << np.uint64(53)) | (key >> np.uint64(10))
            if len(known):
                key[known] = last
            out.append(tokens[np.argsort(key, kind="stable")[:size]])  # of equal keys, the smaller token
        return out


def read_sets(documents: DataFrame, o: Options, key: str, text: str) -> DataFrame:
    """(key, n, set, bits, tokens, counts): a row per document, and rows (n = -1) of tokens that came up often.

    A task counts its tokens so many at a time and reports those of three sets or more, and in ``bits``
    of the same row its words by cell. Keys travel as text, since pandas has no exact whole numbers beside nulls.
    """
    columns = [key, "n", "set", "bits", "tokens", "counts"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = np.zeros(WORD_CELLS, np.int64)
        shingles, seen, kept, size = Shingler(o.words, words), set(), [], 0

        def often() -> pd.DataFrame:
            tokens = np.concatenate(kept)
            kept.clear()
            tokens.sort()
            new = np.ones(len(tokens), bool)
            np.not_equal(tokens[1:], tokens[:-1], out=new[1:])
            heads = np.flatnonzero(new[:-2] & (tokens[2:] == tokens[:-2]))  # of three equal ones or more
            many = tokens[heads]
            counts = np.searchsorted(tokens, many, "right") - heads
            row = [None, -1, 0, words.tobytes(), many.view(np.int64), counts.astype(np.int32)]
            words[:] = 0
            return pd.DataFrame([row], columns=columns)

        for batch in batches:
            rows = []
            for k, tokens in zip(batch["_key"].tolist(), shingles.all(batch["_text"])):
                own = set_id(tokens) if len(tokens) else 0
                rows.append((k, len(tokens), own, bitmap(tokens) if len(tokens) else None, None, None))
                if len(tokens) and own not in seen:
                    seen.add(own)
                    kept.append(tokens)
                    size += len(tokens)
            yield pd.DataFrame(rows, columns=columns)
            if size >= o.counted:
                yield often()
                kept, size = [], 0
        if kept:
            yield often()

    rows = documents.select(F.col(key).cast("string").alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    out = rows.mapInPandas(tidy(read), f"`{key}` string, n long, set long, bits binary, tokens array<long>, counts array<int>")
    return out.withColumn(key, F.col(key).cast(dict(documents.dtypes)[key]))


def word_levels(read: DataFrame) -> np.ndarray:
    """How common the words of each cell are: the rounded logarithm, base two, of their number."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(WORD_CELLS, np.int64)
        for batch in batches:
            for counts in batch["bits"]:
                total += np.frombuffer(counts, np.int64)
        yield pd.DataFrame({"bits": [total.tobytes()]})

    total = np.zeros(WORD_CELLS, np.int64)
    for r in read.filter("n < 0").select("bits").coalesce(8).mapInPandas(add, "bits binary").toLocalIterator():
        total += np.frombuffer(r["bits"], np.int64)
    return np.rint(np.log2(total + 1)).astype(np.uint8)


def frequent_tokens(read: DataFrame, o: Options, percent: int) -> Orders:
    """The orders that put the most frequent tokens last. Their number is bounded."""
    each = read.filter("n < 0").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x"))
    sums = each.groupBy(F.col("x.tokens").alias("token")).agg(F.sum("x.counts").alias("n"))
    top = sums.orderBy(F.desc("n"), "token").limit(o.frequent).toPandas()
    return Orders(top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), percent, word_levels(read))


def _close(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The sizes allow the threshold."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def candidate_pairs(texts: DataFrame, orders: Orders, o: Options, shards: int) -> DataFrame:
    """(a, b, found): pairs of sets that share a prefix token under the order of rare words.

    Of a token that few sets share all pairs are PAIR; of others the sets are in a CHAIN by size,
    which holds together what sizes allow to be linked. Rows (token, sets, SHARED) name these tokens.
    ``texts`` has ``_text``, and may have ``set``: then texts of other sets are passed over.
    """
    percent, asked = o.percent, "set" in texts.columns

    # Arrow batches, without copies of their texts in pandas.
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen, found, rows = Shingler(o.words), set(), [], 0

        def packed() -> pa.RecordBatch:
            tokens = np.concatenate([f[0] for f in found])
            sizes = [len(f[0]) for f in found]
            ids = np.repeat(np.array([f[1] for f in found], np.int64), sizes)
            n = np.repeat(np.array([f[2] for f in found], np.uint32), sizes)
            found.clear()
            shard = (tokens % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            starts = np.searchsorted(shard[by], np.arange(shards + 1))
            some = np.flatnonzero(np.diff(starts))
            ends = [*starts[some].tolist(), len(by)]
            parts = ([x[lo:hi].tobytes() for lo, hi in zip(ends, ends[1:])] for x in (tokens[by], ids[by], n[by]))
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(p, pa.binary()) for p in parts)], ["shard", "tokens", "ids", "n"])

        for batch in batches:
            wanted = batch.column("set").to_pylist() if asked else [None] * len(batch)
            texts = (t.as_buffer().to_pybytes() for t in batch.column("_text"))
            for want, (tokens, ranks) in zip(wanted, shingles.ranked(texts, orders.levels)):
                own = set_id(tokens) if len(tokens) else None
                if own is None or own in seen or (asked and own != want):
                    continue
                seen.add(own)
                (prefix,) = orders.prefixes(tokens, (RARE,), ranks)
                found.append((prefix.copy(), own, len(tokens)))
                rows += len(prefix)
                if rows >= SENT:
                    yield packed()
                    rows = 0
        if rows:
            yield packed()

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        give_back()
        tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["tokens"]])
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["ids"]])
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["n"]]).astype(np.int64)
        by = np.lexsort((ids, n, tokens))
        tokens, ids, n = tokens[by], ids[by], n[by]
        new = np.ones(len(tokens), bool)  # sets that several tasks have seen
        new[1:] = (tokens[1:] != tokens[:-1]) | (ids[1:] != ids[:-1])
        tokens, ids, n = tokens[new], ids[new], n[new]
        heads = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        sizes = np.diff(np.concatenate([heads, [len(tokens)]]))
        many = sizes > o.few
        # What a set of a chain follows is the next smaller one of its token.
        follows = np.repeat(many, sizes)
        follows[heads] = False
        second = [np.flatnonzero(follows)]
        first = [second[0] - 1]
        for m in np.unique(sizes[(sizes > 1) & ~many]):
            at = heads[sizes == m]
            i, j = np.triu_indices(m, 1)
            first.append((at[:, None] + i).ravel())
            second.append((at[:, None] + j).ravel())
        found = np.repeat([CHAIN, PAIR], [len(first[0]), sum(map(len, first[1:]))])
        i, j = np.concatenate(first), np.concatenate(second)
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        out = pd.DataFrame({"a": a, "b": b, "found": found})[_close(n[i], n[j], percent)].drop_duplicates()
        return pd.concat([out, pd.DataFrame({"a": tokens[heads[many]].view(np.int64), "b": sizes[many], "found": SHARED})])

    sent = texts.mapInArrow(tidy(send), "shard int, tokens binary, ids binary, n binary")
    return sent.groupBy("shard").applyInPandas(pair, "a long, b long, found int")


def may_link(n: list[np.ndarray], maps: list[pd.Series], percent: int) -> np.ndarray:
    """Whether sizes and bitmaps leave it open that sets are linked, each of the first with its own of the second."""
    out = np.zeros(len(n[0]), bool)
    widths = [m.map(len).to_numpy() for m in maps]
    for a, b in np.unique(np.stack(widths, 1), axis=0).tolist():
        at = np.flatnonzero((widths[0] == a) & (widths[1] == b))
        words = [np.frombuffer(b"".join(m.iloc[at]), np.uint64).reshape(len(at), -1) for m in maps]
        while words[0].shape[1] != words[1].shape[1]:
            k = int(words[1].shape[1] > words[0].shape[1])
            half = words[k].shape[1] // 2
            words[k] = words[k][:, :half] ^ words[k][:, half:]
        differ = np.bitwise_count(words[0] ^ words[1]).sum(axis=1, dtype=np.int64)
        out[at] = (100 + percent) * differ <= (100 - percent) * (n[0][at] + n[1][at])
    return out


def open_pairs(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that bitmaps do not rule out. ``maps`` has size and bitmap of each set."""
    for x in "ab":
        pairs = pairs.join(maps.select(F.col("set").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), x)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left = may_link([batch[x].to_numpy() for x in ("n_a", "n_b")], [batch["bits_a"], batch["bits_b"]], percent)
            yield batch.loc[left, ["a", "b"]]

    return pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInPandas(tidy(check), "a long, b long")


def candidate_clusters(
    documents: DataFrame, orders: Orders, o: Options, firsts: DataFrame, maps: DataFrame, tokens: int, key: str, text: str, folder: str
) -> DataFrame:
    """(node, root): clusters of sets outside of which no set has a link.

    Sets of clusters larger than a block are looked at again among themselves, with the tokens that
    many of them share behind the others, until their number falls by less than a half. ``firsts``
    has for each set the document that stands for it, ``maps`` its size and bitmap; ``tokens`` is
    the number of all sets' tokens.
    """
    done, before = [], None
    texts = documents.select(F.coalesce(text, F.lit("")).alias("_text"))
    for turn in range(ROUNDS):
        shards = partitions_for(documents.sparkSession, tokens * (100 - o.percent) // 100, o.shard_rows)
        found = stored(candidate_pairs(texts, orders, o, shards), f"{folder}/pairs-{turn}")
        each = found.filter(F.col("found") != SHARED).groupBy("a", "b").agg(F.max("found").alias("found"))
        chains = found.filter(F.col("found") == CHAIN).select("a", "b")
        # Stored, and texts dealt anew below, so that no task needs two Python workers at once.
        pairs = stored(open_pairs(each.filter(F.col("found") == PAIR).select("a", "b"), maps, o.percent), f"{folder}/open-{turn}")
        clusters = components(pairs.union(chains), f"{folder}/clusters-{turn}")
        large = clusters.groupBy("root").count().filter(F.col("count") > o.block).select("root")
        again = clusters.join(large, "root").select(F.col("node").alias("set")).join(firsts, "set")
        again = stored(again, f"{folder}/large-{turn}")
        sets, tokens = again.agg(F.count("*"), F.sum("n")).first()
        if not sets or turn == ROUNDS - 1 or (before and 2 * sets > before):
            return reduce(DataFrame.union, done, clusters)
        done.append(clusters.join(large, "root", "left_anti").select("node", "root"))
        many = found.filter(F.col("found") == SHARED).groupBy("a").agg(F.max("b").alias("n"))
        many = many.orderBy(F.desc("n"), "a").limit(o.frequent).toPandas()
        orders = orders.with_frequent(many["a"].to_numpy(np.int64).view(np.uint64), many["n"].to_numpy(np.int64))
        texts, before = texts_of(documents, again.drop("n"), o, key, text).select("set", "_text").repartition("set"), sets


def bloom(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """A Bloom filter of fixed size: words of 64 bits, put together by Spark."""
    h = F.xxhash64(key)
    place = F.explode(F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 32), F.lit(bits)))).alias("bit")
    words = keys.select(place).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")
    )
    found = words.toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _may_be_in(filter_: np.ndarray):
    """A UDF that tells from xxhash64 of a key whether it may be in the filter."""

    def look(h: pd.Series) -> pd.Series:
        x, bits = h.to_numpy(np.int64), 64 * len(filter_)
        hit = np.ones(len(x), bool)
        for place in (x % bits, (x >> 32) % bits):
            hit &= (filter_[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pd.Series(hit)

    return F.pandas_udf(look, "boolean")


class _Postings:
    """Which of some token arrays share a token with one of them."""

    def __init__(self, arrays: list[np.ndarray]):
        self.n = len(arrays)
        sizes = [len(a) for a in arrays]
        tokens, code, counts = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
        common = counts[code] > 1
        owner = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        # Tokens of one array only bring nothing together and are left out.
        code, owner = code[common].astype(np.int32), owner[common]
        self.owners = owner[np.argsort(code, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(tokens)))])
        self.codes = np.split(code, np.searchsorted(owner, np.arange(1, self.n)))

    def sharing(self, i: int) -> np.ndarray:
        """True for each array that has a token of array ``i``; some tokens at a time, since each may be in all arrays."""
        out = np.zeros(self.n, bool)
        for first in range(0, len(self.codes[i]), AT_A_TIME):
            codes = self.codes[i][first : first + AT_A_TIME]
            lo, size = self.starts[codes], self.starts[codes + 1] - self.starts[codes]
            at = np.arange(size.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            out[self.owners[at]] = True
        return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many tokens two ascending arrays share, ``a`` being no longer than ``b``."""
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def links_between(
    ids: list[int], sets: list[np.ndarray], side: list[int] | None, orders: Orders, percent: int
) -> list[tuple[int, int]]:
    """Edges that connect what the links between these sets connect.

    With ``side`` only pairs of different sides count. A pair is verified, by counting the tokens
    that it shares, if it shares a prefix token under each of the three orders and is not yet connected.
    """
    by = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets = [ids[i] for i in by], [sets[i] for i in by]
    n = np.array([len(s) for s in sets])
    sides = np.array([side[i] for i in by]) if side is not None else None
    prefixes = [_Postings(list(p)) for p in zip(*(orders.prefixes(s, range(3)) for s in sets))]
    union, out = Union(), []
    for i in range(1, len(ids)):
        near = 100 * n[:i] >= percent * n[i]
        if sides is not None:
            near &= sides[:i] != sides[i]
        for p in prefixes:
            if near.any():
                near &= p.sharing(i)[:i]
        for j in np.flatnonzero(near).tolist():
            if union.root(i) != union.root(j):
                shared = _common(sets[j], sets[i])
                if 100 * shared >= percent * (n[i] + n[j] - shared):
                    union.join(i, j)
                    out.append((ids[i], ids[j]))
    return out


def pairs_left(
    ids: list[int], maps: list[tuple[int, bytes]], side: list[int] | None, percent: int
) -> list[tuple[int, int]]:
    """Edges that connect what the pairs connect that sizes and bitmaps do not rule out.

    ``maps`` has the size and the bitmap of each set. A map folds to half its width by the parity
    of its halves; two maps are compared at the width of the smaller one.
    """
    by = sorted(range(len(ids)), key=lambda i: (maps[i][0], ids[i]))
    ids, n = [ids[i] for i in by], np.array([maps[i][0] for i in by], np.int64)
    words = [np.frombuffer(maps[i][1], np.uint64) for i in by]
    sides = np.array([side[i] for i in by]) if side is not None else None
    widths = np.array([len(w) for w in words])  # ascend with the sizes
    first = {w: int(np.searchsorted(widths, w)) for w in np.unique(widths).tolist()}
    rows = {w: np.stack(words[lo : int(np.searchsorted(widths, w, "right"))]) for w, lo in first.items()}
    union, out = Union(), []
    for i in range(1, len(ids)):
        least, own = int(np.searchsorted(100 * n, percent * n[i])), words[i]
        while least < i:
            w = len(own)
            if w in rows and (hi := min(i, first[w] + len(rows[w]))) > (lo := max(least, first[w])):
                differ = np.bitwise_count(rows[w][lo - first[w] : hi - first[w]] ^ own).sum(axis=1, dtype=np.int64)
                near = (100 + percent) * differ <= (100 - percent) * (n[lo:hi] + n[i])
                if sides is not None:
                    near &= sides[lo:hi] != sides[i]
                for j in (np.flatnonzero(near) + lo).tolist():
                    if union.root(i) != union.root(j):
                        union.join(i, j)
                        out.append((ids[i], ids[j]))
            if w == widths[least]:
                break
            own = own[: w // 2] ^ own[w // 2 :]
    return out


def _met(sets: DataFrame, reader: Callable, edges: Callable) -> DataFrame:
    """(a, b): what ``edges`` finds where the sets of a cluster meet.

    ``sets`` has each set with its cluster and its block of the cluster's ``blocks``. A cluster of
    one block meets once, others in all pairs of blocks. ``reader`` makes a function from batches to
    what takes part of each row, if anything.
    """
    mine, all_ = F.col("block"), F.sequence(F.lit(0), F.col("blocks") - 1)
    meets = F.explode(F.transform(all_, lambda x: F.struct(F.least(x, mine).alias("i"), F.greatest(x, mine).alias("j"))))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, group, now = reader(), {}, None

        def found() -> pd.DataFrame:
            side = [b for _, b in group.values()] if now[1] != now[2] else None
            return pd.DataFrame(edges(list(group), [x for x, _ in group.values()], side), columns=["a", "b"])

        for batch in batches:
            places = zip(*(batch[x].tolist() for x in ("cluster", "i", "j", "set", "block")))
            for (c, i, j, s, b), own in zip(places, read(batch)):
                if (c, i, j) != now:
                    if len(group) > 1:
                        yield found()
                    group, now = {}, (c, i, j)
                if own is not None:
                    group[s] = own, b
        if len(group) > 1:
            yield found()

    placed = sets.select("*", meets.alias("at")).select("*", "at.i", "at.j").drop("at", "blocks")
    dealt = placed.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "set")
    return dealt.mapInPandas(tidy(meet), "a long, b long")


def _blocks(clusters: DataFrame, sets: DataFrame, blocks: Column) -> DataFrame:
    """``sets`` of these clusters with cluster, block and blocks. ``blocks`` is made of ``size`` and ``total``."""
    of_cluster = clusters.join(sets, clusters["node"] == sets["set"])
    sizes = of_cluster.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    dealt = of_cluster.join(sizes.select("root", blocks.alias("blocks")), "root").drop("node")
    return dealt.withColumnRenamed("root", "cluster").withColumn("block", F.pmod(F.xxhash64("set"), "blocks"))


def texts_of(documents: DataFrame, wanted: DataFrame, o: Options, key: str, text: str) -> DataFrame:
    """(set, _text) and the other columns of ``wanted`` for each set there, by the document that stands for it.

    A key's other texts, which are other sets, come too. A set that only documents without key have
    is found by its number, once in each task that reads it.
    """

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, seen = Shingler(o.words), set()
        for batch in batches:
            rows = []
            for t, tokens in zip(batch["_text"], shingles.all(batch["_text"])):
                own = set_id(tokens) if len(tokens) else None
                if own is not None and own not in seen:
                    seen.add(own)
                    rows.append((own, t))
            yield pd.DataFrame(rows, columns=["set", "_text"])

    read = documents.select(key, F.coalesce(text, F.lit("")).alias("_text"))
    hit = _may_be_in(bloom(wanted, key, o.bloom_bits))
    texts = read.filter(F.col(key).isNotNull()).filter(hit(F.xxhash64(key))).join(wanted, key).drop(key)
    keyless = wanted.filter(F.col(key).isNull()).drop(key)
    if not keyless.isEmpty():
        hit = _may_be_in(bloom(keyless, "set", o.bloom_bits))
        named = read.filter(F.col(key).isNull()).select("_text").mapInPandas(tidy(name), "set long, _text string")
        texts = texts.unionByName(named.filter(hit(F.xxhash64("set"))).join(keyless, "set"))
    return texts


def verified_links(documents: DataFrame, wanted: DataFrame, orders: Orders, o: Options, key: str, text: str) -> DataFrame:
    """(a, b): links that connect the sets of each cluster.

    ``wanted`` has for each set the document that stands for it, its cluster and its block of the
    cluster's ``blocks``.
    """

    def reader() -> Callable:
        shingles = Shingler(o.words)

        def read(batch: pd.DataFrame) -> Iterator[np.ndarray | None]:
            for own, tokens in zip(batch["set"].tolist(), shingles.all(batch["_text"])):
                yield tokens if len(tokens) and set_id(tokens) == own else None  # a key's other texts are other sets

        return read

    # Texts travel, not their sets, which are larger.
    sets = texts_of(documents, wanted, o, key, text).select("cluster", "set", "block", "blocks", "_text")
    return _met(sets, reader, lambda ids, sets, side: links_between(ids, sets, side, orders, o.percent))


def _linked(documents: DataFrame, o: Options, key: str, text: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(key, n, set) of every document, and (set, root) of every set that is linked to another."""
    read = stored(read_sets(documents, o, key, text), f"{folder}/sets")
    orders = frequent_tokens(read, o, o.percent)
    docs = read.filter("n >= 0").select(key, "n", "set")

    total = docs.agg(F.sum("n")).first()[0] or 0
    firsts = docs.filter("n > 0").groupBy("set").agg(F.min(key).alias(key), F.max("n").alias("n"))
    maps = read.filter("n > 0").groupBy("set").agg(F.max("n").alias("n"), F.max("bits").alias("bits"))
    clusters = candidate_clusters(documents, orders, o, firsts, maps, total, key, text, folder)

    by_size = F.ceil(F.col("size") / o.block)
    mapped = _blocks(clusters, maps, by_size)
    left = _met(mapped, lambda: lambda rows: zip(rows["n"].tolist(), rows["bits"]), lambda *met: pairs_left(*met, o.percent))
    clusters = components(stored(left, f"{folder}/left"), f"{folder}/left-clusters")

    wanted = _blocks(clusters, firsts, F.greatest(by_size, F.ceil(F.col("total") / o.block_tokens))).drop("n")
    wanted = stored(wanted, f"{folder}/wanted")
    links = stored(verified_links(documents, wanted, orders, o, key, text), f"{folder}/links")

    return docs, components(links, f"{folder}/components").select(F.col("node").alias("set"), "root")


def join(documents: DataFrame, options: Options = Options(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every document.

    A null or empty text, or one without words, has no shingle and is a component of its own. Equal
    texts are linked. Repeated rows are returned each; a null key is never the smallest of a
    component, so that one of null keys only has a null ``component_id``. Other columns are left
    behind; an empty table gives no row.
    """
    docs, roots = _linked(documents, options, key, text, work_folder(documents.sparkSession, "jaccard"))
    firsts = docs.filter("n > 0").groupBy("set").agg(F.min(key).alias(key))
    linked = firsts.join(roots, "set")
    least = linked.groupBy("root").agg(F.min(key).alias("component_id"))
    of_set = firsts.join(roots.join(least, "root").drop("root"), "set", "left").select(
        "set", F.coalesce("component_id", key).alias("component_id")
    )
    out = join_spread(docs, of_set, "set")
    own = F.when(F.col("n") == 0, F.col(key)).otherwise(F.col("component_id"))
    return out.select(key, F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(documents: DataFrame, options: Options = Options(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near duplicates: of each component the one with the smallest key.

    Of rows with the same key and set one stays; those with different sets are different documents.
    Rows without key are told apart by their sets: of those of a component one stays, and all that
    have no words.
    """
    o, folder = options, work_folder(documents.sparkSession, "jaccard")
    docs, roots = _linked(documents, o, key, text, folder)
    keyless = F.col(key).isNull()
    first = F.min(F.when(~keyless, F.struct(key, "set")))
    sets = docs.filter("n > 0").groupBy("set").agg(F.min(key).alias(key), F.bool_or(keyless).alias("keyless"))
    each = sets.join(roots, "set", "left").groupBy(F.coalesce("root", "set").alias("root"))
    least = each.agg(first.alias("first"), F.min(F.when(F.col("keyless"), F.col("set"))).alias("other"))
    chosen = least.filter("first is not null").select("first.*").union(docs.filter("n = 0").select(key, "set").filter(~keyless).distinct())
    keys = docs.filter(~keyless).groupBy(key).agg(
        (F.min("set") != F.max("set")).alias("shared"), (F.count("*") > 1).alias("again")
    )
    chosen = chosen.join(keys.drop("again"), key).unionByName(
        least.filter("other is not null").select(F.lit(None).cast(dict(docs.dtypes)[key]).alias(key), F.col("other").alias("set"), F.lit(True).alias("shared"))
    )
    chosen = stored(chosen, f"{folder}/chosen")
    # Most keys have one row, and it stays. Only rows that may have another key are dealt by key.
    stays = chosen.filter("not shared").select(key, F.lit(True).alias("stays"))
    doubtful = keys.join(stays, key, "left").filter("shared or again or stays is null")
    doubtful = stored(doubtful.select(F.col(key).alias("_key"), F.col("shared").alias("_shared"), F.col("stays").alias("_stays")), f"{folder}/doubtful")

    def number(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingles = Shingler(o.words)
        for batch in batches:
            yield pd.Series([set_id(s) if len(s) else 0 for s in shingles.all(batch)], dtype="int64")

    number = F.pandas_udf(tidy(number), "long").asNondeterministic()  # else Spark numbers all documents before it selects any

    keyed, hit = documents.filter(~keyless), _may_be_in(bloom(doubtful, "_key", o.bloom_bits))(F.xxhash64(key))
    asked = keyed.filter(hit).join(doubtful, F.col(key) == F.col("_key"), "left")
    kept = keyed.filter(~hit).select(*documents.columns)
    # The key tells the row where it has one set only; elsewhere the text must be read again.
    by_key = asked.filter("_key is null or _stays").select(*documents.columns).dropDuplicates([key])
    wanted = chosen.filter("shared").select(F.col(key).alias("_key"), F.col("set").alias("_set"))
    several = asked.filter("_shared").select(*documents.columns)
    named = several.unionByName(documents.filter(keyless)).withColumn("_number", number(F.coalesce(text, F.lit(""))))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_number") == F.col("_set"))
    wordless = keyless & (F.col("_number") == 0)
    one = named.filter(~wordless).dropDuplicates([key, "_number"]).join(wanted, same, "left_semi")
    for part in (by_key, one, named.filter(wordless)):
        kept = kept.unionByName(part.select(*documents.columns))
    return kept
