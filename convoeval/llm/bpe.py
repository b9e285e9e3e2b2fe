"""Byte-level BPE: encoding by a queue of merge ranks, and decoding.

A text is cut into pieces at places where the tokenizer's pattern always has a border (a
space or a newline between two non-space characters), pieces are cut into words by the
pattern, and the symbols of a word are merged in the order of the merge ranks. Results of
pieces and words are remembered in a table of bounded size, for speed only.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import string
from array import array
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pattern of byte-level tokenizers, and Unicode's white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

_BORDER = re.compile(f"(?= [^{WHITE}])")
CACHED = 1 << 19  # pieces that a task remembers
LONG = 200  # longer pieces are not remembered
TOGETHER = 1 << 22  # bytes of texts, but for the last one, whose pieces are looked up together
RUN = 50  # pieces that are encoded in one run
MARKS = string.punctuation  # after letters, at the end of a piece, these are one word of the pattern
LATIN = "".join(filter(str.isalpha, map(chr, range(0x250))))  # letters in every version of Unicode since 5.0
_LATIN = re.compile(f"[{LATIN}]+").fullmatch


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE tokenizer file: vocabulary, merges and added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        if (
            spec["normalizer"]
            or before.get("type") != "ByteLevel"
            or before.get("add_prefix_space")
            or not before.get("use_regex", True)
            or model["type"] != "BPE"
        ):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        self.ids: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        self.size = max([*self.ids.values(), *self.added.values()]) + 1
        chars = byte_characters()
        self.byte_ids = [self.ids[c] for c in chars]
        # (left, right) as one number -> (rank, merged id)
        self.merges: dict[int, tuple[int, int]] = {}
        byte_of = {c: b for b, c in enumerate(chars)}
        # Whether words of Latin letters, a space before each, have the same ids in a row as alone:
        # no merge takes a space after what can be the end of such a word.
        self.rows = not any(map(model.get, ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")))
        space = chars[ord(" ")]
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            if right[0] == space:
                self.rows &= bytes(map(byte_of.__getitem__, left)).decode("utf-8", "replace")[-1] not in LATIN + "\ufffd"
            self.merges[self.ids[left] * self.size + self.ids[right]] = rank, self.ids[left + right]
        self.strings: list[bytes] = [b""] * self.size
        for token, i in self.ids.items():
            self.strings[i] = bytes(byte_of[c] for c in token)
        for token, i in self.added.items():
            self.strings[i] = token.encode()

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word.

        The symbols are a doubly linked list; the queue holds (rank, place) of pairs that can
        merge. An entry is stale, and skipped, if the pair at its place has another rank by now.
        """
        symbols = [self.byte_ids[b] for b in word]
        n, size, merges = len(symbols), self.size, self.merges
        if n < 2:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get(symbols[i] * size + symbols[i + 1])
            if found:
                queue.append((found[0], i))
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = merges.get(symbols[i] * size + symbols[j])
            if not found or found[0] != rank:
                continue
            symbols[i], symbols[j] = found[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get(symbols[i] * size + symbols[k])
                if found:
                    heapq.heappush(queue, (found[0], i))
            h = before[i]
            if h >= 0:
                found = merges.get(symbols[h] * size + symbols[i])
                if found:
                    heapq.heappush(queue, (found[0], h))
        return [s for s in symbols if s >= 0]

    def decode(self, ids) -> str:
        """The text of ids: their strings one after the other; broken UTF-8 is replaced."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class Remembered(dict):
    """Text -> its ids as 32-bit numbers. Filled on demand, emptied when full."""

    def __init__(self, encode: Callable[[str], bytes], limit: int = CACHED):
        self.encode, self.limit = encode, limit

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= LONG:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = ids
        return ids


class TextEncoder:
    """Whole texts to ids, as the bytes of 32-bit numbers.

    ``run`` encodes a span without added tokens, ``words`` (optional) words of Latin letters, each
    with a space before it. ``run`` sees each piece of a text by itself, which
    gives the ids of the whole text because the pattern has a border wherever pieces meet.
    """

    def __init__(
        self, added: dict[str, int], run: Callable[[str], bytes], words: Callable[[list[str]], list[bytes]] | None = None
    ):
        self.run, self.words = run, words
        self.marks, self.firsts = Remembered(run, 1 << 10), Remembered(run, 1 << 14)
        # The space before a piece is not in its key; a newline is.
        self.pieces = Remembered(lambda p: run(p if p[:1] == "\n" else " " + p))
        self.together = TOGETHER
        self.added = {t: array("I", [i]).tobytes() for t, i in added.items()}
        # As the library does: at each place the longest added token.
        longest = sorted(added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if added else None

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        # Single spaces and newlines between other characters are the plain case.
        if text.replace("\n", " ").split(" ") != text.split():
            return b"".join(self.run(part) for part in _BORDER.split(text))
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.run(first) + b"".join(map(self.pieces.__getitem__, rest))

    def encode_all(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        """The ids of each text. Each piece is looked up once for some megabytes of texts."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        sizes = pc.binary_length(texts).to_numpy()
        groups = (np.cumsum(sizes) - sizes) // self.together
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(texts)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                yield from self._group(texts.slice(lo, hi - lo))

    def _group(self, texts: pa.Array) -> Iterator[bytes]:
        """Texts of which ``encode`` must see the whole go there; the others are gathered from their pieces' ids."""
        whole = np.zeros(len(texts), bool)
        if self.added:
            whole = reduce(pc.or_, (pc.match_substring(texts, t) for t in self.added)).to_numpy(zero_copy_only=False).copy()
        plain = np.flatnonzero(~whole)
        words = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), " ")
        first = words.offsets.to_numpy()[:-1].astype(np.int64)
        words = words.flatten()
        heads = words.take(pa.array(first)).to_numpy(zero_copy_only=False).tolist()
        later = np.ones(len(words), bool)
        later[first] = False
        coded = pc.if_else(pa.array(later), words, pa.scalar(None, words.type)).dictionary_encode()
        del words
        ids = self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = coded.indices.fill_null(0).to_numpy().astype(np.int64)
        at[first] = np.arange(len(ids), len(ids) + len(heads))
        ids += [self.firsts[h] if h.split() == [h] else None for h in heads]
        if None in ids:
            whole[plain] = np.logical_or.reduceat(np.array([i is None for i in ids])[at], first)
        sizes = np.fromiter((len(i or b"") // 4 for i in ids), np.int64, len(ids))
        starts, total = np.cumsum(sizes) - sizes, int(sizes[at].sum())
        # Places of ids within the group; a group of more than 2 GB of text would need more bits.
        kind = np.int32 if total < 1 << 31 else np.int64
        n = sizes.astype(kind)[at]
        ends = np.cumsum(n, dtype=kind)
        source = np.repeat(starts.astype(kind)[at] - ends + n, n)
        source += np.arange(total, dtype=kind)
        out = np.frombuffer(b"".join(filter(None, ids)), np.uint32)[source]
        cuts = [*(ends - n)[first].tolist(), total]
        places = dict(zip(plain.tolist(), zip(cuts, cuts[1:])))
        for i, by_itself in enumerate(whole.tolist()):
            if by_itself:
                yield self.encode(texts[i].as_py())
            else:
                lo, hi = places[i]
                yield out[lo:hi].tobytes()

    def _look_up(self, pieces: list[str]) -> list[bytes | None]:
        """The ids of distinct pieces; None for those that are not words."""
        known = self.pieces
        ids = list(map(known.get, pieces))
        new = [p for p, found in zip(pieces, ids) if found is None]
        if not new:
            return ids
        learned = self._learn(new)
        if len(known) + len(learned) > known.limit:
            known.clear()
        short = ((p, found) for p, found in learned.items() if len(p) <= LONG)
        known.update(islice(short, known.limit - len(known)))
        return [learned.get(p) if found is None else found for p, found in zip(pieces, ids)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of those pieces that are words.

        Latin letters with marks at the end are two words of the pattern at most; the letters go to
        ``words``. Others are encoded some at a time: a newline between words is a border on both
        sides and a token of its own, so that it tells their ids apart. A piece that starts with a
        newline has that token and then the ids of its word without a space.
        """
        learned, stems, others, lines = {}, {}, [], []
        for piece in new:
            stem = piece.rstrip(MARKS)
            if self.words and stem.isalpha() and (stem.isascii() or _LATIN(stem)):
                learned[piece] = stems[stem] = b""
            elif piece[:1] != "\n" and piece.split() == [piece]:
                others.append(piece)
            elif piece[:1] == "\n" and piece[1:].split() == [piece[1:]]:
                lines.append(piece)
        if stems:
            stems = dict(zip(stems, self.words(list(stems))))
            for piece in learned:
                ids = stems.get(piece)
                if ids is None:
                    stem = piece.rstrip(MARKS)
                    ids = stems[stem] + self.marks[piece[len(stem) :]]
                learned[piece] = ids
        line = self.run("\n")
        for some, before in ((others, " "), (lines, "")):
            for lo in range(0, len(some), RUN):
                found = some[lo : lo + RUN]
                text = "\n ".join(["", *found]) if before else "".join(found)
                raw = self.run(text) if len(line) == 4 and not (self.special and self.special.search(text)) else b""
                cuts = 4 * np.flatnonzero(np.frombuffer(raw, np.uint32) == np.frombuffer(line, np.uint32)[0])
                if len(cuts) == len(found):
                    starts, ends = (cuts + 4 * len(before)).tolist(), [*cuts[1:].tolist(), len(raw)]
                    learned.update((p, raw[a:b]) for p, a, b in zip(found, starts, ends))
                else:
                    learned.update((p, self.run(before + p)) for p in found)
        return learned

    def encode(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return b"".join(self.added.get(p) or self._plain(p) for p in self.special.split(text))


def queue_encoder(vocabulary: Vocabulary) -> TextEncoder:
    """Encodes words by the queue of merge ranks."""
    words = Remembered(lambda w: array("I", vocabulary.merge(w.encode())).tobytes())
    split = regex.compile(PATTERN).findall
    return TextEncoder(vocabulary.added, lambda t: b"".join(map(words.__getitem__, split(t))))


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(documents: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Encode every text, decode the ids, and add the number of ids and both digests.

    The columns ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and
    ``decoded_sha256`` (of the decoded text) replace columns of those names. A null text is
    empty: no ids, digests of the empty string. Rows are independent: repeated rows stay, keys
    may be null, an empty table gives an empty one. A long text is encoded whole, in one row.
    """

    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocab = Vocabulary(vocabulary)
        encoder = queue_encoder(vocab)
        decimal = [str(i) for i in range(vocab.size)]
        for batch in batches:
            rows = []
            for t in batch:
                ids = np.frombuffer(encoder.encode(t or ""), dtype=np.uint32).tolist()
                rows.append(
                    (
                        len(ids),
                        hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest(),
                        hashlib.sha256(vocab.decode(ids).encode()).hexdigest(),
                    )
                )
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    out = documents.drop(*names).withColumn("_digests", F.pandas_udf(digests, DIGESTS)(text))
    return out.select("*", *[F.col("_digests")[n].alias(n) for n in names]).drop("_digests")
