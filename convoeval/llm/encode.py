"""Encoding by the tokenizers library, with a bounded memory of pieces."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np

from convoeval.llm.bpe import TOGETHER, TextEncoder, Vocabulary, byte_characters
from convoeval.llm.shared import give_back

REMEMBERED = 1 << 20  # pieces that a Python worker remembers, some 200 bytes each
ROW = 64  # words that the library's model gets at once


def library_encoder(path: str, remembered: int = REMEMBERED, together: int = TOGETHER) -> TextEncoder:
    """Whole texts to the ids that the library gives, without special tokens added.

    The library encodes every piece that is not remembered, words of Latin letters in rows by its
    model; see ``TextEncoder`` for why the ids
    of pieces make up those of the text. Truncation and padding are switched off. A Python worker
    serves many tasks; it loads a file once, and its pieces are remembered from task to task.
    ``together`` bytes of texts, but for the last one, are worked on at a time.
    """
    file = os.stat(path)
    return _encoder(path, file.st_size, file.st_mtime_ns, remembered, together)


@lru_cache(maxsize=1)
def _encoder(path: str, size: int, time: int, remembered: int, together: int) -> TextEncoder:
    """The encoder of a file that had this size at this time."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    encode, tokenize = library.encode, library.model.tokenize
    vocabulary = Vocabulary(path)
    characters = dict(enumerate(byte_characters()))
    space = characters[ord(" ")]
    spaced = np.array([token[:1] == b" " for token in vocabulary.strings])
    row = ROW if vocabulary.rows else 1

    def words(own: list[str]) -> list[bytes]:
        """Ids of words with a space before each; a token that begins with a space begins a word."""
        out = []
        for lo in range(0, len(own), row):
            text = " " + " ".join(own[lo : lo + row])
            text = text.replace(" ", space) if text.isascii() else text.encode().decode("latin-1").translate(characters)
            ids = np.array([t.id for t in tokenize(text)], np.uint32)
            starts, raw = (4 * np.flatnonzero(spaced[ids])).tolist(), ids.tobytes()
            out += [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)])]
        return out

    encoder = TextEncoder(vocabulary.added, lambda t: array("I", encode(t, add_special_tokens=False).ids).tobytes(), words)
    encoder.pieces.limit, encoder.together = remembered, together
    del vocabulary
    give_back()
    return encoder


def vocabulary_size(path: str) -> int:
    return Vocabulary(path).size
