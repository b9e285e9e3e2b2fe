import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from convoeval.llm import bpe
from convoeval.llm.encode import library_encoder
from llm_data import awkward_texts, documents
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_and_decoded_texts_are_those_of_the_library(library):
    vocabulary = bpe.Vocabulary(PATH)
    queue, memory = bpe.queue_encoder(vocabulary), library_encoder(PATH)
    rng = random.Random(2)
    parts = [" ", "\n", "\t", "  ", "\n\n", "\r", "\x1c", "\x85", "\xa0", "　", "a", "the", "B", "é", "é", "1", "½"]
    parts += [".", "'s", "'ll", "'", "漢", "😀", "<|endoftext|>", "<|", "_"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(queue.encode(text), np.uint32).tolist() == ids, text
        assert np.frombuffer(memory.encode(text), np.uint32).tolist() == ids, text
        assert vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_stale_entries_of_the_queue_are_skipped():
    vocabulary = bpe.Vocabulary(PATH)
    # The library's merges of overlapping equal pairs, leftmost first.
    for word in (b"aaaaaaa", b"ababababab", b"tttthhhee", b"nnnn" * 50):
        assert b"".join(vocabulary.strings[i] for i in vocabulary.merge(word)) == word


def test_memory_of_pieces_is_bounded():
    calls = []
    seen = bpe.Remembered(lambda p: calls.append(p) or p.encode(), limit=2)
    assert [seen[p] for p in "abcab"] == [b"a", b"b", b"c", b"a", b"b"]
    assert len(seen) <= 2 and len(calls) == 5


def test_digests_of_awkward_rows(spark, library):
    expected = Counter()
    for k, t in awkward_texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)]
        expected[(k, len(ids), *digests)] += 1
    out = bpe.encode_decode(documents(spark), PATH)
    assert Counter(map(tuple, out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == expected
    assert bpe.encode_decode(documents(spark, []), PATH).collect() == []
