import numpy as np
import xxhash
from convoeval.llm import lm


def test_words_do_not_share_codes():
    words = 300_000
    hashes = np.array([xxhash.xxh64_intdigest(b"w%d" % i) for i in range(words)], np.uint64)
    assert len(np.unique(hashes >> np.uint64(32))) < words  # the four bytes of before
    assert len(np.unique(hashes >> np.uint64(64 - 8 * lm.code_width(words)))) == words
    for v in (2**k + d for k in range(1, 31) for d in (-1, 0, 1)):
        assert v * (v - 1) / 2 < 2.0 ** (8 * lm.code_width(v))
