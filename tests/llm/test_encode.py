"""Texts encoded together, against the library."""

import random
from array import array

import public_tokenizers
from convoeval.llm import encode
from convoeval.llm.encode import library_encoder
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "the", "don't", "x'll", "it'", " ", "  ", "\n", "\n\n", "\n a", "\nfoo.", "\n,", "\t", "　", "\x1c", "\x85", "é", "été.",
    "Ünd\"", "ʼn", "ĳɏ", "ɐɑ", "ªº", "µ", "½a", "aʹ", "İi", "漢字", "1234", "...", "a'|", "x_", "_x", "Ñ$$$", "x.y", "|",
    "<|endoftext|>", "<|endoftext|>,", "a" * 250, "ﬀ", "́",
]


def test_texts_encoded_together_equal_the_library():
    draw = random.Random(1)
    texts = ["".join(draw.choice(PARTS) + draw.choice(["", " ", " ", "\n"]) for _ in range(draw.randrange(12))) for _ in range(3000)]
    library = Tokenizer.from_file(PATH)
    want = [array("I", library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    encoder = library_encoder(PATH)
    assert list(encoder.encode_all(texts)) == want
    encoder.pieces.clear()
    encoder.pieces.limit = 5  # most pieces find no room
    assert list(encoder.encode_all(texts)) == want


def test_new_words_are_not_encoded_one_call_each():
    encoder, calls = library_encoder(PATH), []
    run = encoder.run
    encoder.run = lambda t: calls.append(t) or run(t)
    texts = [" ".join(f"{i}x{j}" for j in range(20)) for i in range(50)]
    assert list(encoder.encode_all(texts)) == [run(t) for t in texts]
    assert len(calls) < 100  # 1,000 new words


def test_a_worker_loads_the_tokenizer_once(monkeypatch):
    loaded = []
    real = encode.Vocabulary
    monkeypatch.setattr(encode, "Vocabulary", lambda path: loaded.append(path) or real(path))
    for text in ("Some words, été.", "Other words, some été!", "Some words, été."):
        (ids,) = encode.library_encoder(PATH).encode_all([text])
        assert array("I", ids).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert len(loaded) <= 1


def test_words_are_looked_up_once_for_many_texts():
    encoder, asked = library_encoder(PATH), []
    texts = [" ".join(f"word{chr(97 + j)}{'!' * (i % 3)}" for j in range(20)) for i in range(500)]
    want = [encoder.run(t) for t in texts]
    encoder.pieces.clear()

    class Counted(type(encoder.pieces)):
        def get(self, *a):
            asked.append(a)
            return super().get(*a)

        def __getitem__(self, *a):
            asked.append(a)
            return super().__getitem__(*a)

    limit, encoder.pieces = encoder.pieces.limit, Counted(encoder.pieces.encode)
    encoder.pieces.limit = limit
    assert list(encoder.encode_all(texts)) == want
    assert len(asked) < 200  # 10,000 words, 60 of them different


def test_the_last_stage_remembers_fewer_words(monkeypatch):
    import corpus_pipeline

    asked = []
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda *a, **k: asked.append(k["remembered"]))
    corpus_pipeline.best_fit_packing(None, None, "")
    assert library_encoder(PATH, asked[0]).pieces.limit == asked[0] < encode.REMEMBERED


def test_arrow_texts_and_slices():
    import pyarrow as pa

    texts = ["one two", "", " lead", "three\nfour, five", "<|endoftext|> six", "été à la", "\n", "x" * 300 + " " + "y" * 300]
    library = Tokenizer.from_file(PATH)
    want = [array("I", library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    encoder = library_encoder(PATH)
    assert list(encoder.encode_all(pa.array(texts))) == want
    assert list(encoder.encode_all(pa.array(texts).slice(3, 4))) == want[3:7]
    assert list(encoder.encode_all(pa.array([], pa.string()))) == []
