import zstandard
from convoeval.llm import toxicity


def test_bound_of_training_windows_is_an_option(monkeypatch):
    taken = []
    train = zstandard.train_dictionary
    monkeypatch.setattr(zstandard, "train_dictionary", lambda size, windows, **o: taken.append(len(windows)) or train(size, windows, **o))
    texts = [b"".join(b"word %d of text %d " % (j, i) for j in range(60)) for i in range(40)]
    for bound in (10**9, 500):
        toxicity._ordinary_dictionary(texts, toxicity.Options(train_windows=bound, ordinary_bytes=4096))
    assert taken[0] > 1000 and 500 <= taken[1] < 1000
