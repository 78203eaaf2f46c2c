import numpy as np
import pytest

from designlake.llm import language


def plain_grams(t):
    return [[t[i : i + k] + "\0" * max(0, i + k - len(t)) for i in range(len(t))] for k in range(1, language.ORDERS + 1)]


def bucket(g):
    text, first, _ = language.grams([g.rstrip("\0")])
    return int(text[len(g) - 1][first[0]])


def test_long_texts_are_read_in_pieces():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcé x"), n)) for n in (0, 1, 7, 50, 23)]
    model = {"names": ["a", "b"], "weights": rng.normal(size=(language.BUCKETS, 2)).astype(np.float32), "bias": np.array([0.1, -0.2]), "temperature": 0.7}
    want = language.scores(texts, model)
    whole = language.document_frequencies(texts)
    keep = language.pieces
    try:
        language.pieces = lambda t: keep(t, 5)
        assert np.allclose(language.scores(texts, model), want)
        assert (language.document_frequencies(texts) == whole).all()
    finally:
        language.pieces = keep
    # against a plain version
    for t, got in zip(texts, want):
        s = np.zeros(2)
        for order in plain_grams(t):
            for g in order:
                s += model["weights"][bucket(g)]
        s = (s / max(1, language.ORDERS * len(t)) + model["bias"]) / model["temperature"]
        e = np.exp(s - s.max())
        assert got == pytest.approx(e / e.sum(), abs=1e-5)


def test_document_frequencies_are_those_of_a_plain_count(spark):
    texts = ["ab", "ba ab", "zz", "ab", "", "x" * 30]
    df = language.document_frequencies(texts)
    want = np.zeros(language.BUCKETS, np.int64)
    for t in texts:
        for b in {bucket(g) for order in plain_grams(t) for g in order}:
            want[b] += 1
    assert (df == want).all()


def test_fit_finds_sparse_weights_and_a_temperature():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcd" if i % 2 else "wxyz"), 30)) for i in range(100)]
    m = language.fit(texts, ["p" if i % 2 else "q" for i in range(100)], np.ones(language.BUCKETS))
    p = language.scores(["abcdabcd", "wxyzzz"], m)
    assert m["names"] == ["p", "q"] and p[0, 0] > 0.9 and p[1, 1] > 0.9
    assert (m["weights"] == 0).mean() > 0.9 and 0.05 <= m["temperature"] <= 20
