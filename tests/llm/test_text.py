import random
import re
import unicodedata

import numpy as np

from millrace.llm import text as T


def plain_words(text):
    folded = "".join(c for c in unicodedata.normalize("NFKC", text) if c not in "​‌‍⁠﻿­").lower()
    return re.findall(r"[^\W_]+", folded)


SAMPLES = ["", None, "One two_three", "ＡＢ ­x​y ﬁne", "你好。世界", "a b c a b c", "\U0001d53d x"]


def test_words():
    assert [T.words(t) for t in SAMPLES] == [plain_words(t) if t else [] for t in SAMPLES]


def test_shingle_sets_are_exact():
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdef", k=rng.randint(0, 40))) for _ in range(300)] + [None, ""]
    hashes, starts = T.distinct_shingles(texts, 3)
    sets = [set(zip(w, w[1:], w[2:], strict=False)) for w in map(T.words, texts)]
    assert np.diff(starts).tolist() == [len(s) for s in sets]
    found = [set(hashes[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    for i in range(0, 300, 7):
        for j in range(0, 300, 11):
            assert len(found[i] & found[j]) == len(sets[i] & sets[j])


def test_long_texts_are_read_alike(monkeypatch):
    texts = ["a b c d", "e f " * 50, None, "g h i"]
    want = T.word_hashes(texts)
    monkeypatch.setattr(T, "LONG_TEXT", 10)
    got = T.word_hashes(texts)
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))
