"""Work of p1 that is done once for equal pairs, and decisions that don't hang on a pair's neighbours."""

import numpy as np

from foliolake.llm import naivebayes, pairs

ROWS = [("Remove the pump from the housing.", "en"), ("Check the valve and the filter.", "en"), ("Ersetzen Sie die Pumpe im Gehäuse.", "de"), ("Prüfen Sie das Ventil und den Filter.", "de")] * 5


def test_likelihoods_are_a_texts_own():
    nb = naivebayes.fit(ROWS, ["en", "de", "nl"], fixed=True)
    texts = [naivebayes.clean(t) for t, _ in ROWS[:4]]
    alone = np.concatenate([nb.many([t]) for t in texts])
    assert np.allclose(nb.many(texts), alone) and np.allclose(nb.many(texts[::-1]), alone[::-1])


def test_equal_pairs_are_decided_once(monkeypatch):
    rows = [("Remove the pump.", "en", "Ersetzen Sie die Pumpe.", "de")] * 3 + [("Check the valve.", "en", "Check the valve.", "de")] * 3
    model = pairs.fit_model(rows, ["en", "de"])
    asked, real = [], model.defects
    monkeypatch.setattr(model, "defects", lambda *x: (asked.append(len(x[0])), real(*x))[1])
    kept: dict = {}
    batch = [(s, t, target) for s, _, t, target in rows]
    want = real(*map(list, zip(*batch, strict=True)))
    assert model.decided(batch, kept) == want and model.decided(batch, kept) == want and asked == [2]


def test_seed_words_by_piece_are_the_pattern():
    texts = ["I can't", "ICH kann das", "mein Text", "Übersetzung", "measure time", "give me more context", "MİR", "mır", "перевод", "Я не могу", "แปลน", "แปล", "我无法", "訳せない", "translating", "requesting", "ſolicitud", "J’ai", ""]
    for words in (pairs._REFUSAL_EN, pairs._REFUSAL, *pairs._REFUSAL_BY.values()):
        assert [words.search(t) for t in texts] == [words.whole.search(t) is not None for t in texts]
