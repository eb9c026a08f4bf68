"""What p3 works out in fewer steps gives what its plain form gives."""

import random

import pytest

from foliolake.llm import noise, pagetext

WORDS = ["clutch", "housing", "pressure", "Ventil", "Gehäuse", "клапан", "насос", "ポンプ", "点検", "filter", "spring"]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance_to_beginnings():
    rnd = random.Random(1)
    for _ in range(2_000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 80 if rnd.random() < 0.1 else 9))) for _ in range(2))
        sizes = {rnd.randint(0, len(b)) for _ in range(3)}
        assert pagetext.prefix_distance(a, b, sizes) == min(plain_distance(a, b[:k]) for k in sizes)
        d = plain_distance(a, b)
        assert pagetext.distance(a, b, 3) == min(d, 4)


def test_scores_are_those_of_the_features():
    rnd = random.Random(2)
    editor = noise.fit_editor(" ".join(rnd.choice(WORDS) for _ in range(400)) for _ in range(10))
    bad = ["c1utch", "hous1ng", "presssure", "Venti1", "насос", "нас0с", "点倹", "fi1ter", "sprinq", "rn", "ab-c", "клапaн", *WORDS]
    assert any(editor.edits(w) for w in bad)
    for w in bad:
        found = editor.candidates(w)
        want = [editor.score(editor.features(w, c)) for c in found]
        assert editor.scores(w, found) == pytest.approx(want, abs=1e-9)
        assert [s > 0 for s in editor.scores(w, found, 0.0)] == [s > 0 for s in want]


def test_only_mixed_words_are_mended():
    assert noise.plain_form("нacoс-12 и A1 Насос") == "насос-12 и A1 Насос"
