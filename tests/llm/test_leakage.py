import random

from hypothesis import given, settings
from hypothesis import strategies as st

from foliolake.llm import leakage


def brute(text, item, words=20, letters=60):
    """All runs by comparing every stretch of the passage, spacing and marks left out."""
    _, lang, passage = item
    s = leakage.stream(text or "")
    parts = [p for p in map(leakage.stream, (passage or "").split()) if p]
    if lang in ("ja", "zh", "th"):
        whole = "".join(parts)
        return any(whole[i : i + letters] in s for i in range(len(whole) - letters + 1))
    return any("".join(parts[i : i + words]) in s for i in range(len(parts) - words + 1))


def test_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = ["pump", "valve", "Größe", "№7", "KS-12", "the", "naïve", "über", "x", "ß", "„quote“", "—"]
    items = [(i, "de", " ".join(rnd.choice(vocab) for _ in range(40))) for i in range(12)] + [(20 + i, "ja", "".join(rnd.choice("あいうえおカキ漢字。、 ") for _ in range(110))) for i in range(6)] + [(50, "en", None), (51, "en", ""), (52, "de", None)]
    items.append((60, "de", items[0][2]))
    docs = ["", None, "nothing"]
    for it in items[:18]:
        p = it[2].split() if it[1] == "de" else list(it[2])
        for n in (12, 19, 20, 25, 40) if it[1] == "de" else (30, 59, 70, 90):
            a = rnd.randint(0, max(0, len(p) - n))
            part = p[a : a + n]
            docs.append("Before! " + (" \n".join(part).upper() if it[1] == "de" else " ".join(part)) + " after.")
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked(df, "doc_id", "text", items).collect()}
    want = {(i, it[0]) for i, t in enumerate(docs) for it in items if brute(t, it)}
    assert got == want and len(want) > 20
    assert leakage.leaked(df.limit(0), "doc_id", "text", items).count() == 0
    assert leakage.leaked(df, "doc_id", "text", []).count() == 0


def test_offsets():
    p = leakage.Passages([(1, "en", " ".join(f"word{i}" for i in range(30)))])
    text = "x. " + ", ".join(f"WORD{i}" for i in range(3, 28)) + " end"
    size, a, b = p.runs(text)[1]
    assert size == 25 and text[a:b].startswith("WORD3") and text[a:b].endswith("WORD27")
    # a part of a word is no word: 19 whole words and half of another
    assert not p.runs("xx " + "Z" + " ".join(f"word{i}" for i in range(4, 24))[1:] + "9")


def test_composition_across_cuts():
    hangul = "\u1112\u1161\u11ab\u1100\u1173\u11af " * 3  # decomposed: the stream composes it
    p = leakage.Passages([(1, "en", " ".join(f"word{i}" for i in range(30)))])
    assert not p.runs(hangul + "xx " + "Z" + " ".join(f"word{i}" for i in range(4, 24))[1:] + "9")
    text = hangul + "cafe\u0301 x. " + ", ".join(f"word{i}" for i in range(3, 28)) + " end"
    size, a, b = p.runs(text)[1]
    assert size == 25 and text[a:b].startswith("word3,") and text[a:b].endswith("word27")


@settings(max_examples=300, deadline=None)
@given(st.text("aé\u0301\u0323\u1100\u1161\u11a8가\u09c7\u09be ﾊﾞﬁ²Ⅳ.ก็า\u0e33", max_size=40))
def test_offsets_are_exact(text):
    s, at, to = leakage.stream_offsets(text)
    assert s == leakage.stream(text)
    assert all(a < b for a, b in zip(at, to)) and at == sorted(at)


def test_more_items_than_one_automaton(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEMS_AT_ONCE", 2)
    items = [(i, "en", " ".join(f"w{i}x{k}" for k in range(25))) for i in range(5)]
    df = spark.createDataFrame([(i, it[2]) for i, it in enumerate(items)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaked(df, "doc_id", "text", items).collect()} == {(i, i) for i in range(5)}
