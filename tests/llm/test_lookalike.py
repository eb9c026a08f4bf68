from foliolake.llm import lookalike as k

SAME = [("Ventil", "Vеntіl"), ("TQ-75", "ＴＱ－７５"), ("ケーブル", "ｹｰﾌﾞﾙ"), ("é", "é"), ("a b", "a b"), ("filtre", "ﬁltre"), ("ab", "a​﻿b"), ("が", "が"), ("MΟ", "MO")]
OTHER = [("a", "A"), ("e", "é"), ("1", "2"), ("a b", "ab"), ("a\nb", "a b"), ("m²", "m2"), ("ー", "一")]


def test_forms(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(SAME + OTHER)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    f = k.consistent_form(k.consistent_form(df, "a", "fa"), "b", "fb").collect()
    assert [r.fa == r.fb for r in sorted(f)] == [True] * len(SAME) + [False] * len(OTHER)
    odd = spark.createDataFrame([(None, "x"), ("", "y")], "text string, form string")
    assert sorted((r.form is None, r.form) for r in k.consistent_form(odd, "text").collect()) == [(False, ""), (True, None)]


def test_pairs(spark):
    rows = [(1, 1, "TQ"), (1, 2, "ＴＱ"), (1, 3, "TQ"), (1, 3, "TQ"), (2, 4, "ＴＱ"), (1, 5, None), (1, 6, ""), (None, 7, "a"), (None, 8, "ａ"), (1, None, "ＴＱ")] + [(3, 100 + i, "same") for i in range(500)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "id long, t long, look string, form string, th int")
    got = {(r.id_a, r.id_b) for r in k.same_look_pairs(df, ["id"], "t", "look").collect()}
    assert got == {(1, 2), (2, 3)}
    assert k.same_look_pairs(df.limit(0), ["id"], "t", "look").count() == 0


def test_classes_against_pairs(spark):
    import random

    rnd = random.Random(3)
    forms = ["Pump", "Рump", "Pu​mp", "Filter", "Fi‌lter", "x", None, ""]
    rows = [(i, rnd.randint(1, 4), rnd.choice(forms), "clash") for i in range(120)] + [(1, 1, "Pump", "clash")]
    df = spark.createDataFrame(rows, "id long, page long, text string, class_id string")
    pairs = {(r.id_a, r.id_b) for r in k.same_look_pairs(df, ["page"], "id", "text").collect()}
    classes = k.same_look_classes(df, ["page"], "id", "text").collect()
    by = {}
    for r in classes:
        by.setdefault((r.page, r.class_id), []).append(r)
    spread = {(a.id, b.id) for rs in by.values() for a in rs for b in rs if a.id < b.id and a.text_id != b.text_id}
    assert spread == {p for p in pairs}
    linked = {r.id: r.links for r in classes}
    assert all(linked[i] == sum(i in p for p in pairs) for i in linked if i != 1)
    assert k.same_look_classes(df.limit(0), ["page"], "id", "text").count() == 0
