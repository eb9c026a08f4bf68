"""The fitted operators on small corpora made here, with held-out cases."""

import random
from collections import Counter

import pytest

from foliolake.llm import alignment, languages, naivebayes, noise, pagetext, pairs, sentences

PARTS = ["pump", "valve", "sensor", "filter", "spring", "clutch"]
TEIL = {"pump": "die Pumpe", "valve": "das Ventil", "sensor": "der Sensor", "filter": "der Filter", "spring": "die Feder", "clutch": "die Kupplung"}


def en(rnd):
    a, b = rnd.choice(PARTS), rnd.choice(PARTS)
    return rnd.choice([f"Remove the {a} and keep it in a dry place.", f"If the {a} makes unusual noise, replace the {b} without delay.", f"See Fig. {rnd.randint(1, 30)} for the {a}, which needs approx. {rnd.randint(1, 300)} mm of space."]), a, b


def book(rnd, n):
    for _ in range(n):
        items = [en(rnd)[0] for _ in range(4)]
        yield "\n".join(f"- {x}" for x in items) + "\n\n" + " ".join(en(rnd)[0] for _ in range(4))


@pytest.fixture(scope="module")
def corpus():
    return list(book(random.Random(1), 250))


def test_furniture():
    title = "Pump and Filter: Handbook"
    lines = [title + " | 7", "Text about the pump and", "filter.", "", "8 / 20", "P U M P   A N D   F I L T E R :   H A N D B O O K", "312", "Pumр and Fi1ter: Handb0ok", "— 7 —"]
    assert pagetext.furniture(lines, title, 7) == ["header", None, None, None, "page_number", "header", None, "header", "page_number"]
    assert pagetext.furniture([], None, None) == [] and pagetext.furniture([" ", ""], None, None) == [None, None]
    assert pagetext.box_furniture("7", None, 20) == "page_number" and pagetext.box_furniture("7", None, 500) is None


def test_noise(corpus):
    editor = noise.fit_editor(corpus)
    scanner = noise.Scanner(editor)
    find = lambda text: {i: sorted(k) for i, k in scanner.lines(text, [None] * (text.count("\n") + 1)).items() if k}
    assert find("Remove the pump and keep it in a dry place.") == {}
    assert find("Rernove the purnp and kccp it in a dry p1ace.") == {0: ["char"]}
    assert find("Remove the va-\nlve and keep it in a dry place.") == {0: ["hyphen"]}
    assert find("Remove the pump KS-\n1204 and keep it.") == {}
    assert find("") == {} and find("\n\n") == {}
    fixed = noise.repair("Pump Book\nRemove the va-\nlve and kccp it in a dry\nplace.\n7", "Pump Book", 7, scanner)
    assert fixed == "Remove the valve and keep it in a dry place."


def test_noise_held_out(corpus):
    rnd = random.Random(9)
    scanner = noise.Scanner(noise.fit_editor(corpus))
    hits = false = total = 0
    for text in book(rnd, 60):
        lines = text.split("\n")
        bad = set()
        for i, s in enumerate(lines):
            at = [k for k, c in enumerate(s) if c in "elos" and k > 2]
            if at and rnd.random() < 0.4:
                k = rnd.choice(at)
                lines[i] = s[:k] + {"e": "c", "l": "1", "o": "0", "s": "5"}[s[k]] + s[k + 1 :]
                bad.add(i)
        found = {i for i, k in scanner.lines("\n".join(lines), [None] * len(lines)).items() if "char" in k}
        hits, false, total = hits + len(found & bad), false + len(found - bad), total + len(bad)
    assert hits >= 0.9 * total and false <= 0.03 * total


def test_sentences(corpus):
    model = sentences.fit_model([(t, None, None) for t in corpus])
    seg = sentences.Segmenter(model)
    cut = lambda t: [t[a:b] for a, b in sentences.page_units(t, None, None, seg)]
    text = "See Fig. 4 for the pump, which needs approx. 50 mm of space. Remove the valve and keep it in a dry place."
    assert cut(text) == [text[:60], text[61:]]
    assert cut("1) Remove the pump and keep it in a dry place.\n2) Remove the valve and keep it in a dry place.") == ["Remove the pump and keep it in a dry place.", "Remove the valve and keep it in a dry place."]
    assert cut("") == [] and cut(" \n ") == []
    wrapped = "If the pump makes unusual noise, replace\nthe valve without delay. Remove the pump\nand keep it in a dry place."
    assert cut(wrapped) == [wrapped[:65], wrapped[66:]]


def test_languages_die_out():
    rnd = random.Random(3)
    rows = [(en(rnd)[0] * 2, "en" if i % 5 else rnd.choice(["de", "nl", None])) for i in range(300)]
    rows += [(f"Falls {TEIL[rnd.choice(PARTS)]} ungewöhnliche Geräusche macht, ersetzen Sie {TEIL[rnd.choice(PARTS)]} unverzüglich.", "de" if i % 6 else "nl") for i in range(200)]
    nb = naivebayes.fit(rows, ["en", "de", "nl"])
    assert nb.prior[2] < -20
    ll = nb.many([naivebayes.clean("Remove the clutch."), naivebayes.clean("Ersetzen Sie die Feder.")])
    assert ll.argmax(axis=1).tolist() == [0, 1]
    assert nb.many([]).shape == (0, 3)
    codes = naivebayes.label_codes([("de", "deu", "German"), ("zh", "zho", "Chinese")])
    assert [naivebayes.normal_label(x, codes) for x in ("DE", "de-AT", "German", "ger", "auto", None, "", "zh_CN")] == ["de", "de", "de", "de", None, None, None, "zh"]


def test_pairs():
    rnd = random.Random(4)
    rows = []
    for _ in range(600):
        s, a, b = en(rnd)
        rows.append((f"Falls {TEIL[a]} {rnd.randint(1, 99)} Geräusche macht, ersetzen Sie {TEIL[b]} unverzüglich.", "de", s, "en"))
    rows += [(f"Cambie {rnd.choice(('la bomba', 'el filtro', 'la junta', 'el eje', 'el muelle'))}, que hace {rnd.choice(('ruido', 'calor', 'humo', 'polvo'))}, y guarde la pieza en {rnd.choice(('un lugar seco', 'la caja', 'el taller', 'otra sala'))}.", "es", en(rnd)[0], "en") for _ in range(200)]
    m = pairs.fit_model(rows, ["en", "de", "es"])
    src = "Falls die Pumpe 7 Geräusche macht, ersetzen Sie das Ventil unverzüglich."
    cases = [("​", "empty"), ("[ ]", "empty"), ("I cannot translate this text.", "refusal"), (src.upper(), "copy"), (src + " " + src, "copy"), ("Cambie la bomba y guarde la pieza en un lugar seco.", "language"), ("If the pump makes unusual noise, replace the", "truncated"), ("If the pump makes unusual noise, replace the valve without delay.", None)]
    assert [d for d, _ in m.defects([src] * len(cases), [t for t, _ in cases], ["en"] * len(cases))] == [d for _, d in cases]
    assert m.defects(["KS-12"], ["KS-12"], ["en"]) == [(None, "")] and m.defects([], [], []) == []


def test_alignment():
    rnd = random.Random(6)
    words = lambda s: [w for w in s.replace(".", " .").split()]
    de = {"Remove": "Entfernen", "keep": "lagern", "dry": "trocken", "place": "Ort", "noise": "Lärm", "replace": "ersetzen", "unusual": "seltsam", "space": "Raum"} | {k: v.split()[1] for k, v in TEIL.items()}
    tr = lambda s: " ".join(de.get(w, w if w[0].isdigit() else "z" + w[:2]) for w in words(s))
    pages = []
    for _ in range(150):
        src = [en(rnd)[0] for _ in range(6)]
        pages.append((src, [tr(s) for s in src], "xx"))
    lex = alignment.fit_lexicon(pages)
    good = total = 0
    for _ in range(40):
        src = [en(rnd)[0] for _ in range(7)]
        if len(set(src)) < 7:
            continue
        tgt = [tr(s) for s in src]
        want = {(i, i) for i in range(7)}
        # an omission, and two swapped neighbours
        del tgt[3]
        want = {(i, j if j < 3 else j - 1) for i, j in want if i != 3}
        tgt[0], tgt[1] = tgt[1], tgt[0]
        want = {(i, {0: 1, 1: 0}.get(j, j)) for i, j in want}
        got = set(alignment.align(src, tgt, "xx", lex))
        good, total = good + len(got & want), total + len(got | want)
    assert good >= 0.85 * total
    assert alignment.align([], ["a"], "xx", lex) == [] and alignment.align(["a"], [], "xx", lex) == []


def test_language_queries_take_nulls(spark):
    pages = spark.createDataFrame([(1, 1, None, None, None, None, None), (2, None, "xx", "p.jpg", "Remove the pump.", None, None), (3, 1, "de", "p.de.jpg", " ", "t", 3)], "page_id long, project_id long, detected_language string, original_image_path string, ocr_text string, title string, page_number int")
    rnd = random.Random(3)
    langs = ["en", "de"]
    nb = spark.sparkContext.broadcast(naivebayes.fit([(en(rnd)[0], "en") for _ in range(50)] + [("Ersetzen Sie die Pumpe.", "de")] * 30 + [("Das Ventil ist warm und trocken.", "de")] * 20, langs))
    model = spark.sparkContext.broadcast(sentences.fit_model([(t, None, None) for t in book(rnd, 20)]))
    projects = spark.createDataFrame([(1, 5, "en"), (2, None, None)], "project_id long, user_id long, source_language string")
    codes = {"en": "en", "de": "de"}
    seen = languages.evidence(pages, model, nb, codes)
    d = languages.decided(seen, languages.host_priors(seen, projects, langs), langs)
    rows = languages.mislabelled(d, projects, codes).collect()
    assert [(r.rec_kind, r.rec_id, r.lang) for r in rows] == [("page", 2, "en")]
    empty = languages.evidence(pages.limit(0), model, nb, codes)
    assert languages.mislabelled(languages.decided(empty, languages.host_priors(empty, projects, langs), langs), projects, codes).count() == 0
    # a short text of both languages goes where reliable labels, or address suffixes, say
    german = [f"Falls {TEIL[rnd.choice(PARTS)]} {w} macht, ersetzen Sie {TEIL[rnd.choice(PARTS)]}." for w in ("Lärm", "Rauch", "Staub", "Licht") for _ in range(12)]
    nb = spark.sparkContext.broadcast(naivebayes.fit([(en(rnd)[0], "en") for _ in range(60)] + [(t, "de") for t in german], langs))
    many = [(i, i, "de" if i % 2 else "en", f"x.{'de' if i % 2 else 'en'}.jpg", "Ersetzen Sie die Pumpe." if i % 2 else "Remove the pump and keep it in a dry place.", None, None) for i in range(40)]
    for label, path, want in (("de", None, "de"), ("en", None, "en"), (None, "p.de.jpg", "de"), (None, "p.en.jpg", "en")):
        some = spark.createDataFrame([*many, (99, None, label, path, "Жщъ", None, None)], pages.schema)
        seen = languages.evidence(some, model, nb, codes)
        odds = languages.reliability(seen)
        assert min(odds) > 2
        flat = spark.createDataFrame([(99, [0.0, 0.0])], "project_id long, prior array<float>")
        assert [r.lang for r in languages.decided(seen, flat, langs).filter("page_id = 99").collect()] == [want]


def test_noise_and_units_in_spark(spark, corpus):
    editor = spark.sparkContext.broadcast(noise.fit_editor(corpus))
    rec = spark.createDataFrame([("page", 1, None, None, None, None), ("page", 2, "Book\nRernove the pump.\n\n", "Book", 1, None), ("text_box", 3, "7", "Book", None, 20), ("text_box", 3, "7", "Book", None, 20), ("text_box", 4, "", None, None, None)], "rec_kind string, rec_id long, text string, title string, number int, y int")
    rows = sorted(tuple(r) for r in noise.find_noise(rec, editor).distinct().collect())
    assert rows == [("page", 2, 1, "header"), ("page", 2, 2, "char"), ("text_box", 3, 1, "page_number")]
    assert noise.find_noise(rec.limit(0), editor).count() == 0
    assert noise.repaired(rec, editor).count() == 5
    model = spark.sparkContext.broadcast(sentences.fit_model([(t, None, None) for t in corpus]))
    pages = spark.createDataFrame([(1, None, None, None), (2, "x " * 20_000, None, 1), (3, "Remove the pump.", "t", 2)], "page_id long, ocr_text string, title string, page_number int")
    assert sentences.unit_starts(pages, model).filter("page_id = 3").count() == 1


def test_broken_pairs_in_spark(spark):
    rnd = random.Random(8)
    rows = [(en(rnd)[0], "en", f"Ersetzen Sie {TEIL[rnd.choice(PARTS)]} unverzüglich.", "de") for _ in range(300)] + [("Valve", "en", "Ventil", "de")] * 20
    m = spark.sparkContext.broadcast(pairs.fit_model(rows, ["en", "de"]))
    data = [("text_box", i, "Motor", "Motor", "de") for i in range(10)] + [("text_box", 20, "Valve", "Valve", "de"), ("text_box", 20, "Valve", "Valve", "de"), ("table_cell", 21, "Valve", "Ventil", "de"), ("table_cell", 22, "Valve", "Ventil", "de"), ("text_box", 30, " ", "x", "de"), ("text_box", 31, "x", None, "de"), (None, 32, "Valve", " ", None)]
    df = spark.createDataFrame([(*r, "c", "d") for r in data], "rec_kind string, rec_id long, text string, translation string, target string, stem string, defect string")
    got = sorted((r.rec_id, r.defect) for r in pairs.broken_pairs(df, m).collect())
    assert got == [(20, "copy"), (32, "empty")]
    assert pairs.broken_pairs(df.limit(0), m).count() == 0


def test_very_long_texts(corpus):
    rnd = random.Random(12)
    src = [en(rnd)[0] + f" Nr. {i}" for i in range(900)]
    links = alignment.align(src, src[:400] + src[420:], "xx", alignment.Lexicon())
    good = sum(src[i] == (src[:400] + src[420:])[j] for i, j in links)
    assert good >= 0.95 * 880
    nb = naivebayes.fit([(en(rnd)[0], "en") for _ in range(60)], ["en", "de"])
    long = "word " * 100_000
    assert nb.many(["", long, "a"]).shape == (3, 2)
    model = sentences.fit_model([(t, None, None) for t in corpus])
    assert len(sentences.page_units("Remove the pump and keep it in a dry place. " * 5_000, None, None, sentences.Segmenter(model))) == 5_000
    scanner = noise.Scanner(noise.fit_editor(corpus))
    assert scanner.lines("x" * 1_000_000 + "\n" + "pump " * 100_000, [None, None]) == {}


def test_noise_in_long_unspaced_runs():
    rnd = random.Random(5)
    parts = ["ปิดวาล์ว", "ถอดตัวกรอง", "ตรวจสอบสปริง", "เปลี่ยนคลัตช์", "ทำความสะอาด", "แสดงสัญญาณ", "เตือนผู้ใช้", "ตลับลูกปืน"]
    run = lambda n: "".join(rnd.choice(parts) for _ in range(n))
    editor = noise.fit_editor([" ".join(run(2) for _ in range(12)) for _ in range(400)])
    scanner = noise.Scanner(editor)
    for n in (4, 6, 20, 200):
        right = run(n) + "ตลับลูกปืน" + run(n)
        assert len(right) > 48 and scanner.lines(right, [None]) == {}
        at = right.index("ตลับลูกปืน", len(right) // 3)
        bad = right[:at] + "ค" + right[at + 1 :]
        assert editor.edits(bad) == ((at, at + 1, "ต"),)
        assert scanner.lines("ปิดวาล์ว\n" + bad, [None, None]) == {1: {"char"}}
        assert noise.repair(bad, None, None, scanner) == right


def test_lexicon_of_all_pages(spark):
    rnd = random.Random(14)
    rare = {"remove": "zor", "pump": "zup", "valve": "zav", "spring": "zir"}
    pages = []
    for i in range(1_900):
        lang, word = ("yy", rare.__getitem__) if i % 190 == 0 else ("xx", "x".__add__)
        src = [[rnd.choice(list(rare)) for _ in range(3)] + [str(100 * k + rnd.randint(10, 99))] for k in range(1, 4)]
        pages.append((i, lang, [0, 20, 40], [" ".join(s) for s in src], [0, 20, 40], [" ".join(w if w.isdigit() else word(w) for w in s) for s in src]))
    seen = spark.createDataFrame(pages, "page_id long, target string, a_starts array<int>, a array<string>, b_starts array<int>, b array<string>")
    lexicon = alignment.fit_lexicon_on(seen).value
    assert {t: max(s, key=s.get) for t, s in lexicon.rows("yy").items()} == {v: k for k, v in rare.items()}
    # every page is counted: the background is that of all sentences
    words = [w for p in pages if p[1] == "xx" for s in p[5] for w in s.split() if not w.isdigit()]
    assert lexicon.background["xx"] == pytest.approx({w: words.count(w) / len(words) for w in set(words)})
    local = alignment.fit_lexicon([(p[3], p[5], p[1]) for p in pages])
    assert lexicon.rows("xx")["xpump"] == pytest.approx(local.rows("xx")["xpump"])
    assert alignment.aligned(seen, alignment.fit_lexicon_on(seen)).count() == 3 * 1_900
    assert alignment.fit_lexicon_on(seen.limit(0)).value.packed == {}


def test_alignment_reaches_all_sources():
    rnd = random.Random(15)
    src = [f"{rnd.choice(PARTS)} Nr. {i}" for i in range(700)]
    for kept in ([*range(20), *range(560, 680)], [*range(60), *range(450, 700)]):  # long omissions
        links = alignment.align(src, [src[i] for i in kept], "xx", alignment.Lexicon())
        assert sum(i == kept[j] for i, j in links) >= 0.95 * len(kept)


def test_both_decodings_are_the_same():
    import numpy as np

    rnd = np.random.default_rng(16)
    for n, m in ((1, 4), (2, 3), (3, 5), (9, 12), (25, 30)):
        for scale in (1.0, 4.0):
            for _ in range(10):
                e = rnd.normal(-1.0, scale, (m, sum(min(alignment.SPAN, n - i) for i in range(n))))
                at = int(rnd.integers(0, n + 1))
                assert alignment.decode_long(e, n, at) == alignment.decode(e, n, at)


def test_pairs_of_unknown_projects(spark, tmp_path):
    from foliolake.llm import queries

    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    save("projects", [(1, "de", "en")], "project_id long, target_language string, source_language string")
    save("book_pages", [(5, 1), (6, None), (7, 99)], "page_id long, project_id long")
    save("text_boxes", [(10, 1, "Valve", "Ventil"), (11, None, "Valve", " "), (12, 99, "Valve", "Valve"), (13, 1, None, "x")], "box_id long, project_id long, text string, translation string")
    save("table_cells", [(20, 5, "Pump", "Pumpe"), (21, 6, "Pump", ""), (22, 7, "Pump", "x"), (23, None, "Pump", "x"), (24, 98, "Pump", "x")], "cell_id long, page_id long, text string, translation string")
    got = {r.rec_id: (r.target, r.label) for r in queries.text_pairs(spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys((11, 12, 21, 22, 23, 24), (None, None)) | dict.fromkeys((10, 20), ("de", "en"))
    rows = [(en(random.Random(i))[0], "en", "Ersetzen Sie die Pumpe.", "de") for i in range(50)] + [("Valve", None, "Ventil", None)]
    model = spark.sparkContext.broadcast(pairs.fit_model(rows, ["en", "de"]))
    assert {(r.rec_id, r.defect) for r in pairs.broken_pairs(queries.text_pairs(spark, str(tmp_path)), model).collect()} >= {(11, "empty"), (12, "copy"), (21, "empty")}


def test_merges_of_four_and_thousand_sentences(monkeypatch):
    rnd = random.Random(17)
    src = [f"{rnd.choice(PARTS)} Nr. {1000 + i} {rnd.choice(PARTS)}" for i in range(1_000)]
    # omissions, additions, a moved block and merges of up to four
    order = [*range(0, 200), *range(600, 700), *range(200, 600), *range(760, 1_000)]
    tgt, want, at = [], set(), 0
    while at < len(order):
        k = rnd.choice((1, 1, 1, 1, 2, 3, 4))
        span = order[at : at + k]
        span = span[: next((x for x in range(1, len(span)) if span[x] != span[x - 1] + 1), len(span))]
        want |= {(i, len(tgt)) for i in span}
        tgt.append(" ".join(src[i] for i in span))
        if rnd.random() < 0.03:
            tgt.append("Nothing of the kind stands in the source.")
        at += len(span)
    got = set(alignment.align(src, tgt, "xx", alignment.Lexicon()))
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)
    monkeypatch.setattr(alignment, "PATH_CELLS", 1_000_000)  # in blocks of 200 targets
    blocks = set(alignment.align(src, tgt, "xx", alignment.Lexicon()))
    assert len(blocks & want) >= 0.95 * len(want)
    fours = {j for j in range(len(tgt)) if sum(y == j for _, y in want) == 4}
    assert fours and sum({p for p in got if p[1] == j} == {p for p in want if p[1] == j} for j in fours) >= 0.9 * len(fours)


def test_lexicon_in_blocks(spark, monkeypatch):
    rnd = random.Random(18)
    words = ["remove", "pump", "valve", "spring", "clutch", "clean", "oil"]
    pages = []
    for i in range(400):
        src = [f"{' '.join(rnd.sample(words, 3))} {100 * k + rnd.randint(10, 99)}" for k in range(1, 5)]
        pages.append((i, "xx", [0] * 4, src, [0] * 4, [" ".join(w if w.isdigit() else "x" + w for w in s.split()) for s in src]))
    seen = spark.createDataFrame(pages, "page_id long, target string, a_starts array<int>, a array<string>, b_starts array<int>, b array<string>")
    whole = alignment.fit_lexicon_on(seen).value
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", 60)
    parts = alignment.fit_lexicon_on(seen).value
    best = lambda lex: {t: max(s, key=s.get) for t, s in lex.rows("xx").items()}
    assert best(parts) == best(whole) == {"x" + w: w for w in words}


def test_unpunctuated_runs_and_long_stretches():
    import numpy as np

    rnd = random.Random(19)
    things = {"ja": ["ポンプ", "弁", "軸", "ばね", "管"], "zh": ["水泵", "阀门", "轴", "弹簧", "油管"], "th": ["ปั๊ม", "วาล์ว", "เพลา", "สปริง", "ท่อ"]}
    patterns = {"ja": ["{a}を外して乾いた場所に置きます。", "次に{a}と{b}を点検します。", "最後に{a}の温度は{n}度です。"], "zh": ["请取下{a}并放在干燥处。", "然后检查{a}和{b}。", "最后{a}的温度为{n}度。"], "th": ["ถอด{a}แล้วเก็บไว้ในที่แห้ง", "จากนั้นตรวจสอบ{a}และ{b}", "สุดท้าย{a}มีอุณหภูมิ{n}องศา"]}

    def one(lang):
        return rnd.choice(patterns[lang]).format(a=rnd.choice(things[lang]), b=rnd.choice(things[lang]), n=rnd.randint(1, 99))

    pages = ["\n".join(f"- {one(lang)}" for _ in range(6)) for lang in patterns for _ in range(150)]
    seg = sentences.Segmenter(sentences.fit_model([(t, None, None) for t in pages]))
    hits = found = total = 0
    for lang in patterns:
        for n in (4, 60):  # few sentences, and a stretch of many gaps
            for _ in range(10):
                units = [one(lang).rstrip("。") for _ in range(n)]
                glue = " " if lang == "th" else ""
                text = glue.join(units)
                want, at = set(), 0
                for u in units:
                    want.add(at)
                    at += len(u) + len(glue)
                got = {a for a, _ in sentences.page_units(text, None, None, seg)}
                hits, found, total = hits + len(got & want), found + len(got), total + len(want)
    assert hits >= 0.95 * total and hits >= 0.95 * found
    model = seg.model
    words = tuple("次にポンプと弁を点検します最後に軸の温度は0度です次に")
    for gaps in ((4, 9), (3, 4, 5, 6, 7, 14, 20), (2, 15)):
        odds = [rnd.uniform(-3, 3) for _ in gaps]
        assert np.allclose(model.linear(words, gaps, odds), model.posteriors(words, gaps, odds))


def test_hot_projects_are_salted(spark, monkeypatch):
    from foliolake import session

    pages = spark.range(4_000).selectExpr("id as page_id", "if(id % 10 > 0, 1, id) as project_id", "'t' as ocr_text")
    titles = spark.createDataFrame([(i, f"title {i}") for i in range(0, 4_000, 10)] + [(1, "hot")], "project_id long, title string")
    want = sorted(noise.with_titles(pages, titles, "page_id").select("page_id", "title").collect())
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = noise.with_titles(pages, titles, "page_id")
        assert sorted(joined.select("page_id", "title").collect()) == want
        sizes = sorted(len(x) for x in joined.rdd.glom().collect())
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_refusals_in_other_wordings():
    rnd = random.Random(20)
    rows = [(f"Falls {TEIL[rnd.choice(PARTS)]} {rnd.randint(1, 99)} Lärm macht, ersetzen Sie {TEIL[rnd.choice(PARTS)]}.", "de", en(rnd)[0], "en") for _ in range(500)]
    # right renderings that apologise
    rows += [("Leider kann der Motor hier nicht repariert werden.", "de", f"Unfortunately, the {rnd.choice(PARTS)} can't be repaired here, see page {rnd.randint(1, 9)}.", "en") for _ in range(60)]
    starts, cores, ends = ["Sorry, but ", "Regrettably, ", "My apologies: ", ""], ["I cannot translate this text", "I am not able to translate such content", "this request can't be completed as it breaks the rules", "I must decline this request"], [".", " because the image is unreadable.", "; please send more context."]
    rows += [("Die Pumpe ist warm.", "de", rnd.choice(starts) + rnd.choice(cores) + rnd.choice(ends), "en") for _ in range(60)]
    m = pairs.fit_model(rows, ["en", "de"])
    src = "Falls die Pumpe Lärm macht, ersetzen Sie das Ventil."
    unlisted = ["Regrettably, such content breaks the rules.", "Sorry, but the image is unreadable, please send another.", "Regrettably, this can't be completed because the image is unreadable."]
    assert not any(pairs.refuses(t, "en") for t in unlisted)
    assert [d for d, _ in m.defects([src] * 3, unlisted, ["en"] * 3)] == ["refusal"] * 3
    assert m.defects([src], ["Unfortunately, the pump can't be repaired here."], ["en"])[0][0] is None
    # in the source's language, and quoting a number of the text
    assert m.defects(["Falls die Pumpe 17 Lärm macht, ersetzen Sie das Ventil."], ["Sorry, but I am not able to translate such content (17)."], ["en"])[0][0] == "refusal"


def test_small_wrong_labels_do_not_remove_their_language():
    # as found in tables poor in Thai: 382 pieces labelled vi, explained by th in 45 of 100 cases only; but vi explains th as well
    de, en, th, vi = range(4)
    near = Counter({(vi, (False, False, True, False)): 172, (vi, (False,) * 4): 210})
    near += Counter({(th, (False, False, False, True)): 5_832, (th, (False,) * 4): 1_944, (de, (False,) * 4): 33_273, (en, (True, False, False, False)): 3_000, (en, (False,) * 4): 23_463})
    alive, dead = naivebayes.wrong_classes(near)
    assert alive == [vi, th, en, de] and dead == {vi}
    # a small language of which many labels are wrong is one nevertheless, as it explains no other's texts
    near = Counter({(th, (True, False, False, False)): 600, (th, (False,) * 4): 400, (de, (False,) * 4): 33_273})
    assert naivebayes.wrong_classes(near) == ([th, de], set())


def test_languages_held_out():
    rnd = random.Random(21)
    de = lambda: f"Falls {TEIL[rnd.choice(PARTS)]} {rnd.choice(('Lärm', 'Rauch', 'Staub'))} macht, ersetzen Sie {TEIL[rnd.choice(PARTS)]} sofort."
    es = lambda: f"Cambie {rnd.choice(('la bomba', 'el filtro', 'la junta', 'el muelle'))} y guarde la pieza en {rnd.choice(('un lugar seco', 'la caja', 'el taller'))}."
    make = {"en": lambda: en(rnd)[0], "de": de, "es": es}
    langs = sorted(make)
    # a tenth of the labels are wrong
    nb = naivebayes.fit([(make[x](), x if rnd.random() < 0.9 else rnd.choice(langs)) for x in langs for _ in range(150)], langs)
    seg = sentences.Segmenter(sentences.fit_model([("\n".join(f"- {make[x]()}" for _ in range(5)), None, None) for x in langs for _ in range(60)]))
    hits = found = total = 0
    for _ in range(60):
        parts = [(x, rnd.randint(1, 4)) for x in rnd.sample(langs, rnd.randint(1, 3))]
        text, want = "", set()
        for x, n in parts:
            want.add((len(text), x))
            text += "".join(make[x]() + "\n" for _ in range(n))
        units = sentences.page_units(text, None, None, seg)
        path = languages.decode(languages.unit_likelihoods(text, units, nb), nb.prior * 0)
        got = {(units[i][0], langs[k]) for i, k in enumerate(path) if i == 0 or path[i - 1] != k}
        hits, found, total = hits + len(got & want), found + len(got), total + len(want)
    assert hits >= 0.95 * total and hits >= 0.95 * found


def test_sentence_model_of_all_pages(spark):
    rows = [(k, f"- Part w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100 % 10]}{'efghijklmn'[k // 1000]} is warm.\n- Part is cold.\n- 泵已停止运转。", None, k % 50) for k in range(9_000)]
    rows.append((9_000, "\n".join("- Zeppelin units are long." for _ in range(1_000)), None, None))  # over 20,000 characters
    pages = spark.createDataFrame([*rows, (9_001, None, None, None)], "page_id long, ocr_text string, title string, page_number int").repartition(6)
    got = sentences.fit_on(pages).value
    want = sentences.fit_model([r[1:] for r in rows])
    assert got.ctx.keys() == want.ctx.keys() and got.size == want.size
    assert all(got.ctx[h][1].keys() == x.keys() and abs(got.ctx[h][0] - r) < 1e-9 for h, (r, x) in want.ctx.items())
    assert sum(len(w) == 5 and w[0] == "w" for w in got.ctx[()][1]) == 9_000 and "Zeppelin" in got.ctx[()][1]
    both = alignment.fit_on(pages.withColumn("translated_text", pages.ocr_text)).value
    assert len(both.ctx[()][1]) == len(got.ctx[()][1])


def test_work_is_done_once(corpus):
    model = sentences.fit_model([(t, None, None) for t in corpus])
    seg, calls, plain = sentences.Segmenter(model), [], model._lp
    model._lp = lambda *x: calls.append(x) or plain(*x)
    units = [seg.units(t, [None] * (t.count("\n") + 1)) for t in corpus[:40]]
    assert calls and len(calls) == len(set(calls))
    model.known.clear(), model.cache.clear()
    assert units == [sentences.Segmenter(model).units(t, [None] * (t.count("\n") + 1)) for t in corpus[:40]]
    lexicon = alignment.Lexicon({"de": {"eins": {"one": 0.5}, "zwei": {"two": 0.25, "one": 0.125}}})
    source = [alignment.tokens(x) for x in ("one two", "two two six")]
    for _ in range(2):  # nothing of a page stays
        assert lexicon.masses("de", ["zwei", "drei", "eins"], source).tolist() == [[0, 0.375, 0.5], [0, 0, 0], [0, 0.5, 0]]
    assert (lexicon.slots["de"] == -1).all()


def test_editor_of_all_pages(spark):
    rnd = random.Random(3)
    texts = list(book(rnd, 300))
    rows = [(k, k % 3, k % 9, f"Pump Book\n{texts[k % 300]}\nPart q{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100 % 10]}{'efghijklmn'[k // 1000]} is warm.\n{k % 9}") for k in range(10_000)]
    rows.append((10_000, 0, None, "\n".join("Zeppelin units are long." for _ in range(1_000))))  # over 20,000 characters
    pages = spark.createDataFrame([*rows, (10_001, 1, 1, None)], "page_id long, project_id long, page_number int, ocr_text string")
    projects = spark.createDataFrame([(0, "Pump Book"), (1, None)], "project_id long, title string")
    got = noise.fit_on(pages, projects).value
    assert got.counts["Zeppelin"] == 1_000 and sum(len(w) == 5 and w[0] == "q" for w in got.counts) == 10_000
    want = noise.fit_editor([r[3] for r in rows], [("Pump Book" if r[1] == 0 else None, r[2]) for r in rows])
    assert got.counts == want.counts and got.w == want.w and got.furniture.w == want.furniture.w
    assert got.furniture(["Pump Book", "Remove the pump.", "7"], "Pump Book", 7) == ["header", None, "page_number"]


def test_languages_of_all_pages(spark):
    import numpy as np

    rnd = random.Random(8)
    de = ["Die Pumpe ist warm und trocken.", "Ersetzen Sie das Ventil ohne Verzug.", "Der Filter liegt neben dem Sensor.", "Bitte lesen Sie das Handbuch der Kupplung."]
    rows = [(k, en(rnd)[0] + " " + en(rnd)[0], None, k, "en") if k % 2 else (k, f"{rnd.choice(de)} {rnd.choice(de)}", None, k, "de" if k % 10 else "nl" if k % 20 else "en") for k in range(600)]
    rows.append((600, "\n".join("Zxqv zxqv wkkj." for _ in range(1_500)), None, 1, "de"))  # over 20,000 characters
    langs, codes = ["de", "en", "nl"], {x: x for x in ("de", "en", "nl")}
    pages = spark.createDataFrame([*rows, (601, None, None, None, None)], "page_id long, ocr_text string, title string, page_number int, detected_language string").repartition(5)
    got = languages.fit_on(pages, langs, codes).value
    want = languages.fit_languages([r[1:] for r in rows], langs, codes)
    assert np.allclose(got.prior, want.prior, atol=1e-5) and np.allclose(got.table, want.table, atol=1e-4)
    assert got.many([naivebayes.clean("Zxqv wkkj")])[0].any() and got.prior[2] < -20


def test_pairs_model_of_all_rows(spark, tmp_path):
    import numpy as np

    from foliolake.llm import queries

    rnd = random.Random(13)
    rows = []
    for k in range(600):
        s, a, b = en(rnd)
        no = f"I am sorry, but I will not translate passage {'abcdefgh'[k % 8]} of the {a}."
        rows.append((s, "en" if k % 9 else "de", no if k % 20 == 0 else f"Ersetzen Sie {TEIL[a]} oder {TEIL[b]} unverzüglich{'' if k % 7 else ', und'}", "de" if k % 11 else None))
    rows += [("Valve", "en", "Ventil", "de")] * 9 + [("KS-12", None, " ", "de")]
    rows += [("Replace the pump.", "en", "Ersetzen Sie die Pumpe oder", "de"), ("Replace the filter.", "en", "Ersetzen Sie den Fil", "de")]
    rows += [("The valve. " * 500, "en", "Wxq wxqz. " * 500, "de")] * 2  # over 4,000 characters
    names = {x: x for x in ("de", "en")}
    df = spark.createDataFrame([*rows, (None, "en", "x", "de")], "text string, label string, translation string, target string").repartition(5)
    got, want = pairs.fit_on(df, ["de", "en"], names).value, pairs.fit_model(rows, ["de", "en"])
    assert np.allclose(got.nb.prior, want.nb.prior, atol=1e-5) and np.allclose(got.nb.table, want.nb.table, atol=1e-4)
    assert got.words == want.words and got.words["ventil"] == {0}
    assert got.refusals.weights and got.refusals.base == want.refusals.base
    ends = [t.rstrip() for _, _, t, target in rows if t.strip() and target]  # as they are looked up
    assert np.allclose([got.endings.likelihood(t, "de") for t in ends], [want.endings.likelihood(t, "de") for t in ends])
    assert got.endings.all["de"]["wxqz."] == 1_000 and got.endings.end["de"]["wxqz."] == 2
    assert not hasattr(pairs, "SAMPLE_PAIRS")
    # a table of nothing has a model too
    assert pairs.fit_on(df.limit(0), ["de", "en"], names).value.defects(["a"], ["a"], ["de"]) == [("copy", "a")]
    assert "fit_on" in queries.p1_found.__code__.co_names
