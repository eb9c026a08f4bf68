"""Noise in text from scanned pages: an averaged-perceptron character editor.

For every word the editor weighs, at each place, keeping the characters against replacing,
deleting or inserting some, and at every hyphenated line end joining the lines against leaving
them. Candidates come from the ways glyphs are confused and, for characters seen in no table, from
the vocabulary's neighbours - words with another, one more or one less character; the features say
which operation and pair of glyphs it is and how much more common word and character n-grams become
by it. Line joins are learned from known words, broken at any place, and known compounds, broken at
their hyphen. Weights are averaged over the training steps. Running headers and page numbers are told
by learned page-position features (``pagetext.Furniture``).

The editor is fitted on the words of all pages: word types with their counts, corrupted
by the confusion table to make examples. Least counts grow with the texts, as those of misread forms do. A worker decides each word type once and keeps the
decision, so the cost follows the number of different noisy words, not the text.

Defined results: null, empty and blank texts have no noise; lines are those between line feeds; a
run without spaces of over 48 characters in a spaced script (an address, a ruled line) is no word.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable

from foliolake.llm import pagetext

# What a glyph (left) is misread as (right), as seen in scanned print.
CONFUSIONS = """
a o|a @|a e|b 6|b h|c e|c o|d cl|e c|e o|f t|g 9|g q|h b|h li|h ln|i 1|i l|i !|i j|k lc|l 1|l I|l !|l |l i|m rn|m nn|m ni|n ri|n u|n ii|n h
o 0|o c|o a|q g|q 9|r n|s 5|s 8|t +|t f|t r|t l|u ii|u v|u n|v u|w vv|x ×|y v|z 2|z s
ö 6|é 6|ó 6|ô 6|ò 6|ü ii|ú ii|ü ll
A 4|B 8|B 6|B E|C G|D O|D 0|D I)|E F|F P|G 6|G C|H l-l|I l|I 1|I J|K lC|K l<|L 1|M IVI|N IV|O 0|O Q|P F|Q O|R I2|S 5|S 8|S $|T 7|T I|U V|V U|W VV|Z 2|Z 7
rn m|ri n|cl d|vv w|li h|fi ii|nn m|tt it|ll II|ii u|in m
а о|б 6|в 8|в з|г т|г r|д л|е с|е c|ё е|ж x<|ж >к|з 3|и н|и u|и п|й и|к x|к н|л п|л д|м rn|н и|н п|о 0|о с|п n|п л|п н|р о|с о|с е|т r|т г|у v|ф ср|ц п|ц u|ч 4|ш щ|ш ill|щ ш|ъ ь|ы bI|ы ьl|ы ьі|ь ъ|э з|ю lо|я R|я л
Б 6|В 8|Г r|Д Л|З 3|И N|И Н|Л П|Н И|О 0|П Л|П n|Р P|С О|Т Г|Ч 4|Ш Щ|Ы bI
ш ll1|ш lll|ы ЬІ|ы ЬI|ы bІ|ы ьі|ж х<|ж >к|ю l0|ю lо|ф qp|к l<|д g|у y|в B|н H
ー 一|ー -|ー ―|バ パ|パ バ|ビ ピ|ピ ビ|ブ プ|プ ブ|ベ ペ|ペ ベ|ボ ポ|ポ ボ|ン ソ|ソ ン|シ ツ|ツ シ|ト 卜|タ 夕|ロ 口|カ 力|エ 工|ニ 二|ハ 八|ク ワ|ワ ク|ス ヌ|ヌ ス|ル レ|レ ル|チ 千|り リ|リ り|ラ ヲ|セ ヤ|ア マ|コ ユ|ナ メ|オ 才|ノ 丿|ホ 木|ケ ク|テ デ|ガ カ|ジ シ|ダ タ|ズ ス|ィ イ|ッ ツ|ャ ヤ|ュ ユ|ョ ヨ|っ つ|ゃ や|ょ よ|ゅ ゆ
側 測|検 険|図 囲|温 湿|間 問|開 閉|開 間|閉 閑|記 紀|録 緑|締 諦|乾 幹|件 仵|取 敢|場 塲|所 祈|車 東|軸 軸|受 愛|歯 菌|布 市|油 抽|油 由|使 便|待 侍|分 兮|回 同|回 囘|転 輪|右 石|左 在|新 親|古 占|面 而|画 面|品 晶|組 租|立 位|必 心|緒 諸|納 約|入 人|高 髙|圧 庄|超 越|重 垂|表 衷|点 占|結 詰|果 杲|昨 咋|年 午|故 敌|障 章|多 名|申 甲|訳 釈|修 條|理 埋|予 矛|告 吉|動 勤|出 山|画 両|示 禾|停 亭|止 正|確 碓|認 恥|異 翼|音 昔|交 文|換 喚
阀 问|门 闩|门 们|机 札|机 杌|轮 抡|轴 抽|承 永|弹 弾|簧 黄|软 欤|管 菅|泵 汞|水 木|喷 噴|嘴 咀|垫 埶|片 斤|传 伝|感 惑|器 哭|过 迂|滤 虑|风 凤|扇 扉|开 幵|关 夫|油 由|箱 厢|电 甩|缆 揽|动 幼|离 禽|合 台|活 话|塞 寒|法 去|兰 三|转 传|继 断|屏 并|幕 墓|显 昱|检 捡|查 杳|停 亭|随 隋|后 右|闭 闲|请 清|布 市|洁 沽|使 便|溶 容|剂 齐|刷 剧|旧 日|图 囹|纸 抵|左 在|右 石|边 辺|新 亲|根 很|据 椐|表 衷|重 垂|量 里|为 力|去 丢|年 午|车 东|间 问|记 纪|录 彔|次 欠|故 敌|障 章|数 教|涉 步|及 乃|小 少|心 必|可 司|能 熊|会 佘|突 实|然 燃|启 后|发 友|出 山|异 导|常 尝|声 岸|音 昔|立 位|即 郎|更 史|换 唤|运 远|行 彳|时 吋|必 心|须 顷|结 诘|果 杲|组 租|成 戌|部 陪|件 仵|总 怠|是 昰|起 超|交 文|货 贷|高 髙|压 庄|侧 测|不 木|得 碍|超 越|过 边|第 弟|号 亏|零 雷|适 活|用 甩|于 干|也 乜|当 挡|仍 奶|热 势|等 筹|待 侍|分 兮|钟 仲|再 冉|打 扌|所 斫|示 禾|大 太|约 的|需 雷|要 耍|空 穸
ม น|ต ค|ป บ|ท ห|ค ด|ด ค|ช ซ|ถ ภ|ผ ฝ|พ ฟ|ฟ พ|ก ถ|ก ภ|ข ช|ร ธ|ธ ร|ศ ส|ย ข|อ ฮ|ไ ใ|ใ ไ|เ แ|ี ิ|ิ ี|ึ ื|ื ึ|่ ้|้ ่|า ำ|ฎ ฏ|ณ ญ
"""
HYPHENS = "-‐­¬‑–"
_CJK = "぀-ヿ㐀-鿿豈-﫿々〆〇"
_THAI = "฀-๿"
#: Runs of the text that are decided as one word.
_WORD = re.compile(rf"[{_CJK}]+|[{_THAI}]+|[^\s{_CJK}{_THAI}\u3001-\u301f\uff01-\uff0f\uff1a-\uff1f]+")
_EDGES = ".,;:!?…()[]{}«»„“”‘’'\"、。，！？：；「」『』（）¿¡•·*–—|/=%°"
_DIGITS = str.maketrans("0123456789", "0000000000")
#: Codes, numbers and units, after digits became 0.
_PLAIN = re.compile(r"[A-Z]{0,3}[-/]?0+(?:[.,:/]0+)*(?:°?[A-Za-zΩ]{0,4}(?:/[a-z]{0,3})?[²³%]?)|[a-z]{1,3}(?:[-/]0+|000+)|[ivxlc]+|[A-Z]{1,3}[-/]?|0+[).]?")
_UNSPACED = re.compile(f"[{_CJK}{_THAI}]")
_CJKC, _THAIC = re.compile(f"[{_CJK}]"), re.compile(f"[{_THAI}]")
#: A word is common from so many uses, and right enough to learn from, or with its hyphen; or from one of so many words of all texts.
COMMON, LEARN, LINKED = (20, 45_000), (12, 75_000), (2, 450_000)
#: The score an edit needs in unspaced scripts, whose runs are often cut or newly composed.
UNSPACED_MARGIN = 1.2
#: Longer unspaced runs are decided in windows of this size; so near a window's cut its n-grams are not the run's.
_MAX_WORD, _WINDOW_EDGE = 48, 8


def _pairs() -> dict[str, list[str]]:
    """observed -> what it may stand for."""
    out: dict[str, list[str]] = defaultdict(list)
    for part in re.split(r"[\n]", CONFUSIONS):
        for pair in re.split(r"(?<=[^ ])\|(?=[^ ])", part):
            if len(both := pair.split(" ")) == 2 and both[0] and both[1] and both[0] != both[1]:
                out[both[1].translate(_DIGITS)].append(both[0])
    out["|"].append("l")
    return {k: list(dict.fromkeys(v)) for k, v in out.items()}


_LOOK = None


def plain_form(text: str) -> str:
    """Invisible characters, width forms and look-alike letters undone, one character for one where possible."""
    global _LOOK
    if text.isascii():
        return text
    if _LOOK is None:
        from foliolake.llm import lookalike as k

        table = {ord(a): b for a, b in zip(*k._compat(), strict=True)}
        table |= {ord(c): " " for c in k.SPACES}
        table |= dict.fromkeys([0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0xFE00, 0xFE10), 0xFEFF, *range(0, 9), *range(11, 32)])
        table |= {ord(a): b for a, b in k.LIGATURES.items() if len(a) == 1 and a != "…"}
        twins = dict(zip(k.CYRILLIC + k.GREEK, k.CYRILLIC_AS + k.GREEK_AS, strict=True))
        back = {b: a for a, b in zip(k.CYRILLIC, k.CYRILLIC_AS, strict=True)}
        _LOOK = table, twins, back
    table, twins, back = _LOOK
    if _ODD.search(text):
        text = text.translate(table)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    if not _GREEK_ON.search(text) or not _FOREIGN.search(text):
        return text

    def mend(word: str) -> str:
        if word.isascii() or not _LATIN.search(word) and not _GREEK.search(word):
            return word
        cyr = sum("Ѐ" <= c <= "ӿ" and c not in twins for c in word)
        lat = sum(c.isascii() and c.isalpha() and c not in back or "À" <= c <= "ɏ" for c in word)
        if cyr > lat:
            return "".join(back.get(c, c) for c in word)
        if lat or not any("Ѐ" <= c <= "ӿ" for c in word) or any(c.isdigit() for c in word):
            return "".join(twins.get(c, c) for c in word)
        return word

    mended = {w: v for w in set(_LINKED_WORD.findall(text)) if (v := mend(w)) != w}
    return _LINKED_WORD.sub(lambda m: mended.get(m[0], m[0]), text) if mended else text


_LINKED_WORD = re.compile(r"[^\W_]+(?:[-/][^\W_]+)*")
#: Anything that the table of plain forms or composition could change.
_ODD = re.compile("[\\x00-\\x08\\x0b-\\x1f\\x7f-\\xa0\\xad\u0131\u0251\u0261\u02bc-\u036f\u0483-\u0489\u061c\u115f-\u11ff\u1680\u180e\u1d0f\u2000-\u2012\u2024-\u202f\u2043\u205f-\u206f\u2212\u2e80-\u2fdf\u3000\u3099\u309a\u3131-\u318f\ua4f8\uf900-\ufaff\ufb00-\ufb06\ufe00-\ufe6f\ufeff\uff01-\uffef]")
_GREEK_ON, _GREEK, _LATIN = re.compile("[\u0370-\u052f]"), re.compile("[\u0370-\u03ff]"), re.compile("[A-Za-z\u00c0-\u024f0-9]")
_FOREIGN = re.compile(r"[A-Za-zÀ-ɏ][Ͱ-ӿԀ-ԯ]|[Ͱ-ӿԀ-ԯ][A-Za-zÀ-ɏ0-9]|[Ͱ-ϻ]|[Ѐ-ӿ][-/]?[0-9]")


def zeros(text: str) -> str:
    """The text with every digit made 0 (nine searches in C, faster than a translation table)."""
    for d in "123456789":
        if d in text:
            text = text.replace(d, "0")
    return text


def _bucket(x: float) -> int:
    return max(-4, min(12, round(x)))


class Editor:
    """Counts of word types and n-grams, the candidate edits, and the weights."""

    GRAMS = (3, 5)

    def __init__(self, counts: Counter[str]):
        self.counts: dict[str, int] = dict(counts)
        total = sum(counts.values())
        self.common, self.learn, self.linked = (max(least, total // part) for least, part in (COMMON, LEARN, LINKED))
        self.pairs = _pairs()
        self.wide = max(map(len, self.pairs))
        self.folded: dict[str, int] = defaultdict(int)
        self.grams: dict[str, int] = defaultdict(int)
        for w, n in counts.items():
            self.folded[_fold(w)] += n
            self._count_grams(w, n)
        # neighbours by one wildcard, of the frequent unspaced words only: their glyphs have no full table
        self.holes: dict[str, str] = {}
        for w, n in counts.items():
            if n >= self.common and len(w) >= 2 and (_CJKC.match(w) or _THAIC.match(w)):
                for i in range(len(w)):
                    hole = f"{w[:i]}\0{w[i + 1:]}"
                    if self.counts.get(self.holes.get(hole, ""), 0) < n:
                        self.holes[hole] = w
        # common words without one inner character, of spaced scripts
        self.short: dict[str, tuple[int, str]] = {}
        for w, n in counts.items():
            if n >= self.common and len(w) >= 6 and w.isalpha() and not _UNSPACED.search(w):
                for i in range(1, len(w) - 1):
                    less = w[:i] + w[i + 1 :]
                    if less not in self.counts or self.counts[less] * 50 < n:
                        self.short.setdefault(less, (i, w[i]))
        # the commonest character between two others, of unspaced scripts
        best: dict[tuple[str, str], tuple[int, str]] = {}
        for g, n in self.grams.items():
            if len(g) == 3 and n >= self.common and _UNSPACED.match(g[1]) and best.get((g[0], g[2]), (0, ""))[0] < n:
                best[g[0], g[2]] = (n, g[1])
        self.middle = {k: t for k, (_, t) in best.items()}
        self.w: dict[str, float] = {}
        self.by_bucket: tuple[list[float], list[list[float]]] | None = None
        self.furniture = pagetext.Furniture()
        self.known: dict[str, tuple[tuple[int, int, str], ...]] = {}

    def _count_grams(self, w: str, n: int) -> None:
        p = f"^{w}$"
        for k in self.GRAMS:
            for i in range(len(p) - k + 1):
                self.grams[p[i : i + k]] += n

    def _least(self, p: str, a: int, b: int, k: int, off: Counter | None = None) -> int:
        """The least count of the k-grams of p that overlap [a, b)."""
        lo, hi = max(0, a - k + 1), min(len(p) - k, b - 1)
        if hi < lo:
            return 0
        get = self.grams.get
        if off is None:
            return min(get(p[i : i + k], 0) for i in range(lo, hi + 1))
        return min(get(p[i : i + k], 0) - off.get(p[i : i + k], 0) for i in range(lo, hi + 1))

    def candidates(self, w: str) -> list[tuple[int, int, str, str]]:
        """(start, end, replacement, kind of pair)."""
        out = []
        for i in range(len(w)):
            for n in range(1, self.wide + 1):
                o = w[i : i + n]
                if len(o) == n and o in self.pairs:
                    out += [(i, i + n, t, f"{o}>{t}") for t in self.pairs[o]]
        if len(w) >= 5 and not _UNSPACED.search(w):
            if w in self.short:
                i, c = self.short[w]
                out.append((i, i, c, "more"))
            for i in range(1, len(w) - 1):  # a stray sign, or a character that came twice
                if (not w[i].isalnum() or w[i] == w[i - 1]) and self.counts.get(w[:i] + w[i + 1 :], 0) >= self.common:
                    out.append((i, i + 1, "", "less"))
        # a glyph of no table must be strange between its neighbours, so never at an end (it may be cut there)
        p = f"^{w}$"
        if self.holes and _CJKC.search(w):
            for i in range(1, len(w) - 1):
                if (v := self.holes.get(f"{w[:i]}\0{w[i + 1:]}")) and v != w:
                    t = v[i]
                    if t != w[i] and f"{w[i]}>{t}" not in {c[3] for c in out if c[0] == i} and self._odd(p, i, t):
                        out.append((i, i + 1, t, "other"))
        if self.middle and _CJKC.search(w):
            have = {(c[0], c[2]) for c in out}
            for i in range(1, len(w) - 1):
                t = self.middle.get((p[i], p[i + 2]))
                if t and t != w[i] and (i, t) not in have and self._odd(p, i, t):
                    out.append((i, i + 1, t, "other"))
        return out

    def _odd(self, p: str, i: int, t: str) -> bool:
        return _same_kind(p[i + 1], t) and self.grams.get(p[i : i + 3], 0) * 20 < self.grams.get(p[i] + t + p[i + 2], 0)

    def features(self, w: str, c: tuple[int, int, str, str], off: Counter | None = None, own: int = 0, hide: Counter | None = None) -> list[str]:
        """``off`` and ``own`` take the word's own counts away, ``hide`` those of the edited word."""
        i, j, t, pair = c
        v = w[:i] + t + w[j:]
        have, want = self.counts.get(w, 0) - own, 0 if hide is not None else self.counts.get(v, 0)
        op = "i" if i == j else "d" if not t else "r" if j - i == len(t) else "rd" if j - i > len(t) else "ri"
        f = ["bias", f"op:{op}", f"pair:{pair}", f"word:{_bucket(math.log2((want + 0.2) / (have + 0.2)))}", f"seen:{want > 0}:{min(3, max(0, have))}"]
        p, q = f"^{w}$", f"^{v}$"
        for k in self.GRAMS:
            a, b = self._least(p, i + 1, j + 1, k, off), self._least(q, i + 1, i + 1 + len(t), k, hide)
            f.append(f"g{k}:{_bucket(math.log2((b + 0.3) / (a + 0.3)))}")
        inside = w[i:j]
        if i == j:
            f.append("none")
        elif any(x.isdigit() for x in inside):
            f.append(f"digit:{_letters_beside(w, i, j)}")
        elif not any(x.isalpha() for x in inside):
            f.append("sign")
        if i != j and "Ѐ" > inside[0] > "9" and any("Ѐ" <= x <= "ӿ" for x in w):
            f.append("mixed")
        if len(w) <= 3:
            f.append(f"short:{len(w)}")
        return f

    def score(self, f: list[str]) -> float:
        get = self.w.get
        return sum(get(x, 0.0) for x in f)

    def scores(self, w: str, found: list[tuple[int, int, str, str]], least: float = -math.inf) -> list[float]:
        """``score`` of the ``features`` of each candidate; what they have in common, and the weights' names, are made once.

        A candidate that no n-grams could bring over ``least`` has -inf.
        """
        if self.by_bucket is None:
            at = lambda name: [self.w.get(f"{name}:{b}", 0.0) for b in range(-4, 13)]
            self.by_bucket = at("word"), [at(f"g{k}") for k in self.GRAMS]
        words, grams = self.by_bucket
        best = sum(map(max, grams)) + 1e-6
        weight, count, gram, log2 = self.w.get, self.counts.get, self.grams.get, math.log2
        have, n, p = count(w, 0), len(w), f"^{w}$"
        own = [[gram(p[x : x + k], 0) for x in range(n + 3 - k)] for k in self.GRAMS]
        seen, mixed, bias = min(3, max(0, have)), any("Ѐ" <= x <= "ӿ" for x in w), weight("bias", 0.0)
        out = []
        for i, j, t, pair in found:
            v = w[:i] + t + w[j:]
            want, size = count(v, 0), len(t)
            op = "i" if i == j else "d" if not t else "r" if j - i == size else "rd" if j - i > size else "ri"
            f = [bias, weight(f"op:{op}", 0.0), weight(f"pair:{pair}", 0.0), words[_bucket(log2((want + 0.2) / (have + 0.2))) + 4], weight(f"seen:{want > 0}:{seen}", 0.0)]
            inside, rest = w[i:j], []
            if i == j:
                rest.append(weight("none", 0.0))
            elif any(x.isdigit() for x in inside):
                rest.append(weight(f"digit:{_letters_beside(w, i, j)}", 0.0))
            elif not any(x.isalpha() for x in inside):
                rest.append(weight("sign", 0.0))
            if mixed and i != j and "Ѐ" > inside[0] > "9":
                rest.append(weight("mixed", 0.0))
            if n <= 3:
                rest.append(weight(f"short:{n}", 0.0))
            if sum(f) + sum(rest) + best <= least:
                out.append(-math.inf)
                continue
            q, b = f"^{v}$", 1
            for k, mine, weights in zip(self.GRAMS, own, grams, strict=True):
                lo = max(0, i + 2 - k)
                a = min(mine[lo : j + 1], default=0)
                # a longer n-gram is never seen where a part of it is not
                b = b and min([gram(q[x : x + k], 0) for x in range(lo, min(len(q) - k, i + size) + 1)], default=0)
                f.append(weights[_bucket(log2((b + 0.3) / (a + 0.3))) + 4])
            f += rest
            out.append(sum(f))
        return out

    def edits(self, w: str) -> tuple[tuple[int, int, str], ...]:
        """The edits of one word type, none if it is right."""
        found = self.known.get(w)
        if found is None:
            found = self._edits(w) if len(w) <= _MAX_WORD else self._long(w)
            if len(self.known) < 400_000:
                self.known[w] = found
        return found

    def _long(self, w: str) -> tuple[tuple[int, int, str], ...]:
        """The edits of an unspaced run of any length, each place decided in a window that holds its neighbours."""
        if not _UNSPACED.search(w) or self.counts.get(w, 0) > self.frequent:
            return ()
        out, done, end = [], 0, 0
        for lo in [*range(0, len(w) - _MAX_WORD, _MAX_WORD - 2 * _WINDOW_EDGE), len(w) - _MAX_WORD]:
            last = lo + _MAX_WORD - _WINDOW_EDGE if lo + _MAX_WORD < len(w) else len(w)
            for i, j, t in self.edits(w[lo : lo + _MAX_WORD]):
                if max(done, end) <= lo + i < last:
                    out.append((lo + i, lo + j, t))
                    end = lo + j
            done = last
        return tuple(out)

    def _edits(self, w: str) -> tuple[tuple[int, int, str], ...]:
        if self.counts.get(w, 0) > self.frequent or len(w) < 2 or _PLAIN.fullmatch(w):
            return ()
        if self._decoy(w):
            return ()
        best: dict[int, tuple[float, tuple[int, int, str, str]]] = {}
        least = UNSPACED_MARGIN if _UNSPACED.search(w) else 0.0
        found = self.candidates(w)
        for c, s in zip(found, self.scores(w, found, least), strict=True):
            if s > least and s > best.get(c[0], (0.0,))[0]:
                best[c[0]] = (s, c)
        out, end = [], -1
        for _, (s, c) in sorted(best.items()):
            if c[0] >= end:
                out.append(c[:3])
                end = c[1]
        return tuple(out) or self._two(w)

    def _two(self, w: str) -> tuple[tuple[int, int, str], ...]:
        """Two edits that only together give a frequent word."""
        if len(w) < 3 or _UNSPACED.search(w):
            return ()
        first = self.candidates(w)
        found: tuple[int, tuple] = (self.frequent // 2 + 20 * self.counts.get(w, 0), ())
        for n, (i, j, t, _) in enumerate(first):
            for i2, j2, t2, _ in first[n + 1 :]:
                if i2 >= j and (c := self.counts.get(w[:i] + t + w[j:i2] + t2 + w[j2:], 0)) > found[0]:
                    found = c, ((i, j, t), (i2, j2, t2))
        return found[1]

    def _decoy(self, w: str) -> bool:
        """Right words in another case or without accents are no noise."""
        return not any(c.isdigit() for c in w) and self.folded.get(_fold(w), 0) >= max(self.common, 2 * self.counts.get(w, 0) + 2)

    # -- training -------------------------------------------------------------------------------

    def fit(self, seed: int = 7, rounds: int = 8, most: int = 6_000) -> Editor:
        rnd = random.Random(seed)
        total = sum(self.counts.values())
        self.frequent = max(40, total // 20_000)
        types = sorted((w for w, n in self.counts.items() if n >= self.learn and 3 <= len(w) <= 24 and not _PLAIN.fullmatch(w)), key=lambda w: (-self.counts[w], w))[:most]
        back: dict[str, list[str]] = defaultdict(list)
        for o, ts in self.pairs.items():
            for t in ts:
                back[t].append(o)
        total_w: dict[str, float] = defaultdict(float)
        step = 1
        self.w = defaultdict(float)

        def update(f: list[str], by: float) -> None:
            for x in f:
                self.w[x] += by
                total_w[x] += by * step

        for _ in range(rounds):
            rnd.shuffle(types)
            for w in types:
                step += 1
                # a right word, as if it had not been seen: leave-one-out of its own counts
                n = self.counts[w]
                keep = rnd.choice((n - 1, n - 1, n - 2, 0))
                off = Counter()
                p = f"^{w}$"
                for k in self.GRAMS:
                    for i in range(len(p) - k + 1):
                        off[p[i : i + k]] += keep
                cands = self.candidates(w)
                rnd.shuffle(cands)
                for c in cands[:12]:
                    f = self.features(w, c, off, keep)
                    # a candidate much more frequent than the word is left undecided: it may be its truth
                    if self.counts.get(w[: c[0]] + c[2] + w[c[1] :], 0) > 20 * n:
                        continue
                    if self.score(f) > -1:
                        update(f, -1.0)
                # the same word misread at one or two places
                spots = [(i, i + len(t), o, t) for i in range(len(w)) for t in {w[i : i + 1], w[i : i + 2]} if t in back for o in back[t]]
                if not spots:
                    continue
                i, j, o, t = rnd.choice(spots)
                if rnd.random() < 0.3 and _UNSPACED.match(w[i]) and j - i == 1:  # a confusion of no table
                    o = rnd.choice(rnd.choice(types))
                    if not _same_kind(o, w[i]) or o == w[i]:
                        continue
                bad = w[:i] + o + w[j:]
                if rnd.random() < 0.15 and len(w) >= 6 and not _UNSPACED.search(w):  # a character lost or come twice
                    i = rnd.randint(1, len(w) - 2)
                    i, j, o, t = (i, i + 1, "", w[i]) if rnd.random() < 0.5 else (i + 1, i + 1, w[i], "")
                    bad = w[:i] + o + w[j:]
                if self.counts.get(bad, 0) * 10 > n:
                    continue
                hide = None
                if rnd.random() < 0.5:  # as if the right word had not been seen as a whole
                    hide = Counter({g: self.counts[w] for k in self.GRAMS for g in (p[x : x + k] for x in range(len(p) - k + 1))})
                # as if the misread form had been seen so many times: common words are misread often
                times = rnd.choice((0, 0, 1, 1, 2, 2 + n // 200))
                q = f"^{bad}$"
                off2 = Counter({g: -times for k in self.GRAMS for g in (q[x : x + k] for x in range(len(q) - k + 1))})
                for c in self.candidates(bad):
                    f = self.features(bad, c, off2, self.counts.get(bad, 0) - times, hide)
                    right = (c[0], c[1], c[2]) == (i, i + len(o), t)
                    if right:
                        if self.score(f) < 1:
                            update(f, 1.0)
                    elif self.counts.get(bad[: c[0]] + c[2] + bad[c[1] :], 0) < n / 20 and self.score(f) > -1 and rnd.random() < 0.3:
                        update(f, -0.5)
        self.w, self.by_bucket = {x: v - total_w[x] / step for x, v in self.w.items()}, None
        self._fit_joins(types, rnd)
        return self

    # -- line joins -----------------------------------------------------------------------------

    def _fit_joins(self, types: list[str], rnd: random.Random, rounds: int = 6) -> None:
        """Weights of the join operation: words broken anywhere are to be joined, compounds broken at their hyphen are not."""
        whole = [w for w in types if len(w) >= 4 and w.isalpha() and not _UNSPACED.search(w)]
        linked = [w for w, n in self.counts.items() if n >= self.linked and "-" in w[1:-1] and w[w.index("-") - 1].isalpha() and w[w.index("-") + 1].isalpha()]
        w: dict[str, float] = defaultdict(float)
        total: dict[str, float] = defaultdict(float)
        step = 1
        for _ in range(rounds):
            some = [(x, True) for x in whole] + [(x, False) for x in linked for _ in range(1 + len(whole) // (4 * len(linked)))]
            rnd.shuffle(some)
            for x, joins in some:
                step += 1
                i = rnd.randint(1, len(x) - 1) if joins else x.index("-")
                left, right = x[:i], x[i if joins else i + 1 :]
                if not right or not right[0].isalpha():
                    continue
                unseen = rnd.random() < 0.4  # as if the word had not been seen as a whole
                f = self.join_features(left, "¬" if joins and rnd.random() < 0.1 else "-", right, 0 if unseen and joins else None, 0 if unseen and not joins else None)
                score = sum(w[k] for k in f)
                if (score <= 1) if joins else (score >= -1):
                    for k in f:
                        w[k] += 1.0 if joins else -1.0
                        total[k] += (1.0 if joins else -1.0) * step
        self.w |= {k: v - total[k] / step for k, v in w.items()}

    def join_features(self, left: str, sign: str, right: str, whole: int | None = None, linked: int | None = None) -> list[str]:
        """``whole`` and ``linked`` take the place of the counts of the joined and the hyphenated word."""
        get = lambda x: self.counts.get(x.translate(_DIGITS), 0)
        whole = get(left + right) if whole is None else whole
        linked = get(f"{left}-{right}") if linked is None else linked
        mended = 0
        if not whole and not linked:
            fixed = self._fixed(left + right)
            mended = get(fixed) - get(f"{left}-{fixed[len(left):]}") if fixed != left + right else 0
        size = lambda n: min(6, int(math.log2(n + 1)) // 2)
        p, q = f"^{left}{right}$".translate(_DIGITS), f"^{left}-{right}$".translate(_DIGITS)
        at = len(left) + 1
        a, b = self._least(p, at - 1, at + 1, 3), self._least(q, at - 1, at + 2, 3)
        short = left.isupper() and len(left) <= 3
        return [
            "j:bias", f"j:soft:{sign != '-'}", f"j:word:{_bucket(math.log2((whole + 0.2) / (linked + 0.2)))}", f"j:seen:{whole > 0}:{linked > 0}", f"j:mended:{(mended > 0) - (mended < 0)}",
            f"j:lower:{right[0].islower()}", f"j:short:{short}", f"j:digit:{any(c.isdigit() for c in left + right)}", f"j:parts:{size(get(left))}:{size(get(right))}", f"j:grams:{_bucket(math.log2((a + 0.3) / (b + 0.3)))}", f"j:link:{self._link(left)}:{whole > 0}:{linked > 0}",
        ]

    def joins(self, left: str, sign: str, right: str) -> bool:
        """True if ``left``-``right`` is one word broken at the line end."""
        if not left or not right or not (left[-1].isalpha() and right[0].isalpha()):
            return False
        return self.score(self.join_features(left, sign, right)) > 0

    def _link(self, left: str) -> bool:
        return self.grams.get(f"{left[-2:]}-", 0) > 0

    def _fixed(self, w: str) -> str:
        for i, j, t in reversed(self.edits(w.translate(_DIGITS))):
            w = w[:i] + t + w[j:]
        return w


def _fold(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", w.casefold()) if not unicodedata.combining(c) or "぀" <= c)


def _same_kind(a: str, b: str) -> bool:
    """Both kana or both ideographs or both Thai: unlike glyphs aren't mistaken for each other."""
    kind = lambda c: "k" if "぀" <= c <= "ヿ" else "t" if "฀" <= c <= "๿" else "h" if "㐀" <= c <= "鿿" else "x"
    return kind(a) == kind(b) != "x"


def _letters_beside(w: str, i: int, j: int) -> int:
    return (i > 0 and w[i - 1].isalpha() and not w[i - 1].isupper()) + (j < len(w) and w[j].isalpha() and not w[j].isupper())


def fit_editor(texts: Iterable[str], titles: Iterable[tuple[str | None, int | None]] | None = None) -> Editor:
    """An editor from page texts, with the titles and page numbers of the pages where they are known."""
    counts: Counter[str] = Counter()
    examples: Counter[tuple[tuple[str, ...], bool]] = Counter()
    texts = list(texts)
    for text in texts:
        counts.update(page_chunks(text))
    counts = chunk_words(counts)
    for text, more in zip(texts, titles, strict=True) if titles is not None else ():
        examples.update(pagetext.Furniture.examples(text, *more))
    return editor_of(counts, None if titles is None else examples)


def page_chunks(text: str) -> list[str]:
    """The runs of a page's text that are decided as one word: digits are all 0, outer punctuation is on."""
    return [x for flow, _ in flows(plain_form(text).split("\n")) for x in _WORD.findall(zeros(flow))]


def chunk_words(chunks: dict[str, int]) -> Counter[str]:
    """The word types of counted runs: outer punctuation is off."""
    out: Counter[str] = Counter()
    for x, n in chunks.items():
        if w := x.strip(_EDGES):
            out[w] += n
    return out


def known_word(w: str, n: int) -> bool:
    return n >= 2 or len(w) < 30


def editor_of(counts: dict[str, int], examples: dict[tuple[tuple[str, ...], bool], int] | None) -> Editor:
    """From the counts of words and of examples of furniture."""
    editor = Editor(Counter({w: n for w, n in sorted(counts.items()) if known_word(w, n)})).fit()
    if examples is not None:
        editor.furniture = pagetext.Furniture.learned(examples)
    return editor


_CJK_END, _CJK_START = re.compile(f"[{_CJK}]$"), re.compile(f"^[{_CJK}]")


def flows(lines: list[str], skip: list | None = None) -> list[tuple[str, list[tuple[int, int]]]]:
    """The text without furniture, unspaced lines glued: (text, [(offset, line index)])."""
    out: list[tuple[str, list[tuple[int, int]]]] = []
    width = max(map(len, lines), default=0)
    buf: list[str] = []
    marks: list[tuple[int, int]] = []
    size = 0
    for i, line in enumerate(lines):
        if skip and skip[i]:
            continue
        if buf:
            prev = buf[-1]
            if not (prev and line and len(prev) >= 0.8 * width and _CJK_END.search(prev) and _CJK_START.search(line)):
                buf.append("\n")
                size += 1
        marks.append((size, i))
        buf.append(line)
        size += len(line)
    if buf:
        out.append(("".join(buf), marks))
    return out


class Scanner:
    """Finds the noise of a page or box with a fitted editor; keeps what it has decided."""

    def __init__(self, editor: Editor):
        self.editor = editor
        self.clean: set[str] = {x for x, n in editor.counts.items() if n > editor.frequent and not editor.edits(x)}

    def lines(self, text: str, kinds: list[str | None]) -> dict[int, set[str]]:
        """line index -> kinds of noise, for the lines that are no furniture."""
        out: dict[int, set[str]] = defaultdict(set)
        form = plain_form(text)
        lines = form.split("\n")
        if len(lines) != len(kinds):
            lines = [plain_form(x) for x in text.split("\n")]
        raw = text.split("\n")
        joined: dict[int, tuple[int, str, str]] = {}
        if len(lines) > 1:
            for i, line in enumerate(raw):
                tail = line.rstrip(" \t​﻿")
                if tail and tail[-1] in HYPHENS and not kinds[i] and len(tail) > 1:
                    self._hyphen(i, tail, lines, kinds, out, joined)
        for i, (_, _, rest) in joined.items():
            j, head, _ = joined[i]
            lines[i] = lines[i].rstrip().rstrip(HYPHENS)
            cut = lines[i].rfind(" ") + 1
            word = lines[i][cut:] + head
            lines[i] = lines[i][:cut].rstrip()
            lines[j] = lines[j].lstrip()[len(head) :] if lines[j].lstrip().startswith(head) else lines[j]
            if bad := self._bad(word):
                for a, b, _t in bad:
                    out[i if a < len(word) - len(head) else j].add("char")
        for flow, marks in flows(lines, kinds):
            flow = zeros(flow)
            clean = self.clean
            unsure = set(_WORD.findall(flow)) - clean
            if not unsure:
                continue
            unsure = {x for x in unsure if self._word(x)}
            if not unsure:
                continue
            starts = [a for a, _ in marks]
            for m in _WORD.finditer(flow):
                if m[0] in unsure:
                    lead = len(m[0]) - len(m[0].lstrip(_EDGES))
                    for a, _b, _t in self._word(m[0]):
                        out[marks[bisect_right(starts, m.start() + lead + a) - 1][1]].add("char")
        return out

    def _bad(self, word: str) -> tuple:
        return self._word(word.translate(_DIGITS))

    def _word(self, chunk: str) -> tuple:
        """Edits of one chunk between spaces, places counted from its first letter."""
        w = chunk.strip(_EDGES)
        if not w or w in self.clean:
            self.clean.add(chunk) if len(self.clean) < 400_000 else None
            return ()
        edits = self.editor.edits(w)
        if not edits and not _CJKC.search(w) and not _THAIC.search(w):
            at = 0
            found = []
            for part in re.split(r"([-'’/.,])", w):
                if len(part) > 1:
                    found += [(at + a, at + b, t) for a, b, t in self.editor.edits(part)] if part != w else []
                at += len(part)
            edits = tuple(found)
        if not edits:
            self.clean.add(chunk) if len(self.clean) < 400_000 else None
        return edits

    def _hyphen(self, i: int, tail: str, lines: list[str], kinds: list, out: dict, joined: dict) -> None:
        j = i + 1
        while j < len(lines) and (kinds[j] or not lines[j].strip()):
            j += 1
        if j >= len(lines):
            return
        sign = tail[-1]
        left = re.search(r"[^\s]+$", plain_form(tail[:-1]))
        right = re.match(r"\s*([^\s]+)", lines[j])
        if not left or not right:
            return
        a, b = left[0].lstrip(_EDGES), right[1]
        core = re.split(r"[^\w@+!|$]", b, maxsplit=1)[0]
        piece = re.split(r"['’/-]", a)[-1]
        if not a[-1:].isalpha() and not (a[-1:] and a[-1] in "@+!|1053689"):
            return
        if _CJKC.match(a[-1:]) or pagetext.LIST_MARK.match(lines[j]):
            return
        if core and (self.editor.joins(piece, sign, core) or a != piece and self.editor.joins(a, sign, core)):
            out[i].add("hyphen")
            if i not in joined and len(re.findall(r"\S+", lines[j])) >= 1:
                joined[i] = (j, b, "")


def repair(text: str, title: str | None, number: int | None, scanner: Scanner) -> str:
    """The text as continuous paragraphs: furniture out, broken words joined, misread glyphs mended."""
    raw = text.split("\n")
    kinds = scanner.editor.furniture(raw, title, number)
    found = scanner.lines(text, kinds)
    width = pagetext.wrap_width([x for x, k in zip(raw, kinds, strict=True) if not k])
    paragraphs: list[str] = []
    current = ""
    glue = False
    for i, line in enumerate(raw):
        if kinds[i]:
            continue
        line = plain_form(line).strip()
        if not line:
            if current and not glue:
                paragraphs.append(current)
                current = ""
            continue
        if "char" in found.get(i, ()):
            line = _WORD.sub(lambda m: _mend(m[0], scanner), line)
        if current and not glue and (not width or pagetext.LIST_MARK.match(line) or pagetext.HEADING_NUMBER.match(line)):
            paragraphs.append(current)
            current = ""
        gap = "" if glue or not current or _CJK_END.search(current) and _CJK_START.search(line) else " "
        current += gap + line
        glue = "hyphen" in found.get(i, ())
        if glue:
            current = current.rstrip().rstrip(HYPHENS)
    if current:
        paragraphs.append(current)
    return "\n\n".join(paragraphs)


def _mend(chunk: str, scanner: Scanner) -> str:
    lead = len(chunk) - len(chunk.lstrip(_EDGES))
    for a, b, t in reversed(scanner._word(chunk.translate(_DIGITS))):
        chunk = chunk[: lead + a] + t + chunk[lead + b :]
    return chunk


# -- Spark ------------------------------------------------------------------------------------------

def with_titles(pages, projects, by: str):
    """``pages`` with the title of their project; ``by`` is the column that tells their rows apart."""
    from foliolake.session import lookup

    return lookup(pages.drop("title"), projects.select("project_id", "title"), "project_id", by)


def fit_on(pages, projects):
    """The editor fitted on all ``pages`` (page_id, project_id, page_number, ocr_text), broadcast.

    Words and examples of furniture are counted within a slice of pages and before the shuffle; what
    reaches the driver are the different ones with their counts over all rows.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    from foliolake.llm import sentences
    from foliolake.session import spread

    def count(batches):
        for batch in sentences.slices(batches):
            seen: Counter[str] = Counter()
            found: Counter[tuple[str, str]] = Counter()
            for t, title, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen.update(page_chunks(t))
                found.update(("yes" if yes else "no", "\n".join(f)) for f, yes in pagetext.Furniture.examples(t, title, number))
            found.update({("word", w): n for w, n in chunk_words(seen).items()})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([x for _, x in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["kind", "key", "n"])

    rows = with_titles(spread(pages.select("page_id", "project_id", "page_number", F.col("ocr_text").alias("t"))), projects, "page_id").filter("t is not null").select("t", "title", "page_number")
    counts = rows.mapInArrow(count, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    got = counts.filter("kind <> 'word' or n >= 2 or length(key) < 30").toArrow().to_pylist()
    found = {r["key"]: r["n"] for r in got if r["kind"] == "word"}
    examples = {(tuple(r["key"].split("\n")), r["kind"] == "yes"): r["n"] for r in got if r["kind"] != "word"}
    return pages.sparkSession.sparkContext.broadcast(editor_of(found, examples))


def find_noise(records, editor):
    """rec_kind, rec_id, line_no, noise of ``records`` (rec_kind, rec_id, text, title, number, y); boxes have a y, pages a number."""
    import pyarrow as pa

    schema = pa.schema([("rec_kind", pa.string()), ("rec_id", pa.int64()), ("line_no", pa.int32()), ("noise", pa.string())])

    def run(batches):
        scanner = Scanner(editor.value)
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            kinds_, ids, texts, titles, numbers, ys = (c.to_pylist() for c in batch.columns)
            for kind, rec, text, title, number, y in zip(kinds_, ids, texts, titles, numbers, ys, strict=True):
                if not text or text.isspace():
                    continue
                raw = text.split("\n")
                if kind == "page":
                    found = scanner.editor.furniture(raw, title, number)
                else:
                    found = [None] * len(raw)
                    if whole := pagetext.box_furniture(text, title, y):
                        found = [whole if x.strip() else None for x in raw]
                rows = [(i, k) for i, k in enumerate(found) if k]
                if len(rows) < len(raw):
                    rows += [(i, k) for i, ks in scanner.lines(text, found).items() if not found[i] for k in ks]
                for i, k in rows:
                    out[0].append(kind)
                    out[1].append(rec)
                    out[2].append(i + 1)
                    out[3].append(k)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return records.select("rec_kind", "rec_id", "text", "title", "number", "y").mapInArrow(run, "rec_kind string, rec_id long, line_no int, noise string")


def repaired(records, editor):
    """rec_kind, rec_id, repaired text of ``records``."""
    import pandas as pd

    def run(frames):
        scanner = Scanner(editor.value)
        for f in frames:
            rows = [
                (k, i, repair(t, title, None if n is None or n != n else int(n), scanner) if t and not t.isspace() else t)
                for k, i, t, title, n in zip(f["rec_kind"], f["rec_id"], f["text"], f["title"], f["number"], strict=True)
            ]
            yield pd.DataFrame(rows, columns=["rec_kind", "rec_id", "text"])

    return records.select("rec_kind", "rec_id", "text", "title", "number").mapInPandas(run, "rec_kind string, rec_id long, text string")
