"""Broken pairs: defective translations of texts, each with its type of defect.

* empty - nothing of the translation is left without spaces, invisible characters and marks.
* refusal - its words are likelier of a refusal than of a rendering: n-gram naive Bayes of refusals
  against translations, bootstrapped from a short list of seed words, with length and shared numbers
  as further evidence. Words that renderings use as well weigh little, whoever lists them; words
  that come along with the seeds weigh much, so other wordings are found too.
* copy - the text's letters and digits again, once or repeated. A text that is a number or code
  alone, or is in the target language already, is rightly the same; so is a word (a wording of at
  most ``COPY_WORD`` characters) that most rows
  with this word and target leave as it is (a grouped count over all rows, joined back).
* language - the language posteriors of text and translation, by character n-gram naive Bayes,
  give the translation a language that is neither the text's nor the target.
* truncated - by the end-of-text n-gram likelihood: the longest known ending of the translation is
  one after which texts seldom end; or it is left open (…), or ends within a code or number of the text.

All models are fitted on all pairs, by grouped counts (``fit_on``). At most one defect, in this order. Defined results: null translations and blank texts have none.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

from foliolake.llm import naivebayes
from foliolake.llm.noise import plain_form

#: Ending n-grams: longest length, least count to be known, and the likelihood below which a text is cut off.
END_ORDER, END_SEEN, END_LEAST = 10, 3, 0.075
#: Factor on the likelihood of an end without mark where the text has one.
BARE_END = 0.1
#: Weight of the shorter ending in the interpolation.
END_WEIGHT = 8.0
#: Log-odds by which another language must beat text's and target's.
LANGUAGE_MARGIN = 4.0
#: A short wording (so many characters at most, seen so often) belongs to each language in which it is at least this part as common as where it is commonest.
WORD_CHARS, WORD_SEEN, WORD_RATE, WORD_PART = 32, 8, 0.3, 0.04

#: Longest wording, without codes and numbers, that may rightly stay as it is.
COPY_WORD = 40
#: Log-odds of a refusal: of a seed word, of a number of the text, of much more text than there was; most of one word, and the least sum.
SEED, SHARED, LONGER, WORD_ODDS, REFUSAL_LEAST = 4.0, -4.0, 1.0, 4.0, 2.0
#: Log-odds of a word from which it makes a translation worth a closer look.
LEANING = 1.0

# Seed words of refusals (of the speaker, of translating, of requests), by language.
REFUSALS = {
    "en": r"\bI\b|\bI'(?:m|d|ve)\b|\bme\b|\bmy\b|translat|\brequest|\bassist|\bpassage\b|given content|more context",
    "de": r"\b(?:ich|mir|mich|mein\w*)\b|[Üü]bersetz|Anfrage|mehr Kontext",
    "fr": r"\b(?:je|me)\b|\bj['’]|tradui|traduc|(?:votre|cette) demande|contexte",
    "es": r"\b(?:puedo|me es|lo siento)\b|tradu[cz]|solicitud|contexto",
    "pt": r"\b(?:posso|me é|desculpe|lamento)\b|tradu[zç]|solicitaç|pedido|contexto",
    "ru": r"\b(?:я|мне|могу)\b|перев[оеё]|запрос|контекст",
    "ja": r"翻訳|訳せ|ご依頼|お応え|お答え|お手伝い|別の文|この文|文脈",
    "zh": r"翻译|译文|我(?:不能|无法|没)|您的请求|请求|上下文|无法提供|无法协助",
    "th": r"แปล(?!น)|คำขอ|ฉัน|ผม|บริบท|ไม่สามารถช่วย",
}


def _split(pattern: str) -> list[str]:
    """The alternatives of a pattern, groups of alternatives multiplied out."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    if len(out) > 1:
        return [x for p in out for x in _split(p)]
    if m := re.search(r"\(\?:([^()]*)\)(?![?*+{])", pattern):
        return [x for part in m[1].split("|") for x in _split(pattern[: m.start()] + part + pattern[m.end() :])]
    return out


class Words:
    """A pattern of many alternatives; each is looked for only where its longest plain piece stands (several times faster)."""

    def __init__(self, pattern: str, flags: re.RegexFlag = re.NOFLAG):
        self.whole, self.fold = re.compile(pattern, flags), bool(flags & re.I)
        self.parts = []
        for x in _split(pattern):
            piece = max(re.split(r"\\.[*+?]?|\(.*?\)|\[.*?\][*+?]?|.[*+?]", x), key=len)
            self.parts.append((piece.casefold() if self.fold else piece, re.compile(x, flags)))

    def search(self, text: str) -> bool:
        low = text
        if self.fold:
            # these two equal i where case is ignored, but not by their folded forms
            if not text.isascii() and ("\u0130" in text or "\u0131" in text):
                return self.whole.search(text) is not None
            low = text.casefold()
        return any([part.search(text) for piece, part in self.parts if piece in low])


_REFUSAL = Words("|".join(p for k, p in REFUSALS.items() if k != "en"), re.I)
_REFUSAL_EN = Words(REFUSALS["en"])
_REFUSAL_BY = {k: Words(p, re.I) for k, p in REFUSALS.items() if k != "en"}
_NUMBER, _NO_WORD = re.compile(r"\d+"), re.compile(r"[\W_]+")
_TOKEN = re.compile(r"[A-Z]{1,2}[-/]?\d+|\d+(?:[.,]\d+)*")
_UNIT = re.compile(r"(?<![^\W\d_])(?:°C|m²|m³|l/min|mm|cm|kg|kW|kΩ|Nm|bar|Ω|Hz|rpm|[VWAgms%])(?![^\W\d_])")
#: Ends that leave a text open, and ends of sentences.
_OPEN_END = re.compile(r"(?:…|\.{3,}|[,;:–—-])$")
_FINAL = re.compile(r"[.!?。！？…][\"'”’»」』）)]*$")
_TAIL = re.compile(r"[A-Z]{1,2}[-/]?\d*$|\d+[.,]?\d*$")
_SPOKEN = re.compile(r"[^\W\d_]")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿฀-๿]")
#: Different pairs whose decisions a worker keeps, and of which counts are held together.
KEPT, HELD = 100_000, 20_000
#: Parts that the rows which need no look-up, and a hot word, are dealt into.
SALTS = 16


def letters(text: str) -> str:
    """Letters and digits, case folded."""
    return _NO_WORD.sub("", text.casefold())


def stem(text: str, cleaned: str | None = None) -> str:
    """The words of a text without codes, numbers and units (which stand by numbers only)."""
    if not _NUMBER.search(text):
        if cleaned is not None:
            return cleaned.strip()
    else:
        text = _TOKEN.sub(" ", text)
    return _NO_WORD.sub(" ", _UNIT.sub(" ", text)).strip().casefold()


_DIGITS, _CODES = re.compile(r"\d+(?:[.,]\d+)*"), re.compile(r"[A-Z]{1,2}[-/]?\d+")


def shape(text: str) -> str:
    if not _NUMBER.search(text):
        return text
    return _DIGITS.sub("0", _CODES.sub("#", text))


def refuses(text: str, lang: str | None) -> bool:
    """True if the text speaks of itself or of translating, in English or in the language asked for."""
    return _REFUSAL_EN.search(text) or lang != "en" and _REFUSAL_BY.get(lang or "", _REFUSAL).search(text)


def refusal_features(cleaned: str) -> set[str]:
    """Words and word pairs of a cleaned text; pairs and triples of characters of unspaced scripts."""
    words = cleaned.split()
    out = set(words)
    out.update(map(" ".join, zip(words, words[1:], strict=False)))
    for w in words if not cleaned.isascii() else ():
        if _UNSPACED.search(w):
            out.discard(w)
            out.update(w[i : i + k] for k in (2, 3) for i in range(len(w) - k + 1))
    return out


class Refusals:
    """Naive Bayes of refusals against renderings; without examples the seeds alone decide."""

    def __init__(self, weights: dict[str, float], base: float = 0.0):
        self.weights, self.base = weights, base
        self.leaning = frozenset(f for f, w in weights.items() if w >= LEANING)

    def score(self, s: str, t: str, cleaned: str, langs: tuple[str | None, ...]) -> float:
        seed = any(refuses(t, x) for x in langs)
        if not seed and self.leaning.isdisjoint(refusal_features(cleaned) if not cleaned.isascii() and _UNSPACED.search(cleaned) else cleaned.split()):
            return -99.0
        get = self.weights.get
        out = self.base + (SEED if seed else 0.0) + sum(get(f, 0.0) for f in refusal_features(cleaned))
        numbers = _NUMBER.findall(t)
        if numbers and any(x in s for x in numbers):
            out += SHARED
        return out + (LONGER if len(t) > 3 * len(s) + 20 else 0.0)


def first_refusal(s: str, t: str, target: str | None) -> bool:
    """True for an example to begin with: seed words, none in the text, and no number of the text."""
    return refuses(t, target) and not refuses(s, target) and not any(x in s for x in _NUMBER.findall(t))


def refusal_model(yes: dict[str, int], no: dict[str, int], n: int, rest: int) -> Refusals:
    """From the features' counts in n refusals and the rest."""
    weights = {f: max(-WORD_ODDS, min(WORD_ODDS, float(np.log((k + 0.1) / (n + 1.0) * (rest + 1.0) / (no.get(f, 0) + 0.1))))) for f, k in yes.items() if k >= 2}
    # a word of renderings alone speaks against
    weights |= {f: -min(WORD_ODDS, float(np.log(k * (n + 1.0) / (rest + 1.0) / 0.3))) for f, k in no.items() if f not in yes and k * (n + 1.0) / (rest + 1.0) > 0.3}
    return Refusals({f: 0.4 * w for f, w in weights.items()}, -1.0)


def fit_refusals(rows: list[tuple[str, str, str, str | None]], rounds: int = 2) -> Refusals:
    """From (text, translation, cleaned translation, target), each different translation once."""
    kinds = {(shape(t), target): (s, t, c, target) for s, t, c, target in rows}
    items = [kinds[k] for k in sorted(kinds, key=lambda k: (k[0], k[1] or ""))]
    feats = [refusal_features(c) for _, _, c, _ in items]
    now = [first_refusal(s, t, target) for s, t, _, target in items]
    model = Refusals({})
    for _ in range(rounds):
        n = sum(now)
        if n < 5 or n > len(items) // 2:
            return Refusals({})
        yes: Counter[str] = Counter()
        no: Counter[str] = Counter()
        for f, x in zip(feats, now, strict=True):
            (yes if x else no).update(f)
        model = refusal_model(yes, no, n, len(items) - n)
        now = [model.score(s, t, c, (target,)) > REFUSAL_LEAST for s, t, c, target in items]
    return model


def ending(text: str) -> str:
    """The longest ending that is looked up; codes and numbers are short: the shape of the last characters is enough."""
    t = f"^{shape(text)}" if len(text) < 64 else shape(text[-64:])
    return t[-END_ORDER:]


#: Hash of an n-gram: the sum of its characters, from the last, times these.
_PLACES = np.random.default_rng(11).integers(1, 1 << 63, END_ORDER, np.uint64) | np.uint64(1)


class EndingTable:
    """The different endings, of one to ``END_ORDER`` characters, of the longest ones; counts their places in texts."""

    def __init__(self, longest: list[str]):
        self.hashes: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        codes = [naivebayes.codepoints(t)[::-1].astype(np.uint64) for t in longest]
        for k in range(1, END_ORDER + 1):
            some = [i for i, c in enumerate(codes) if len(c) >= k]
            wide = np.array([codes[i][:k] for i in some], np.uint64).reshape(len(some), k)
            h, at = np.unique((wide * _PLACES[:k]).sum(axis=1, dtype=np.uint64), return_index=True)
            self.hashes.append(h)
            self.first.append(np.array(some, int)[at])
        self.offsets = np.concatenate([[0], np.cumsum([len(h) for h in self.hashes])]).astype(int)

    def add(self, sums: np.ndarray, texts: list[str], weights: list[int]) -> None:
        """Add to ``sums`` how often each ending stands in texts."""
        for lo, hi in naivebayes.blocks(texts):
            c = naivebayes.codepoints("".join(f"\U0010ffff{t}" for t in texts[lo:hi])).astype(np.uint64)
            w = np.repeat(np.array(weights[lo:hi], float), [len(t) + 1 for t in texts[lo:hi]])
            at, h = np.arange(len(c)), np.zeros(len(c), np.uint64)
            # an ending's own ending is one too, so only the places found go on
            for k, known in enumerate(self.hashes):
                some = at >= k
                at, h = at[some], h[some]
                h = h + c[at - k] * _PLACES[k]
                found = np.searchsorted(known, h)
                hit = known[np.minimum(found, len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
                at, h = at[hit], h[hit]
                if not len(at):
                    break
                a, b = self.offsets[k], self.offsets[k + 1]
                sums[a:b] += np.bincount(found[hit], weights=w[at], minlength=b - a)

    def grams(self, longest: list[str]) -> list[str]:
        return [longest[i][-k:] for k, first in enumerate(self.first, 1) for i in first.tolist()]


class Endings:
    """How often a text ends after each of its endings, by target language."""

    def __init__(self, texts: dict[str, Counter[str]]):
        self.known: dict[tuple[str, str], float] = {}
        self.all: dict[str, dict[str, float]] = {}
        self.end: dict[str, dict[str, float]] = {}
        for lang, shapes in texts.items():
            every: dict[str, float] = defaultdict(float)
            last: dict[str, float] = defaultdict(float)
            for s, n in shapes.items():
                t = f"^{s}"
                for k in range(1, END_ORDER + 1):
                    for i in range(len(t) - k + 1):
                        every[t[i : i + k]] += n
                    if len(t) >= k:
                        last[t[-k:]] += n
            self.all[lang] = {g: n for g, n in every.items() if n >= END_SEEN}
            self.end[lang] = {g: n for g, n in last.items() if g in self.all[lang]}

    @classmethod
    def counted(cls, every: dict[str, dict[str, float]], last: dict[str, dict[str, float]]) -> Endings:
        """From counts of the endings: of all their places in texts, and of those at a text's end."""
        out = cls({})
        out.all = {lang: {g: n for g, n in c.items() if n >= END_SEEN} for lang, c in every.items()}
        out.end = {lang: {g: last[lang][g] for g in c if last[lang].get(g)} for lang, c in out.all.items()}
        return out

    def likelihood(self, text: str, lang: str) -> float:
        """The probability that a text ends here, interpolated over its endings, this text itself left out."""
        every, last = self.all.get(lang), self.end.get(lang)
        if not every:
            return 1.0
        t = ending(text)
        known = self.known.get((lang, t))
        if known is not None:
            return known
        p, before = 0.001, 0.0
        for k in range(1, len(t) + 1):
            n = every.get(t[-k:])
            if n is None:
                break
            if n == before:  # the same places as with the shorter ending: no new evidence
                continue
            before = n
            p = (max(0.0, last.get(t[-k:], 0.0) - 1.0) + END_WEIGHT * p) / (n - 1.0 + END_WEIGHT)
        if len(self.known) < 200_000:
            self.known[lang, t] = p
        return p


class PairModel:
    def __init__(self, nb: naivebayes.NaiveBayes, endings: Endings, words: dict[str, frozenset[int]] | None = None, refusals: Refusals | None = None):
        self.nb, self.endings, self.words, self.refusals = nb, endings, words or {}, refusals or Refusals({})
        self.index = {c: k for k, c in enumerate(nb.langs)}

    def defects(self, texts: list[str], translations: list[str], targets: list[str | None]) -> list[tuple[str | None, str]]:
        """(defect or None, stem of a copied text or '') of each pair."""
        src = [plain_form(t) for t in texts]
        tgt = [plain_form(t) for t in translations]
        cs, ct = [naivebayes.clean(t) for t in src], [naivebayes.clean(t) for t in tgt]
        at: dict[str, int] = {}
        places = [np.array([at.setdefault(c, len(at)) for c in some], int) for some in (cs, ct)]
        ll = self.nb.many(list(at))
        ls, lt = ll[places[0]] + self.nb.prior, ll[places[1]] + np.where(self.nb.prior < -20, -1e9, 0.0)
        near = [np.flatnonzero(x).tolist() for x in ls >= ls.max(axis=1, keepdims=True) - 3.0]
        return [self._one(*x) for x in zip(src, tgt, cs, ct, targets, ls.argmax(axis=1).tolist(), lt.argmax(axis=1).tolist(), near, lt.tolist(), strict=True)]

    def decided(self, rows, kept: dict) -> list[tuple[str | None, str]]:
        """``defects`` of (text, translation, target), each different one decided once and kept for later rows."""
        if len(kept) > KEPT:
            kept.clear()
        rows = list(rows)
        new = list(dict.fromkeys(r for r in rows if r not in kept))
        if new:
            kept.update(zip(new, self.defects(*map(list, zip(*new, strict=True))), strict=True))
        return [kept[r] for r in rows]

    def _one(self, s: str, t: str, cs: str, ct: str, target: str | None, first: int, k: int, near: list[int], b: list[float]) -> tuple[str | None, str]:
        """``first`` and ``k``: the likeliest languages of text and translation; ``near``: all near the text's best; ``b``: the translation's likelihoods."""
        # both forms are made character by character, so different beginnings tell that neither holds the other
        ps, pt = letters(s[:8]), letters(t[:8])
        n = min(len(ps), len(pt))
        differ = n > 0 and ps[:n] != pt[:n]
        kt, ks = (pt, ps) if differ else (letters(t), letters(s))
        if not kt:
            return ("empty", "") if ks else (None, "")
        # in the language asked for or, if it reads like that, in the text's own
        own = self.nb.langs[first] if first == k else "en"
        langs = (target,) if own in (target, "en") else (target, own)
        if self.refusals.score(s, t, ct, langs) > REFUSAL_LEAST and not (_REFUSAL_EN.search(s) or _REFUSAL.search(s)):
            return "refusal", ""
        want = self.index.get(target or "", -1)
        st = stem(s, cs)
        if not differ and ks and len(kt) % len(ks) == 0 and kt == ks * (n := len(kt) // len(ks)):
            if n > 1:
                return "copy", ""
            if not st:
                return None, ""
            if want >= 0 and first == want and len(st) > 24:
                return None, ""
            return "copy", st if len(st) <= COPY_WORD else ""
        if want < 0:
            return None, ""
        wt = stem(t, ct)
        if _SPOKEN.search(wt):
            # the text's language: all that are near its best, as short words belong to several
            ours = {want, *near} if _SPOKEN.search(st) else {want, *range(len(b))} if not st else {want}
            ours |= self.words.get(st, frozenset())
            best = max(b[k] for k in ours)
            known = self.words.get(wt)
            if known is not None:
                if known and not (known & ours):
                    return "language", ""
            elif k not in ours and b[k] - best > LANGUAGE_MARGIN:
                return "language", ""
        whole = t.rstrip()
        if _OPEN_END.search(whole) and not _OPEN_END.search(s.rstrip()):
            return "truncated", ""
        if wt:
            # a sentence whose rendering ends like a label is likelier cut off than the ending alone tells
            bare = (_FINAL.search(s.rstrip()) or len(s) > 30 and "\u0e00" <= s.strip()[0] <= "\u0e7f") and not _FINAL.search(whole) and target != "th"
            if self.endings.likelihood(whole, target) * (BARE_END if bare else 1.0) < END_LEAST:
                return "truncated", ""
        tail = _TAIL.search(whole) if whole[-1].isdigit() or whole[-1] in "-/.," or whole[-1].isupper() else None
        if tail and tail[0] not in _TOKEN.findall(s) and any(x != tail[0] and x.replace(".", ",").startswith(tail[0].replace(".", ",")) for x in _TOKEN.findall(s)) and not re.search(r"\d", whole[tail.end() :]):
            have = Counter(x.replace(".", ",") for x in _TOKEN.findall(t))
            lack = [x for x in _TOKEN.findall(s) if not have[x.replace(".", ",")]]
            if lack and any(x.replace(".", ",").startswith(tail[0].replace(".", ",")) for x in lack):
                return "truncated", ""
        return None, ""


def word_languages(uses: dict[str, Counter[int]], sizes: Counter[int]) -> dict[str, frozenset[int]]:
    """The languages of each wording, from its uses by language and the uses of all."""
    words = {}
    for w, c in uses.items():
        if c.total() >= WORD_SEEN:
            rates = {k: n / (sizes[k] + 50) for k, n in c.items()}
            # a few uses may be wrong labels
            words[w] = frozenset(k for k, r in rates.items() if r >= WORD_RATE * max(rates.values()) and c[k] >= max(3, WORD_PART * c.total()))
    return words


def fit_model(rows: list[tuple[str | None, str | None, str | None, str | None]], langs: list[str]) -> PairModel:
    """From (text, its language label, translation, target)."""
    data = [(plain_form(s), lang) for s, lang, _, _ in rows if s] + [(plain_form(t), target) for _, _, t, target in rows if t]
    nb = naivebayes.fit(data, langs)
    by: dict[str, Counter[str]] = defaultdict(Counter)
    for _, _, t, target in rows:
        if t and target and letters(t) and not _OPEN_END.search(t.rstrip()):
            by[target][shape(plain_form(t).rstrip())] += 1
    alive = {c: k for k, c in enumerate(nb.langs) if nb.prior[k] > -20}
    uses: dict[str, Counter[int]] = defaultdict(Counter)
    for text, lang in data:
        if lang in alive and len(text) <= 2 * WORD_CHARS and (w := stem(text)) and len(w) <= WORD_CHARS:
            uses[w][alive[lang]] += 1
    sizes: Counter[int] = Counter()
    for c in uses.values():
        sizes.update(c)
    words = word_languages(uses, sizes)
    seen = [(plain_form(s or ""), plain_form(t), target) for s, _, t, target in rows if t]
    return PairModel(nb, Endings(by), words, fit_refusals([(s, t, naivebayes.clean(t), target) for s, t, target in seen]))


# -- Spark ------------------------------------------------------------------------------------------


def fit_on(pairs, langs: list[str], codes: dict[str, str]):
    """``fit_model`` on all ``pairs`` (text, label, translation, target), broadcast.

    One pass takes from the pairs the cleaned texts, the short wordings and the different translations (by shape and
    target), counted together, equal pairs once, as far as a worker holds them. What reaches the driver: the n-gram counts of the languages, the
    wordings seen ``WORD_SEEN`` times, the different longest endings with their counts, and the words that
    tell refusals from renderings.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    from foliolake.llm import sentences
    from foliolake.session import checkpointed

    sc = pairs.sparkSession.sparkContext
    index = {c: k for k, c in enumerate(langs)}
    fields = pa.schema([("kind", pa.int32()), ("a", pa.string()), ("lab", pa.int32()), ("target", pa.string()), ("n", pa.int64()), ("s", pa.string()), ("t", pa.string()), ("tail", pa.string())])

    def tallied(batches):
        seen: Counter[tuple] = Counter()
        for batch in batches:
            for part in sentences.slices([batch], 5_000):
                seen.update(zip(*(c.to_pylist() for c in part.columns), strict=True))
                if len(seen) > HELD:
                    yield seen
                    seen = Counter()
        yield seen

    def parts(batches):
        for seen in tallied(batches):
            texts: Counter[tuple[str, int]] = Counter()
            words: Counter[tuple[str, int]] = Counter()
            kinds: dict[tuple[str, str | None], list] = {}
            forms: dict[str, tuple[str, str, str]] = {}
            labels = {x: index.get(naivebayes.normal_label(x, codes) or "", -1) for x in {row[1] for row in seen}}

            def formed(x, forms=forms):
                """Plain form, cleaned and, of a short one, its stem."""
                found = forms.get(x)
                if found is None:
                    p = plain_form(x)
                    w = stem(p) if len(p) <= 2 * WORD_CHARS else ""
                    found = forms[x] = p, naivebayes.clean(p), w if len(w) <= WORD_CHARS else ""
                return found

            for (s, label, t, target), n in seen.items():
                (s, *more), (t, *most) = formed(s), formed(t)
                for x, (c, w), lab in ((s, more, labels[label]), (t, most, index.get(target or "", -1))):
                    if x:
                        texts[c, lab] += n
                        if lab >= 0 and w:
                            words[w, lab] += n
                if t:
                    whole = t.rstrip()
                    a = shape(whole)
                    one = kinds.get((a, target))
                    if one is None:
                        one = kinds[a, target] = [0, s, t, (f"^{a}"[-END_ORDER:] if len(whole) < 64 else ending(whole)) if target and (letters(t[:8]) or letters(t)) else None]
                    if one[3] is not None and not _OPEN_END.search(whole):
                        one[0] += n
            for kind, c in enumerate((texts, words)):
                yield record({"kind": [kind] * len(c), "a": [a for a, _ in c], "lab": [lab for _, lab in c], "n": list(c.values())})
            ns, ss, ts, tails = zip(*kinds.values(), strict=True) if kinds else ((), (), (), ())
            yield record({"kind": [2] * len(kinds), "a": [a for a, _ in kinds], "lab": [-1] * len(kinds), "target": [x for _, x in kinds], "n": ns, "s": ss, "t": ts, "tail": tails})

    def record(columns):
        size = len(columns["kind"])
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in fields], schema=fields)

    rows = pairs.select("text", "label", "translation", "target").filter("text is not null and translation is not null")
    seen = checkpointed(rows.mapInArrow(parts, "kind int, a string, lab int, target string, n long, s string, t string, tail string"))
    nb = naivebayes.fit_on(seen.filter("kind = 0").select(F.col("a").alias("t"), "lab", "n"), langs)

    alive = [k for k in range(len(langs)) if nb.prior[k] > -20]
    used = seen.filter(F.col("kind") == 1).filter(F.col("lab").isin(alive)).groupBy("a", "lab").agg(F.sum("n").alias("n"))
    sizes = Counter({r["lab"]: r["n"] for r in used.groupBy("lab").agg(F.sum("n").alias("n")).collect()})
    common = used.groupBy("a").agg(F.collect_list(F.struct("lab", "n")).alias("c"), F.sum("n").alias("all")).filter(F.col("all") >= WORD_SEEN)
    words = word_languages({r["a"]: Counter({x["lab"]: x["n"] for x in sorted(r["c"])}) for r in common.select("a", "c").toLocalIterator()}, sizes)

    kinds = seen.filter("kind = 2").groupBy("a", "target").agg(F.sum("n").alias("n"), F.min(F.struct("s", "t", "tail")).alias("x"))
    kinds = checkpointed(kinds.select("a", "target", "n", "x.*"))
    return sc.broadcast(PairModel(nb, endings_on(kinds), words, refusals_on(kinds)))


def endings_on(kinds) -> Endings:
    """``Endings`` of ``kinds`` (a: shape, target, n, tail): the places of all endings that any translation has."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    longest: dict[str, dict[str, int]] = defaultdict(dict)
    for r in kinds.filter("tail is not null").groupBy("target", "tail").agg(F.sum("n").alias("n")).orderBy("target", "tail").toLocalIterator():
        longest[r["target"]][r["tail"]] = r["n"]
    tables = kinds.sparkSession.sparkContext.broadcast({lang: EndingTable(list(c)) for lang, c in longest.items()})

    def count(batches):
        sums = {lang: np.zeros(t.offsets[-1]) for lang, t in tables.value.items()}
        for batch in batches:
            by: dict[str, list[tuple[str, int]]] = defaultdict(list)
            for a, lang, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by[lang].append((f"^{a}", n))
            for lang, some in by.items():
                tables.value[lang].add(sums[lang], [a for a, _ in some], [n for _, n in some])
        for lang, c in sums.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(c[some])], names=["target", "gram", "n"])

    got = kinds.filter("tail is not null and n > 0").select("a", "target", "n").mapInArrow(count, "target string, gram long, n double")
    got = got.groupBy("target", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= END_SEEN).toArrow()
    names = {lang: tables.value[lang].grams(list(c)) for lang, c in longest.items()}
    every: dict[str, dict[str, float]] = {lang: {} for lang in longest}
    for lang, gram, n in zip(*(c.to_pylist() for c in got.columns), strict=True):
        every[lang][names[lang][gram]] = n
    last: dict[str, dict[str, float]] = {lang: defaultdict(float) for lang in longest}
    for lang, c in longest.items():
        for t, n in c.items():
            for k in range(1, len(t) + 1):
                last[lang][t[-k:]] += n
    return Endings.counted(every, last)


def refusals_on(kinds, rounds: int = 2) -> Refusals:
    """``fit_refusals`` on ``kinds`` (s, t, target), each different translation once."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from foliolake.session import checkpointed

    sc = kinds.sparkSession.sparkContext
    rows, every, hits = kinds.select("s", "t", "target"), None, None

    def emitted(names, *counters):
        keys = list(counters[0])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counters)], names=names)

    def first(batches):
        for batch in batches:
            both: Counter[str] = Counter()
            yes: Counter[str] = Counter()
            for s, t, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # the empty word counts the translations
                f = refusal_features(naivebayes.clean(t))
                f.add("")
                both.update(f)
                if first_refusal(s, t, target):
                    yes.update(f)
            yield emitted(["f", "n", "yes"], both, yes)

    for turn in range(rounds):
        if not turn:
            every = checkpointed(rows.mapInArrow(first, "f string, n long, yes long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("yes").alias("yes")))
            counts = every
        else:
            # the features of all stay counted; anew only those of the refusals
            now = sc.broadcast(model)

            def again(batches, now=now):
                for batch in batches:
                    yes: Counter[str] = Counter()
                    for s, t, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        c = naivebayes.clean(t)
                        if now.value.score(s, t, c, (target,)) > REFUSAL_LEAST:
                            yes.update(refusal_features(c) | {""})
                    yield emitted(["f", "yes"], yes)

            hits = rows.mapInArrow(again, "f string, yes long").groupBy("f").agg(F.sum("yes").alias("yes"))
            counts = checkpointed(every.drop("yes").join(hits, "f", "left").select("f", "n", F.coalesce("yes", F.lit(0)).alias("yes")))
        total = counts.filter("f = ''").first()
        if total is None or total["yes"] < 5 or total["yes"] > total["n"] // 2:
            return Refusals({})
        n, rest = total["yes"], total["n"] - total["yes"]
        got = counts.withColumn("no", F.col("n") - F.col("yes")).filter((F.col("f") != "") & ((F.col("yes") >= 2) | (F.col("yes") == 0) & (F.col("no") * (n + 1.0) / (rest + 1.0) > 0.3))).collect()
        model = refusal_model({r["f"]: r["yes"] for r in got if r["yes"]}, {r["f"]: r["no"] for r in got if r["no"]}, n, rest)
    return model


def broken_pairs(pairs, model):
    """rec_kind, rec_id, defect of ``pairs`` (rec_kind, rec_id, text, translation, target).

    One pass decides all but the copied words; those are joined to the share of rows that leave
    the word as it is, counted over all rows with a map-side combine.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    schema = pa.schema([("rec_kind", pa.string()), ("rec_id", pa.int64()), ("defect", pa.string()), ("stem", pa.string()), ("target", pa.string())])

    def run(batches):
        m, kept_pairs = model.value, {}
        for batch in batches:
            kinds, ids, texts, translations, targets = (c.to_pylist() for c in batch.columns)
            found = m.decided(zip(texts, translations, targets, strict=True), kept_pairs)
            # a row that needs no look-up gets a key of its own, so that these are no hot group
            rows = [(k, i, d, s or f"\0{n}", t) for n, (k, i, (d, s), t) in enumerate(zip(kinds, ids, found, targets, strict=True)) if d]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], f.type) for n, f in enumerate(schema)], schema=schema)

    some = pairs.filter("translation is not null and trim(text) rlike '\\\\S'").select("rec_kind", "rec_id", "text", "translation", "target")
    found = some.mapInArrow(run, "rec_kind string, rec_id long, defect string, stem string, target string")
    code = r"[A-Z]{1,2}[-/]?\d+|\d+([.,]\d+)*"
    bare = lambda c: F.when(F.col(c).rlike(r"\d"), F.regexp_replace(c, code, " ")).otherwise(F.col(c))
    word = lambda c: F.lower(F.trim(F.regexp_replace(bare(c), r"[^\p{L}\p{M}\p{N}]+", " ")))
    # as one element of an array, so that each word is made once and not again for every condition on it
    short = F.filter(F.array(word("text")), lambda x: (x != "") & (F.length(x) <= COPY_WORD))
    same = lambda x: F.when(F.col("text") == F.col("translation"), True).otherwise(x == word("translation"))
    kept = (
        some.select("rec_kind", "rec_id", "target", F.inline(F.transform(short, lambda x: F.struct(x.alias("stem"), same(x).alias("same")))))
        .distinct()
        .groupBy("stem", "target")
        .agg(F.avg(F.col("same").cast("int")).alias("share"), F.count("*").alias("n"))
        .filter("share >= 0.5 and n >= 3")
        .select("stem", "target", F.lit(True).alias("kept"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = found.withColumn("salt", F.coalesce(F.pmod("rec_id", F.lit(SALTS)), F.lit(0)).cast("int"))
    return salted.join(kept, ["stem", "target", "salt"], "left").filter("kept is null or defect <> 'copy'").select("rec_kind", "rec_id", "defect").distinct()
