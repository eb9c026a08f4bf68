"""Sentence boundaries across languages and scripts, by a hidden-event n-gram language model.

Text is a sequence of symbols - words in spaced scripts, characters in unspaced ones; numbers and
part codes are one symbol each - with a hidden event between any two: a boundary B or none. One
interpolated n-gram model (Witten-Bell) gives the probability of symbols and boundaries together.
At the gaps where a boundary is possible (after closing punctuation, at line breaks, at the spaces
of scripts without periods, and within unspaced runs wherever the model has seen units end before
and begin behind) the forward-backward algorithm over all placings of boundaries gives
each gap's posterior. Line layout - full and short lines, blank lines, list marks, headings -
enters as log-odds, as prosody does in spoken text; no gap is decided by it alone.

The model is fitted on the pages themselves: list items and the lines of unwrapped pages are units
whose limits the layout shows. Headers and page numbers are left out; list marks are no part of a
unit, a heading's number is.

Defined results: null, empty and blank texts have no units; offsets are code points of the stored
text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable

from foliolake.llm import pagetext

ORDER = 7
#: Stretches of gaps whose model scores a worker keeps.
CACHE = 40_000
#: Log-probabilities that a worker keeps.
KNOWN = 150_000
_UN = "぀-ヿ㐀-鿿豈-﫿々〆〇ｦ-ﾟ"
_TH = "฀-๿"
_SYMBOL = re.compile(rf"(?P<code>[A-Z]{{1,2}}[-/]?\d{{1,5}}(?![^\W\d_{_UN}{_TH}]))|(?P<num>\d+(?:[.,]\d+)*)|(?P<un>[{_UN}])|(?P<th>[{_TH}])|(?P<word>[^\W\d_{_UN}{_TH}]+)|(?P<punct>[^\s])")
_UNSPACED = re.compile(f"[{_UN}]")
_ENDERS = frozenset(".!?…。！？．‼⁇⁈⁉")
_CLOSERS = frozenset("\"'”’»」』）)]›“")
_WIDE_END = frozenset("。！？．」』”")
B = "\x00"
#: Part of the units of unspaced scripts that are counted as if their last mark was missing; least probability of an end, and log-odds, of a gap within a run.
UNMARKED, RUN_END, RUN_ODDS = 0.2, 0.02, -2.0
#: Least count of a context of over two symbols.
LEAST_CONTEXT = 2
#: Gaps of a stretch up to which its placings are tabled and kept; longer stretches are decided in proportion to their length.
TABLED_GAPS = 12


def symbols(text: str, lo: int, hi: int) -> list[tuple[str, int, int, str]]:
    """(symbol, start, end, class) of text[lo:hi]; classes: w(ord), u(nspaced), t(hai), n, c, p."""
    out = []
    for m in _SYMBOL.finditer(text, lo, hi):
        kind = m.lastgroup
        if kind == "word":
            out.append((m[0], m.start(), m.end(), "w"))
        elif kind == "un":
            out.append((m[0], m.start(), m.end(), "u"))
        elif kind == "th":
            out.append((m[0], m.start(), m.end(), "t"))
        elif kind == "code":
            out.append(("#", m.start(), m.end(), "c"))
        elif kind == "num":
            out.append(("0", m.start(), m.end(), "n"))
        else:
            out.append((m[0], m.start(), m.end(), "p"))
    return out


def unit_grams(units: dict[tuple[str, ...], float]) -> dict[tuple[str, ...], float]:
    """Counts of the n-grams of units (n-gram of up to ``ORDER`` symbols: a context and what follows)."""
    out: dict[tuple[str, ...], float] = defaultdict(int)
    for unit, n in units.items():
        line = (B, *unit, B)
        for i in range(1, len(line)):
            for k in range(max(0, i - ORDER + 1), i + 1):
                out[line[k : i + 1]] += n
    return out


class Model:
    """Interpolated n-gram counts over symbols and B."""

    def __init__(self, units: dict[tuple[str, ...], float]):
        follow: dict[tuple[str, ...], dict[str, float]] = defaultdict(dict)
        for (*h, x), n in unit_grams(units).items():
            follow[tuple(h)][x] = n
        self._fill(follow)

    @classmethod
    def counted(cls, follow: dict[tuple[str, ...], dict[str, float]]) -> Model:
        """From the counts of the symbols that follow each context."""
        out = cls.__new__(cls)
        out._fill(follow)
        return out

    def _fill(self, follow: dict[tuple[str, ...], dict[str, float]]) -> None:
        self.known: dict[tuple[str, ...], float] = {}
        self.size = max(1000, len(follow.get((), ())))
        #: context -> (log of what is left to the shorter context, symbol -> log-probability); both interpolated already
        self.ctx: dict[tuple[str, ...], tuple[float, dict[str, float]]] = {}
        for h in sorted(follow, key=len):
            c = follow[h]
            total, types = sum(c.values()), len(c)
            if len(h) > 2 and total < LEAST_CONTEXT:
                continue
            rest = math.log(types / (total + types))
            self.ctx[h] = rest, {x: math.log((n + types * math.exp(self._lp(x, h[1:]) if h else -math.log(self.size))) / (total + types)) for x, n in c.items()}
        self.cache: dict = {}

    def lp(self, sym: str, hist: tuple[str, ...]) -> float:
        """Log-probability of a symbol after the last symbols (fewer than ``ORDER``)."""
        found = self.known.get(key := (*hist, sym))
        return self._keyed(key) if found is None else found

    def _keyed(self, key: tuple[str, ...]) -> float:
        found = self._lp(key[-1], key[:-1])
        if len(self.known) < KNOWN:
            self.known[key] = found
        return found

    def _lp(self, sym: str, hist: tuple[str, ...]) -> float:
        left = 0.0
        get = self.ctx.get
        for k in range(len(hist) + 1):
            found = get(hist[k:])
            if found is not None:
                p = found[1].get(sym)
                if p is not None:
                    return left + p
                left += found[0]
        return left - math.log(self.size)

    def spans(self, window: tuple[str, ...], gaps: tuple[int, ...]) -> list[list[float]]:
        """seg[a][b]: log-probability of the stretch between the chosen boundaries a and b.

        Gap k stands before window[gaps[k]]. Row 0 has no boundary before it (the context goes on
        to the left); the last column is the window's right edge, where no boundary is asked for.
        """
        key = (window, gaps)
        if (found := self.cache.get(key)) is not None:
            return found
        size, free = len(window), ORDER - 1
        edges = [0, *gaps, size]
        first = gaps[0]
        known, lp = self.known.get, self._keyed
        # out of a boundary's sight its row goes on like that without one
        plain = [p if (p := known(g := window[max(0, i - free) : i + 1])) is not None else lp(g) for i in range(first, size)]
        ends = [p if (p := known(g := (*window[max(0, e - free) : e], B))) is not None else lp(g) for e in gaps]
        seg = []
        for a in range(len(gaps) + 1):
            row: list[float] = [0.0] * (len(edges))
            at, sight = (first, 0) if a == 0 else (edges[a], edges[a] + free)
            start, total = at, 0.0
            for b in range(max(a + 1, 1), len(edges)):
                edge = edges[b]
                while at < edge:
                    if at >= sight:
                        total += plain[at - first]
                    else:
                        g = (B, *window[start : at + 1])
                        total += p if (p := known(g)) is not None else lp(g)
                    at += 1
                if b == len(edges) - 1:
                    row[b] = total
                elif edge >= sight:
                    row[b] = total + ends[b - 1]
                else:
                    g = (B, *window[start:edge], B)
                    row[b] = total + (p if (p := known(g)) is not None else lp(g))
            seg.append(row)
        if len(self.cache) < CACHE:
            self.cache[key] = seg
        return seg

    def may_end(self, before: str, last: str, first: str) -> bool:
        """True if units have been seen to end in the first two symbols and to begin with the third."""
        if first not in self.ctx[(B,)][1]:
            return False
        found = self.ctx.get((before, last))
        return found is not None and found[1].get(B, -99.0) >= math.log(RUN_END)

    def linear(self, window: tuple[str, ...], gaps: tuple[int, ...], odds: list[float]) -> list[float]:
        """The same posteriors with a work in proportion to the window.

        The model looks back ``ORDER`` - 1 symbols, so a state is the number of symbols since the last
        boundary, up to the point from which the boundary is out of sight.
        """
        free = ORDER - 1
        first, size = gaps[0], len(window)
        at = {g: k for k, g in enumerate(gaps)}
        hist = lambda d, i: window[max(0, i - free) : i] if d == free else (B, *window[i - d : i])
        states: dict[int, float] = {free: 0.0}
        steps: list[tuple[dict[int, float], dict[int, float]]] = []  # at each place: log-probabilities of a boundary, of the symbol, by state
        into: list[float] = []
        for i in range(first, size):
            ends: dict[int, float] = {}
            if i in at:
                ends = {d: self.lp(B, hist(d, i)) + odds[at[i]] for d in states}
                states[0] = _sum([states[d] + x for d, x in ends.items()])
                into.append(states[0])
            goes = {d: self.lp(window[i], hist(d, i)) for d in states}
            steps.append((ends, goes))
            after: dict[int, list[float]] = defaultdict(list)
            for d, x in goes.items():
                after[min(d + 1, free)].append(states[d] + x)
            states = {d: _sum(xs) for d, xs in after.items()}
        whole = _sum(list(states.values()))
        back = dict.fromkeys(states, 0.0)
        out = []
        for i in range(size - 1, first - 1, -1):
            ends, goes = steps[i - first]
            now = {d: x + back[min(d + 1, free)] for d, x in goes.items()}
            if ends:
                out.append(math.exp(min(0.0, into.pop() + now[0] - whole)))
                begun = now[0]
                now = {d: _sum([now[d], x + begun]) if d in now else x + begun for d, x in ends.items()}
            back = now
        return out[::-1]

    def posteriors(self, window: tuple[str, ...], gaps: tuple[int, ...], odds: list[float]) -> list[float]:
        """Forward-backward over the placings of boundaries in one stretch of near gaps."""
        if len(gaps) > TABLED_GAPS:
            return self.linear(window, gaps, odds)
        seg = self.spans(window, gaps)
        k = len(gaps)
        neg = -1e30
        forward = [neg] * (k + 1)
        forward[0] = 0.0
        for b in range(1, k + 1):
            forward[b] = _sum([forward[a] + seg[a][b] for a in range(b)]) + odds[b - 1]
        backward = [neg] * (k + 1)
        for a in range(k, -1, -1):
            backward[a] = _sum([seg[a][b] + odds[b - 1] + backward[b] for b in range(a + 1, k + 1)] + [seg[a][k + 1]])
        whole = backward[0]
        return [math.exp(min(0.0, forward[b] + backward[b] - whole)) for b in range(1, k + 1)]


def _sum(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs)) if m > -1e29 else -1e30


class Line:
    __slots__ = ("start", "end", "head", "mark", "blank", "size", "skip")

    def __init__(self, text: str, start: int, end: int, skip: bool):
        self.start, self.end, self.skip = start, end, skip
        body = text[start:end]
        self.blank = not body.strip()
        m = None if self.blank else pagetext.LIST_MARK.match(body)
        self.mark = m is not None
        self.head = start + (m.end() if m else len(body) - len(body.lstrip()))
        self.size = len(body.rstrip())


def page_lines(text: str, kinds: list[str | None]) -> list[Line]:
    out, at = [], 0
    for s, k in zip(text.split("\n"), kinds, strict=True):
        out.append(Line(text, at, at + len(s), k is not None))
        at += len(s) + 1
    return out


_HEADING = re.compile(r"\d{1,2}(?:\.\d{1,2})+\s+\S")
_ATOM = re.compile(rf"[A-Za-z0-9/.,°²-]+|[^\s]")
#: Log-odds of the layout (prosody) model.
ALWAYS, BLANK, SHORT, FULL, AFTER_HEADING, NEVER = 14.0, 9.0, 6.0, -1.0, 8.0, -14.0


class Segmenter:
    def __init__(self, model: Model, threshold: float = 0.5):
        self.model, self.threshold = model, threshold
        self.vocabulary = model.ctx.get((), (0.0, {}))[1]

    def units(self, text: str, kinds: list[str | None], wrapped: bool | None = None) -> list[tuple[int, int]]:
        """(start, end) of each unit."""
        lines = [x for x in page_lines(text, kinds)]
        body = [x for x in lines if not x.skip]
        width = pagetext.wrap_width([text[x.start : x.end].rstrip() for x in body if not x.blank]) if wrapped is not False else 0
        syms: list[tuple[str, int, int, str]] = []
        odds_before: dict[int, float] = {}  # index of symbol -> log-odds of the break before it
        prev: Line | None = None
        blank = skipped = False
        for x in lines:
            if x.skip:
                skipped = True
                continue
            if x.blank:
                blank = True
                continue
            new = symbols(text, x.head, x.end)
            if not new:
                continue
            if prev is None or x.mark:
                odds_before[len(syms)] = ALWAYS
            else:
                o = self._layout(text, prev, x, width, blank, skipped)
                rest = self._mend(syms, new) if o == NEVER else new
                if len(rest) == len(new):
                    odds_before[len(syms)] = o
                new = rest  # what follows a mended word is within the line
            syms += new
            prev, blank, skipped = x, False, False
        if not syms:
            return []
        starts = self._decide(text, syms, odds_before)
        out = []
        for a, b in zip(starts, [*starts[1:], len(syms)], strict=True):
            out.append((syms[a][1], syms[b - 1][2]))
        return out

    def _mend(self, syms: list, new: list) -> list:
        """One symbol for a code or known word broken at the line end; what is left of the new line's symbols."""
        sign = len(syms) > 1 and syms[-1][3] == "p" and len(syms[-1][0]) == 1
        left = syms[-2] if sign else syms[-1] if syms else None
        at = 0 if sign else 1  # the sign may stand on the new line
        if left is None or left[3] != "w" or len(new) <= at or not sign and (new[0][0] not in ("-", "/")):
            return new
        right = new[at]
        if right[3] == "n" and left[0].isupper() and len(left[0]) <= 2:
            name, kind = "#", "c"
        elif sign and right[3] == "w" and (left[0] + right[0]) in self.vocabulary:
            name, kind = left[0] + right[0], "w"
        else:
            return new
        del syms[-2 if sign else -1 :]
        syms.append((name, left[1], right[2], kind))
        return new[at + 1 :]

    def _layout(self, text: str, prev: Line, x: Line, width: int, blank: bool, skipped: bool) -> float:
        last = text[prev.start : prev.end].rstrip()
        nxt = text[x.head]
        if last[-1] in "-‐­¬/" and len(last) > 1 and last[-2].isalnum() and (nxt.isdigit() or nxt.islower()) or nxt in "-/" and last[-1].isupper() and text[x.head + 1 : x.head + 2].isdigit():
            return NEVER  # a word or code broken at the line end
        heading = bool(_HEADING.match(text, prev.head)) and prev.size <= 48 and last[-1] not in ".。!?！？,、，;；"
        if blank:
            return BLANK if not skipped else 3.0
        if _HEADING.match(text, x.head) and x.size <= 48 and text[x.end - 1] not in ".。,、，;；":
            return 6.0
        if heading and (not width or prev.size < 0.8 * width):
            return AFTER_HEADING
        if not width:
            return ALWAYS if not skipped else 0.5
        c = text[x.head]
        if "぀" <= c <= "鿿" or "＀" <= c:
            room = 3
        else:
            room = 1 + len(re.match(r"\S+", text[x.head : x.head + 80])[0])
            if "぀" <= last[-1] <= "鿿" or "＀" <= last[-1] or last[-1] in "、。」”":
                room = min(room, len(_ATOM.match(text, x.head)[0])) + 2
        if prev.size + room <= width:
            return SHORT if not skipped else 2.0
        return FULL

    def _decide(self, text: str, syms: list[tuple[str, int, int, str]], odds_before: dict[int, float]) -> list[int]:
        starts = [0]
        names = tuple(s[0] for s in syms)
        gaps: list[int] = []
        odds: list[float] = []

        def flush(hi: int) -> None:
            if not gaps:
                return
            lo = max(starts[-1], gaps[0] - ORDER + 1)
            left: tuple[str, ...] = (B,) if lo == starts[-1] else ()
            window = left + names[lo : min(hi, gaps[-1] + ORDER - 1)]
            shift = len(left) - lo
            post = self.model.posteriors(window, tuple(g + shift for g in gaps), odds)
            starts.extend(g for g, p in zip(gaps, post, strict=True) if p >= self.threshold)
            gaps.clear()
            odds.clear()

        for i in range(1, len(syms)):
            o = odds_before.get(i)
            a, b = syms[i - 1], syms[i]
            if o is None:
                if not self._possible(text, syms, i, a, b):
                    continue
                run = a[2] == b[1] and a[3] == b[3] == "u"
                o = RUN_ODDS if run else -2.0 if b[3] == "w" and b[0][0].islower() else 0.0
            elif o < BLANK:
                # no sentence ends in a comma or begins with one, few units begin with a small letter: whatever the layout, the words decide
                if a[0] in ",;:、，；：" or b[0] in ",;:、，；：":
                    o = min(o - 4.0, -3.0)
                elif b[3] == "w" and b[0][0].islower():
                    o = min(o, -2.0)
            if gaps and i - gaps[-1] >= ORDER:
                flush(i + ORDER)
            gaps.append(i)
            odds.append(o)
        flush(len(syms))
        return starts

    def _possible(self, text: str, syms: list, i: int, a: tuple, b: tuple) -> bool:
        """A boundary may stand between two symbols of a line."""
        space = b[1] > a[2]
        if not space:
            if a[3] == "u" and b[3] == "u":
                return i > 1 and self.model.may_end(syms[i - 2][0], a[0], b[0])
            return (a[0] in _WIDE_END) and b[3] != "p" or a[0] in "。！？" and b[0] in "「『“"
        if a[3] == "t" or b[3] == "t":
            return b[3] != "p" or b[0] in "\"“"
        if b[0] in _CLOSERS and b[0] != "“" and b[0] not in "\"'":
            return False
        if a[0] in _ENDERS:
            return True
        if a[3] == "u" or b[3] == "u":
            return b[3] != "p"
        if a[3] == "w" and (b[0][0].isupper() or b[3] == "c"):
            # a heading run on: a unit of a few words may have ended
            for j in range(i - 2, max(-1, i - 5), -1):
                if syms[j][0] in _ENDERS:
                    return True
            return i <= 3 or "\n" in text[syms[i - 4][2] : a[1]]
        if a[0] in _CLOSERS:
            j = i - 2
            while j >= 0 and syms[j][0] in _CLOSERS:
                j -= 1
            return j >= 0 and syms[j][0] in _ENDERS
        return False


def training_units(text: str, kinds: list[str | None]) -> list[tuple[str, ...]]:
    """Units of a page whose limits the layout shows: list items and, if it isn't wrapped, the sentences of its lines."""
    lines = page_lines(text, kinds)
    body = [x for x in lines if not x.skip and not x.blank]
    width = pagetext.wrap_width([text[x.start : x.end].rstrip() for x in body])
    out: list[tuple[str, ...]] = []
    for n, x in enumerate(lines):
        if x.skip or x.blank:
            continue
        after = lines[n + 1] if n + 1 < len(lines) else None
        alone = after is None or after.blank or after.mark
        if x.mark and alone:
            item = tuple(s[0] for s in symbols(text, x.head, x.end))
            # an item of several sentences, where their marks are plain
            out += rule_units(text, x.head, x.end) if any(c in item[:-1] for c in "。！？") else [item]
        elif x.mark and width:
            m = n + 1
            while m < len(lines) and not lines[m].mark and not lines[m].blank and not lines[m].skip and m - n < 5:
                m += 1
            if m < len(lines) and lines[m].mark and all(lines[k].size >= 0.7 * width for k in range(n, m - 1)):
                item = tuple(s[0] for k in range(n, m) for s in symbols(text, lines[k].head, lines[k].end))
                if not any(c in item[:-1] for c in "。！？"):
                    out.append(item)
        elif not width:
            out += rule_units(text, x.head, x.end)
        elif _HEADING.match(text, x.head) and x.size <= 40 and (after is None or after.blank):
            out.append(tuple(s[0] for s in symbols(text, x.head, x.end)))
    return [u for u in out if u]


def rule_units(text: str, lo: int, hi: int) -> list[tuple[str, ...]]:
    """Sentences of one unwrapped line, where the rule is sure; nothing for Thai."""
    syms = symbols(text, lo, hi)
    if any(s[3] == "t" for s in syms):
        return [tuple(s[0] for s in syms)] if len(syms) < 25 else []
    out, start, depth = [], 0, 0
    for i in range(1, len(syms)):
        a, b = syms[i - 1], syms[i]
        if a[0] == '"':
            depth = 1 - depth
        elif a[0] in "「『„«“" and not (a[0] == "“" and depth):
            depth = 1
        elif a[0] in "」』»”" or a[0] == "“":
            depth = 0
        if depth:
            continue
        if a[0] in "。！？" or a[0] in ".!?" and b[1] > a[2] and (b[0][:1].isupper() or b[0] in "¿¡#"):
            short = i >= 2 and syms[i - 2][3] == "w" and (len(syms[i - 2][0]) == 1 or len(syms[i - 2][0]) == 2 and syms[i - 2][0].islower())
            if a[0] == "." and short and (i < 3 or syms[i - 3][3] != "n"):
                return []  # an abbreviation, which may end a sentence as well: not sure
            if b[3] == "p" and b[0] in _CLOSERS:
                continue
            out.append((start, i))
            start = i
    if not depth:  # a quotation left open may hide an end
        out.append((start, len(syms)))
    return [tuple(s[0] for s in syms[a:b]) for a, b in out if b > a]


def fit_model(pages: Iterable[tuple[str, str | None, int | None]]) -> Model:
    """The model from (text, title, page number) of pages."""
    units: Counter[tuple[str, ...]] = Counter()
    for text, title, number in pages:
        units.update(page_training(text, title, number))
    # a line that reads like a unit only because it is noisy is rare; it does no harm
    bare = {u[:-1]: n * UNMARKED for u, n in units.items() if marked(u)}
    return Model({u: units.get(u, 0) + bare.get(u, 0.0) for u in {**units, **bare}})


def page_training(text: str, title: str | None, number: int | None) -> list[tuple[str, ...]]:
    return training_units(text, pagetext.furniture(text.split("\n"), title, number))


def marked(u: tuple[str, ...]) -> bool:
    """True for a unit of an unspaced script that ends in a mark."""
    return len(u) > 3 and u[-1] in "。！？" and _UNSPACED.match(u[-2]) is not None


def page_units(text: str, title: str | None, number: int | None, segmenter: Segmenter) -> list[tuple[int, int]]:
    if not text or text.isspace():
        return []
    return segmenter.units(text, pagetext.furniture(text.split("\n"), title, number))


# -- Spark ------------------------------------------------------------------------------------------


def slices(batches, rows: int = 1_000):
    """Batches in parts, so that a worker holds the Python objects of few pages at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fit_on(pages, text: str = "ocr_text"):
    """The model fitted on all rows of ``pages`` (title, page_number, text), broadcast.

    Equal units are counted together, within a slice of pages and before the shuffle; the n-grams of the
    different units are counted the same way, each unit as often as it was seen. What reaches the
    driver are the n-grams the model keeps: all but those whose context was seen less than ``LEAST_CONTEXT`` times.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    def units(batches):
        for batch in slices(batches):
            found: Counter[str] = Counter()
            for t, title, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.update(map(" ".join, page_training(t, title, number)))  # no symbol holds white space
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["unit", "n"])

    def grams(batches):
        for batch in slices(batches, 5_000):
            seen = {tuple(u.split(" ")): n for u, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
            plain, bare = unit_grams(seen), unit_grams({u[:-1]: n for u, n in seen.items() if marked(u)})
            keys = list({**plain, **bare})
            columns = [pa.array([" ".join(g[:-1]) for g in keys], pa.string()), pa.array([len(g) - 1 for g in keys], pa.int32()), pa.array([g[-1] for g in keys], pa.string())]
            columns += [pa.array([c.get(g, 0) for g in keys], pa.int64()) for c in (plain, bare)]
            yield pa.RecordBatch.from_arrays(columns, names=["context", "size", "symbol", "n", "bare"])

    rows = pages.select(F.col(text).alias("t"), "title", "page_number").filter("t is not null")
    counts = rows.mapInArrow(units, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    counts = counts.mapInArrow(grams, "context string, size int, symbol string, n long, bare long").groupBy("context", "size", "symbol").agg((F.sum("n") + UNMARKED * F.sum("bare")).alias("n"))
    kept = counts.groupBy("context", "size").agg(F.sum("n").alias("total"), F.collect_list("symbol").alias("symbols"), F.collect_list("n").alias("ns")).filter((F.col("size") <= 2) | (F.col("total") >= LEAST_CONTEXT))
    one: dict[str, str] = {}
    follow: dict[tuple[str, ...], dict[str, float]] = {}
    for batch in kept.select("context", "size", "symbols", "ns").toArrow().to_batches(10_000):
        for context, size, symbols_, ns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            h = tuple(one.setdefault(x, x) for x in context.split(" ")) if size else ()
            follow[h] = {one.setdefault(x, x): n for x, n in sorted(zip(symbols_, ns, strict=True))}
    return pages.sparkSession.sparkContext.broadcast(Model.counted(follow))


def unit_starts(pages, model, text: str = "ocr_text", with_text: bool = False):
    """page_id, start_pos, end_pos (and unit, the text itself) of the units of ``pages`` (page_id, title, page_number, text). One pass."""
    import pyarrow as pa

    schema = pa.schema([("page_id", pa.int64()), ("start_pos", pa.int32()), ("end_pos", pa.int32())] + [("unit", pa.string())] * with_text)

    def run(batches):
        segmenter = Segmenter(model.value)
        for batch in slices(batches):
            ids, starts, ends, units = [], [], [], []
            for page, t, title, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b in page_units(t, title, number, segmenter) if t else ():
                    ids.append(page)
                    starts.append(a)
                    ends.append(b)
                    if with_text:
                        units.append(t[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())] + [pa.array(units, pa.string())] * with_text, schema=schema)

    return pages.select("page_id", text, "title", "page_number").mapInArrow(run, "page_id long, start_pos int, end_pos int" + ", unit string" * with_text)
