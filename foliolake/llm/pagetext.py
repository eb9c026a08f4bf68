"""Lines of scanned pages: running headers, page numbers, list marks and wrapping.

Furniture (headers and page numbers) is told by page-position features: how much of the line is
the book's title, the form of a number, whether it is the page's own number, and where the line
stands - first, last, or at a break within the page next to other furniture. ``furniture`` weighs
them by hand; ``Furniture`` learns their weights (averaged perceptron) from the pages, taking as
examples the lines of which the hand rule, or the place, leaves no doubt.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import lru_cache

HEADER, PAGE_NUMBER = "header", "page_number"

_NUMBER = re.compile(r"^(?P<open>[-—–·•\[(]\s*)?(?P<p>(?:p|pp|pg|page|s|стр|с)\.?\s*)?(?P<n>[0-9OolI|]{1,4}|[ivxlc]{1,12})(?P<of>\s*/\s*[0-9OolI|]{1,4})?(?P<close>\s*[-—–·•\])])?$", re.I)
_DIGITS = str.maketrans("OolI|", "00111")
_SPACED_OUT = re.compile(r"^(?:\S ){4}|^(?:\S\s+){6}")
#: Marks before a list item; a heading's number (2.9 Title) is no such mark.
LIST_MARK = re.compile(r"[ \t]*(?:[-–—•·*▪◦‣○●■□►]|\(?\d{1,3}[.)]|\(?[a-zA-Z]\))[ \t]+(?=\S)")
HEADING_NUMBER = re.compile(r"[ \t]*\d{1,2}(?:\.\d{1,2})+\.?[ \t]+\S")
_UNSPACED_CHAR = re.compile(r"[぀-ヿ㐀-鿿豈-﫿･-ﾟ々〆〇]")


_ASCII_NO_LETTER = re.compile("[^a-z]+")


@lru_cache(maxsize=4096)
def squash(text: str) -> str:
    """Letters alone, case and compatibility forms folded."""
    if text.isascii():
        return _ASCII_NO_LETTER.sub("", text.lower())
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalpha() or unicodedata.combining(c))


_ROMAN = re.compile(r"c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")


def _unroman(s: str) -> int:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    ns = [values[c] for c in s.casefold()]
    return sum(-a if b > a else a for a, b in zip(ns, [*ns[1:], 0], strict=True))


@lru_cache(maxsize=4096)
def _masks(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def prefix_distance(a: str, b: str, sizes: Iterable[int]) -> int:
    """The least edit distance of a to the beginnings of b of these sizes (Myers' bit vectors: a column of the table is two numbers)."""
    masks, every = _masks(b), (1 << len(b)) - 1
    up, down = every, 0
    for c in a:
        same = masks.get(c, 0)
        x = same | down
        same = (((same & up) + up) ^ up) | same
        more = (down | ~(same | up)) << 1 | 1
        less = (up & same) << 1
        up, down = (less | ~(x | more)) & every, more & x & every
    return min(len(a) + (up & (m := (1 << k) - 1)).bit_count() - (down & m).bit_count() for k in sizes)


def distance(a: str, b: str, most: int) -> int:
    """Edit distance, or most + 1 if it is larger."""
    return most + 1 if abs(len(a) - len(b)) > most else min(most + 1, prefix_distance(a, b, (len(b),)))


@lru_cache(maxsize=4096)
def _title_grams(title: str) -> tuple[str, ...]:
    t = unicodedata.normalize("NFKC", title).lower()
    n = 2 if len(t) < 14 or _UNSPACED_CHAR.search(t) else 3
    return tuple(dict.fromkeys(t[i : i + n] for i in range(0, len(t) - n + 1, n) if t[i : i + n].strip() == t[i : i + n]))


def _shares(line: str, title: str) -> bool:
    """True if the line (in lower case) has some characters in a row of the title."""
    for g in _title_grams(title):
        if g in line:
            return True
    return False


def is_header(line: str, title: str | None) -> bool:
    """True if the line is the title, whole, cut off, spaced out or misread, with or without a number."""
    if not title or len(line) > 4 * len(title) + 24:
        return False
    low = line.lower()
    if not _shares(low, title) and not _SPACED_OUT.match(line):
        return False
    a, b = squash(line), squash(title)
    if len(a) < 3 or len(b) < 3:
        return False
    if a == b:
        return True
    # a header starts like the title: of its first characters some two in a row are right
    if not any(a[i : i + 2] in (b[i : i + 2], b[i + 1 : i + 3]) or a[i + 1 : i + 3] == b[i : i + 2] for i in (0, 1, 2, 3)):
        return False
    if len(a) > len(b) + max(2, len(b) // 5):
        return False
    if len(a) >= len(b) - 2:
        most = max(1, len(b) // 4)
        if distance(a, b, most) <= most:
            return True
    # cut off: a long enough beginning of the title
    if len(a) >= max(5, 0.45 * len(b)) or (len(a) >= 4 and ord(a[0]) > 0x2E00 and len(a) >= 0.45 * len(b)):
        if b.startswith(a):
            return True
        most = max(1, len(a) // 5)
        return prefix_distance(a, b, {min(len(b), len(a) + d) for d in (-1, 0, 1)}) <= most
    return False


def page_number(line: str) -> tuple[str, bool] | None:
    """(the number, whether it is decorated) if the line could be a page number."""
    line = line.strip()
    if not line or len(line) > 16:
        return None
    m = _NUMBER.match(line)
    if not m:
        return None
    n = m["n"]
    if not any(c.isdigit() for c in n) and not re.fullmatch(r"[ivxlcIVXLC]+", n):
        return None
    decorated = bool(m["of"] or m["p"] or (m["open"] and m["close"]))
    if (m["open"] and not m["close"]) or (m["close"] and not m["open"] and not m["of"]):
        return None
    return n, decorated


def furniture(lines: list[str], title: str | None, number: int | None) -> list[str | None]:
    """For each line of a page: header, page_number or None."""
    out: list[str | None] = [None] * len(lines)
    solid = [i for i, s in enumerate(lines) if s and not s.isspace()]
    if not solid:
        return out
    maybe: list[tuple[int, str, bool]] = []
    for rank, i in enumerate(solid):
        line = lines[i]
        if len(line) <= 16 and (found := page_number(line)):
            maybe.append((i, *found))
        elif is_header(line, title) and not _sentence_part(lines, solid, rank):
            out[i] = HEADER
    first, last = solid[0], solid[-1]
    for i, n, decorated in maybe:
        digits = n.translate(_DIGITS) if any(c.isdigit() for c in n) else ""
        value = int(digits) if digits.isdigit() else _unroman(n) if not digits else None
        own = number is not None and value is not None and abs(value - number) <= 2
        edge = i in (first, last) or (len(solid) > 1 and (i == solid[1] and out[first] or i == solid[-2] and out[last]))
        roman = not digits and _ROMAN.fullmatch(n) is not None and (len(n) > 1 or n in "ivx")
        if decorated or roman or own or edge:
            out[i] = PAGE_NUMBER
    return out


class Furniture:
    """Headers and page numbers by learned weights of page-position features; the hand rule where nothing was learned."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w = weights or {}

    @staticmethod
    def _place(solid: list[int], rank: int) -> str:
        last = len(solid) - 1
        return "only" if not last else "first" if rank == 0 else "last" if rank == last else "near" if rank in (1, last - 1) else "inner"

    def _header(self, lines: list[str], solid: list[int], rank: int, title: str, number: int | None) -> tuple[list[str], float, float] | None:
        """(features, errors and length against the title) of a line that shares something with the title."""
        line = lines[solid[rank]]
        if len(line) > 4 * len(title) + 24:
            return None
        low = line.lower()
        if not _shares(low, title) and not _SPACED_OUT.match(line):
            return None
        a, b = squash(line), squash(title)
        if len(a) < 3 or len(b) < 3 or len(a) > len(b) + max(2, len(b) // 5):
            return None
        if a == b:
            wrong = 0
        elif not any(a[i : i + 2] in (b[i : i + 2], b[i + 1 : i + 3]) or a[i + 1 : i + 3] == b[i : i + 2] for i in (0, 1, 2, 3)):
            return None
        else:
            wrong = min(max(1, len(a) // 2) + 1, prefix_distance(a, b, {min(len(b), max(1, len(a) + d)) for d in (-1, 0, 1)}))
        errors, cover = wrong / len(a), min(1.2, len(a) / len(b))
        i = solid[rank]
        alone = (i == 0 or not lines[i - 1].strip()) + (i + 1 == len(lines) or not lines[i + 1].strip())
        e, c, place = min(10, int(errors * 20)), int(cover * 10), self._place(solid, rank)
        digits = re.findall(r"\d+", line)
        f = [
            "h:bias", f"h:error:{e}", f"h:cover:{c}", f"h:both:{min(e, 6)}:{c}", f"h:place:{place}", f"h:alone:{alone}", f"h:at:{min(e, 6)}:{place}", f"h:whole:{len(a) >= len(b) - 2}:{min(e, 6)}",
            f"h:end:{_sentence_part(lines, solid, rank)}", f"h:number:{bool(digits)}:{number is not None and str(number) in digits}", f"h:letters:{min(8, len(a))}:{min(e, 2)}", f"h:spaced:{_SPACED_OUT.match(line) is not None}",
        ]
        return f, errors, cover

    def _number(self, lines: list[str], solid: list[int], rank: int, number: int | None, headers: set[int]) -> tuple[list[str], bool, bool] | None:
        """(features, whether it is surely the page's number, whether it surely isn't) of a line that has a number's form."""
        i = solid[rank]
        found = page_number(lines[i]) if len(lines[i]) <= 16 else None
        if not found:
            return None
        n, decorated = found
        digits = n.translate(_DIGITS) if any(c.isdigit() for c in n) else ""
        value = int(digits) if digits.isdigit() else _unroman(n) if not digits else None
        roman = not digits and _ROMAN.fullmatch(n) is not None and (len(n) > 1 or n in "ivx")
        off = min(5, abs(value - number)) if number is not None and value is not None else 6
        place = self._place(solid, rank)
        edge = place in ("only", "first", "last") or place == "near" and (solid[0] in headers or solid[-1] in headers)
        alone = (i == 0 or not lines[i - 1].strip()) + (i + 1 == len(lines) or not lines[i + 1].strip())
        f = ["n:bias", f"n:form:{decorated}:{roman}", f"n:off:{off}", f"n:place:{place}", f"n:edge:{edge}", f"n:alone:{alone}", f"n:at:{edge}:{min(off, 3)}", f"n:letters:{not digits}:{edge}"]
        return f, decorated or off <= 2 or roman or edge, off > 2 and not decorated and not roman and not edge

    @classmethod
    def examples(cls, text: str, title: str | None, number: int | None) -> list[tuple[tuple[str, ...], bool]]:
        """(features, whether it is furniture) of a page's lines; doubtful lines are left out."""
        self, out = cls(), []
        lines = text.split("\n")
        solid = [i for i, x in enumerate(lines) if x and not x.isspace()]
        headers = set()
        for rank, i in enumerate(solid):
            if title and (found := self._header(lines, solid, rank, title, number)):
                f, errors, cover = found
                sure = is_header(lines[i], title) and not _sentence_part(lines, solid, rank)
                if sure:
                    headers.add(i)
                if sure and (errors <= 0.2 or self._place(solid, rank) != "inner") or not sure and (errors > 0.3 or cover < 0.4 or _sentence_part(lines, solid, rank)):
                    out.append((tuple(f), sure))
            if found := self._number(lines, solid, rank, number, headers):
                f, sure, surely_not = found
                if sure or surely_not:
                    out.append((tuple(f), sure))
        return out

    def fit(self, pages: Iterable[tuple[str, str | None, int | None]], rounds: int = 6, seed: int = 3) -> Furniture:
        """From (text, title, page number)."""
        return self.learned(Counter(x for page in pages for x in self.examples(*page)), rounds, seed)

    @staticmethod
    def learned(counts: dict[tuple[tuple[str, ...], bool], int], rounds: int = 6, seed: int = 3) -> Furniture:
        """From examples with their counts; equal ones come as often as the logarithm of their number says."""
        examples = [x for x, n in sorted(counts.items()) for _ in range(n.bit_length())]
        rnd = random.Random(seed)
        w: dict[str, float] = defaultdict(float)
        total: dict[str, float] = defaultdict(float)
        step = 1
        for _ in range(rounds):
            rnd.shuffle(examples)
            for f, yes in examples:
                step += 1
                score = sum(w[x] for x in f)
                if (score <= 1) if yes else (score >= -1):
                    for x in f:
                        w[x] += 1.0 if yes else -1.0
                        total[x] += (1.0 if yes else -1.0) * step
        return Furniture({x: v - total[x] / step for x, v in w.items()})

    def __call__(self, lines: list[str], title: str | None, number: int | None) -> list[str | None]:
        """For each line of a page: header, page_number or None."""
        if not self.w:
            return furniture(lines, title, number)
        out: list[str | None] = [None] * len(lines)
        solid = [i for i, x in enumerate(lines) if x and not x.isspace()]
        score = lambda f: sum(self.w.get(x, 0.0) for x in f)
        numbers = [rank for rank, i in enumerate(solid) if len(lines[i]) <= 16 and page_number(lines[i])]
        if title:
            plain = set(range(len(solid))) - set(numbers)
            for rank in sorted(plain):
                if (found := self._header(lines, solid, rank, title, number)) and score(found[0]) > 0:
                    out[solid[rank]] = HEADER
        headers = {i for i in solid if out[i]}
        for rank in numbers:
            if score(self._number(lines, solid, rank, number, headers)[0]) > 0:
                out[solid[rank]] = PAGE_NUMBER
        return out


def _sentence_part(lines: list[str], solid: list[int], rank: int) -> bool:
    """True if a title-like line reads on as part of a sentence (its line ends like one)."""
    line = lines[solid[rank]].rstrip()
    return line[-1:] in ".,;。、，；" and not line.endswith("...")


def box_furniture(text: str, title: str | None, y: int | None, top: int = 40, bottom: int = 1600, end: int = 1700) -> str | None:
    """The same for a text box: it must stand at the page's upper or lower edge."""
    if y is None or top < y < bottom or y > end:
        return None
    line = text.strip()
    if "\n" in line or not line:
        return None
    if page_number(line):
        return PAGE_NUMBER
    return HEADER if is_header(line, title) else None


def wrap_width(lines: list[str]) -> int:
    """The width lines were broken at, or 0 if the text is not wrapped.

    Thai words may be longer than the line, so only its lines of several words tell.
    """
    sizes = [len(s) for s in lines if s and not ("\u0e00" <= s.strip()[:1] <= "\u0e7f" and " " not in s.strip())]
    if len(lines) < 2 or not sizes or max(map(len, lines)) > 110 and max(sizes) > 110:
        return 0
    return max(sizes) if max(sizes) <= 110 else 0
