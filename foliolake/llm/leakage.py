"""Evaluation texts leaking into training text: one Aho-Corasick automaton over the test items.

A text is scanned once, as the stream of its letters, marks and digits (NFKC, case folded), so
case, spacing, line breaks and punctuation don't matter. A run of ``words`` consecutive words of a
passage always holds one of the seeds - stretches of words//2 words taken at a stride of
words//2+1 - so looking for the seeds alone loses nothing; each hit is grown to the longest common
run and counted in whole words of the passage (in letters for unspaced languages). Offsets in the
stream map back to the original text.

Defined results: null and empty texts and passages match nothing; items with the same passage are
all reported; several runs of an item give its longest one.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UNSPACED = frozenset(("ja", "zh", "th"))
#: Items in one automaton (some 20 KB each in a worker); more are scanned in further passes, so memory is bounded.
ITEMS_AT_ONCE = 20_000


@lru_cache(maxsize=1)
def _other() -> re.Pattern:
    """Stretches of anything but letters, marks and numbers below U+10000, as a class of ranges (one table look-up in C)."""
    ranges: list[list[int]] = []
    for n in range(0x10000):
        if unicodedata.category(chr(n))[0] not in "LMN":
            if ranges and ranges[-1][1] == n - 1:
                ranges[-1][1] = n
            else:
                ranges.append([n, n])
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) + "]+")


_ASCII_OTHER = re.compile(r"[^a-z0-9]+")
_ANY_OTHER = regex.compile(r"[^\p{L}\p{M}\p{N}]+")


def stream(text: str) -> str:
    if text.isascii():
        return _ASCII_OTHER.sub("", text.lower())
    folded = unicodedata.normalize("NFKC", text).casefold()
    return (_other() if max(folded, default="") < "\U00010000" else _ANY_OTHER).sub("", folded)


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters without a combining class that compose with the one before (Hangul vowels and finals, some vowel signs)."""
    out = {chr(n) for n in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for n in range(0xC0, 0x1D200):
        parts = unicodedata.decomposition(chr(n)).split()
        if len(parts) == 2 and not unicodedata.combining(c := chr(int(parts[1], 16))) and unicodedata.normalize("NFC", chr(n)) == chr(n):
            out.add(c)
    return frozenset(out)


def _starts(c: str) -> bool:
    """True if normalisation never joins ``c`` with what stands before it."""
    if c.isascii():
        return True
    first = unicodedata.normalize("NFKD", c)[0]
    return not unicodedata.combining(first) and first not in _joining()


def stream_offsets(text: str) -> tuple[str, list[int], list[int]]:
    """The stream, and for each of its characters start and end of its stretch in the original.

    The text is taken apart only where normalisation can't join the two sides, so the parts'
    streams together are that of the whole text.
    """
    out, at, to = [], [], []
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        while j < n and not _starts(text[j]):
            j += 1
        part = stream(text[i:j])
        out.append(part)
        at.extend([i] * len(part))
        to.extend([j] * len(part))
        i = j
    return "".join(out), at, to


class Passages:
    """The automaton and what is needed to grow its hits."""

    def __init__(self, items: list[tuple[int, str, str]], words: int = 20, letters: int = 60):
        import ahocorasick

        self.words, self.letters = words, letters
        self.streams: list[str] = []
        self.bounds: list[list[int] | None] = []
        self.ids: list[list[int]] = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        seen: dict[tuple[str, bool], int] = {}
        for item, lang, passage in items:
            if not passage:
                continue
            unspaced = lang in _UNSPACED
            parts = [p for p in (stream(w) for w in passage.split()) if p]
            whole = "".join(parts)
            if not whole:
                continue
            if (k := seen.get((whole, unspaced))) is not None:
                self.ids[k].append(item)
                continue
            k = seen[whole, unspaced] = len(self.streams)
            self.streams.append(whole)
            self.ids.append([item])
            if unspaced:
                self.bounds.append(None)
                half = letters // 2
                spots = [(i, i + half) for i in range(0, len(whole) - half + 1, half + 1)]
            else:
                ends = [0]
                for p in parts:
                    ends.append(ends[-1] + len(p))
                self.bounds.append(ends)
                half = words // 2
                spots = [(ends[i], ends[i + half]) for i in range(0, len(parts) - half + 1, half + 1)]
            for a, b in spots:
                seeds.setdefault(whole[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for s, places in seeds.items():
            self.automaton.add_word(s, (len(s), places))
        self.empty = not seeds
        if seeds:
            self.automaton.make_automaton()

    def runs(self, text: str) -> dict[int, tuple[int, int, int]]:
        """item -> (length in words or letters, start, end in the original text) of its longest run."""
        if self.empty or not text:
            return {}
        s = stream(text)
        hits = [(end - n + 1, k, a) for end, (n, places) in self.automaton.iter(s) for k, a in places]
        if not hits:
            return {}
        best: dict[int, tuple[int, int, int]] = {}
        done: dict[tuple[int, int], int] = {}  # of each passage and diagonal: how far it was grown
        full, at, to = stream_offsets(text)
        assert full == s
        for pos, k, a in sorted(hits):
            if pos < done.get((k, pos - a), -1):
                continue
            p = self.streams[k]
            i, j = pos, a
            while i > 0 and j > 0 and s[i - 1] == p[j - 1]:
                i, j = i - 1, j - 1
            x, y = pos, a
            while x < len(s) and y < len(p) and s[x] == p[y]:
                x, y = x + 1, y + 1
            done[k, pos - a] = x
            ends = self.bounds[k]
            if ends is None:
                size, lo, hi = y - j, i, x
            else:
                first, last = bisect_left(ends, j), bisect_right(ends, y) - 1
                # the outer words must be whole words of the text too
                while first < last and not _edge(at, to, i + ends[first] - j):
                    first += 1
                while first < last and not _edge(at, to, i + ends[last] - j):
                    last -= 1
                size, lo, hi = last - first, i + ends[first] - j, i + ends[last] - j
            if size >= (self.letters if ends is None else self.words) and size > best.get(k, (0,))[0]:
                best[k] = (size, at[lo], to[hi - 1])
        return {item: found for k, found in best.items() for item in self.ids[k]}


def _edge(at: list[int], to: list[int], n: int) -> bool:
    """True if a word of the text begins at its n-th streamed character: something unstreamed stands before it."""
    return n <= 0 or n >= len(at) or at[n] > to[n - 1]


def leaked(docs: DataFrame, key: str, text: str, items: list[tuple[int, str, str]], words: int = 20, letters: int = 60) -> DataFrame:
    """key, item_id, run_length, start_pos, end_pos of each document holding a passage's run. One scan, no shuffle; the items are broadcast (as many at once as ``ITEMS_AT_ONCE``)."""
    kind = docs.schema[key].dataType.simpleString()
    arrow_key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = pa.schema([("key", arrow_key), ("item_id", pa.int64()), ("run_length", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32())])
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).filter("text is not null and text <> ''")
    out = None
    for lo in range(0, max(1, len(items)), ITEMS_AT_ONCE):
        block = docs.sparkSession.sparkContext.broadcast(items[lo : lo + ITEMS_AT_ONCE])

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            passages = Passages(block.value, words, letters)
            for batch in batches:
                rows = [(k, item, *found) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for item, found in passages.runs(t).items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        part = docs.mapInArrow(run, f"key {kind}, item_id long, run_length int, start_pos int, end_pos int")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("key", key)
