"""Encoding of a corpus with a public byte-level BPE, by a monoid tree reduction.

A text is halved until the halves are small; a leaf is encoded directly. Two neighbours are joined
by encoding again only a window around their border. The window grows, doubling, until it has a
*safe cut* on either side: a place where every pre-token of the tokenizer's pattern must end,
whatever stands to the left or right. Merging never crosses pre-tokens, so the tokens outside the
window are those of the whole text; the join is associative and the result exact. Decoding is the
concatenation up the tree. Where no safe cut exists (one endless word), the window grows to both
whole neighbours, which is the only exact answer.

Defined results: null and empty texts have the empty list; strings that look like special tokens
are ordinary text; lone surrogates cannot occur in a Spark string.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-token pattern of the vocabulary (fixed value, published with it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 4096


@lru_cache(maxsize=4)
def load(folder: str = TOKENIZERS, name: str = VOCABULARY):
    import tiktoken

    with open(f"{folder}/{name}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _kind(c: str) -> str:
    """l(etter), n(umber), s(pace), o(ther), or '' where the tokenizer's Unicode version may differ."""
    if c.isspace():
        return "s" if c in " \t\r\n" else ""
    n = ord(c)
    if n < 128:
        return "l" if c.isalpha() else "n" if c.isdigit() else "o"
    if n > 0x2FA1F:
        return ""
    cat = unicodedata.category(c)[0]
    return {"L": "l", "N": "n", "M": "o", "P": "o", "S": "o"}.get(cat, "")


def safe_cut(text: str, i: int) -> bool:
    """True if a pre-token must end between text[i-1] and text[i], whatever is around."""
    if i <= 0 or i >= len(text):
        return True
    a, b = text[i - 1], text[i]
    if b in " \t\r\n":
        return not a.isspace()
    if a == "'":
        return False
    x, y = _kind(a), _kind(b)
    return x != y and x in ("l", "n", "o") and y in ("l", "n", "o")


def encode_tree(text: str, enc, leaf: int = LEAF_CHARS) -> list[int]:
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    # bottom-up over equal leaves: the spans double in each round
    spans = [(lo, min(lo + leaf, len(text))) for lo in range(0, len(text), leaf)]
    nodes = [(lo, hi, enc.encode_ordinary(text[lo:hi])) for lo, hi in spans]
    while len(nodes) > 1:
        joined = [_join(text, nodes[k], nodes[k + 1], enc) for k in range(0, len(nodes) - 1, 2)]
        nodes = joined + nodes[len(joined) * 2 :]
    return nodes[0][2]


def _join(text: str, left: tuple[int, int, list[int]], right: tuple[int, int, list[int]], enc) -> tuple[int, int, list[int]]:
    lo, mid, head = left
    _, hi, tail = right
    a = _grow(text, mid, lo, -1)
    b = _grow(text, mid, hi, 1)
    keep = len(head) - len(enc.encode_ordinary(text[a:mid])) if a > lo else 0
    skip = len(enc.encode_ordinary(text[mid:b])) if b < hi else len(tail)
    return lo, hi, head[:keep] + enc.encode_ordinary(text[a:b]) + tail[skip:]


def _grow(text: str, mid: int, end: int, step: int) -> int:
    """The nearest safe cut of ``mid`` towards ``end``, looked for in windows that double."""
    at, window = mid + step, 16
    while at != end and (at - end) * step < 0:
        stop = max(end, mid - window) if step < 0 else min(end, mid + window)
        while (at - stop) * step < 0:
            if _safe_both(text, at):
                return at
            at += step
        window *= 2
    return end


def _safe_both(text: str, i: int) -> bool:
    return 0 < i < len(text) and safe_cut(text, i)


def token_ids(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (list of int) of each text. No shuffle; repeated and long texts need no special care."""
    kind = df.schema[key].dataType.simpleString()
    arrow_key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(folder, name)
        for batch in batches:
            ids = [encode_tree(t, enc) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow_key), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    return df.select(F.col(key).alias("key"), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")
