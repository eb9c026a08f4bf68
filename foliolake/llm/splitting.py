"""Splitting oversized items at natural boundaries, by bounded-quantifier regular expressions.

Sizes are in tokens, so the expression runs over a string with one letter for each token: the
strength of the boundary that follows it (P paragraph, L line, S sentence, W word, c character,
x inside a character). The alternatives of the expression are ordered by strength; each consumes
as much as the limit allows, and a character cut is the last resort:

    .{1,n}$ | .{n/4,n-1}P | .{n/4,n-1}L | .{n/4,n-1}S | .{n/4,n-1}W | .{0,n-9}[^x] | .{1,n}

n is the limit for the first stretch, before which nothing is repeated, and the limit less the
overlap for the others. A piece is the consumed stretch with a lookback of the overlap, which
starts at a word boundary where one is near, else between two characters. Stretches and lookbacks
are computed with SQL array and string functions in the JVM, in proportion to the text. W, S, L and P stand
only where the tokenizer's pre-tokens must end, so a piece between them encodes to exactly its
stretch; character cuts keep ``SLACK`` tokens free, as the cut word may encode to some more.

Defined results: null and empty texts have no pieces; a text within the limit is one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.llm.encoding import TOKENIZERS, VOCABULARY, _kind, encode_tree, load

#: Tokens left free on a side that is cut within a word.
SLACK = 8
_ENDERS, _WIDE_ENDERS = ".!?…。！？", "。！？」』"
_CLOSERS = "'\"”’»」』)]"
_BLOCK = 1 << 20


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For each code point: 1 letter, 2 number, 3 other, 4 plain space, 5 other space, 0 unsure; from the rule of safe cuts."""
    code = {"l": 1, "n": 2, "o": 3, "s": 4}
    return np.array([0 if 0xD800 <= n < 0xE000 else code.get(_kind(chr(n)), 5 if chr(n).isspace() else 0) for n in range(0x2FA20)], np.uint8)


def boundary_marks(text: str, ids: list[int], enc) -> tuple[str, np.ndarray]:
    """The letter after each token, and the character offset where each token ends (rounded down)."""
    raw = text.encode()
    sizes = np.fromiter(map(len, enc.decode_tokens_bytes(ids)), np.int64, len(ids))
    at = np.cumsum(sizes)
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80  # first bytes of characters
    before = np.concatenate([[0], np.cumsum(lead)])  # characters begun before each byte
    inside = np.concatenate([~lead, [False]])[at]
    ends = before[at] - inside
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(c)
    kind = np.append(_classes()[np.minimum(c, 0x2FA1F)], 0)
    kind[:n][c > 0x2FA1F] = 0
    a, b = kind[ends - 1], kind[ends]
    quote = c[ends - 1] == 0x27
    safe = np.where(b == 4, (a != 4) & (a != 5), ~quote & (a != b) & (a >= 1) & (a <= 3) & (b >= 1) & (b <= 3)) | (ends == n)
    # the white space after each place: where it ends, and the line feeds in it
    space = (kind[:n] == 4) | (kind[:n] == 5)
    stop = np.append(np.minimum.accumulate(np.where(space, n, np.arange(n))[::-1])[::-1], n)[ends]
    feed = c == 10
    feeds = np.concatenate([[0], np.cumsum(feed)])
    twice = np.concatenate([[0], np.cumsum(feed & np.append(feed[1:], False))])
    line = feeds[stop] > feeds[ends]
    blank = (stop > ends) & (twice[np.maximum(stop - 1, 0)] > twice[np.minimum(ends, n)])
    is_end, is_wide, closes = (np.isin(c, [ord(x) for x in s]) for s in (_ENDERS, _WIDE_ENDERS, _CLOSERS))
    final, open_ = np.zeros(len(ids), bool), np.ones(len(ids), bool)
    for k in range(1, 5):  # an end mark behind up to three closing signs
        i = np.maximum(ends - k, 0)
        open_ &= ends >= k
        final |= open_ & is_end[i]
        open_ &= closes[i]
    sentence = final & ((stop > ends) | is_wide[ends - 1])
    marks = np.select([inside, ~safe, blank | (ends == n), line, sentence], [ord(x) for x in "xcPLS"], ord("W")).astype(np.uint8)
    return marks.tobytes().decode(), ends


def token_marks(df: DataFrame, key: str, text: str, limit: int, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """key, text, n_tokens, marks, ends; the last two only for texts over ``limit`` tokens."""
    kind = df.schema[key].dataType.simpleString()
    arrow_key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(folder, name)
        for batch in batches:
            n, marks, ends = [], [], []
            for t in batch.column(1).to_pylist():
                ids = encode_tree(t, enc) if t else []
                n.append(len(ids))
                m, e = boundary_marks(t, ids, enc) if len(ids) > limit else (None, None)
                marks.append(m)
                ends.append(e)
            arrays = [batch.column(0).cast(arrow_key), batch.column(1), pa.array(n, pa.int32()), pa.array(marks, pa.string()), pa.array(ends, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "text", "n_tokens", "marks", "ends"])

    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, text string, n_tokens int, marks string, ends array<int>")


def _stretch(n: int) -> str:
    least = max(1, n // 4)
    strong = "|".join(f".{{{least},{n - 1}}}{x}" for x in "PLSW")
    return f".{{1,{n}}}$|{strong}|.{{0,{max(0, n - 1 - SLACK)}}}[^x]|.{{1,{n}}}"


def stretches(df: DataFrame, key: str, text: str, limit: int = 512, overlap: int = 64, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """key, text, n_tokens, ends, sizes (tokens each piece goes on by) and backs (tokens it repeats) of every non-empty text. No shuffle."""
    rx = f"(?:^(?:{_stretch(limit)})|(?:{_stretch(limit - overlap)}))"
    cut = token_marks(df, key, text, limit, folder, name).filter("n_tokens > 0")
    parts = F.when(F.col("marks").isNotNull(), F.regexp_extract_all("marks", F.lit(rx), 0))
    near = max(1, min(SLACK, overlap // 2))

    def back(part):
        # the lookback lies within the stretch before, which only at the text's end is shorter than a quarter of the limit
        look = F.right(part, F.lit(overlap + 1))
        word = F.length(F.regexp_extract(look, f"^[cx]{{0,{near}}}[WSLP]", 0))
        cut = F.right(part, F.lit(overlap + 1 - near // 2))
        return F.when(word > 0, F.length(look) - word).otherwise(F.length(cut) - F.length(F.regexp_extract(cut, "^x*[^x]", 0)))

    cut = cut.withColumn("parts", parts)
    sizes = F.coalesce(F.transform("parts", F.length), F.array("n_tokens"))
    backs = F.coalesce(F.concat(F.array(F.lit(0)), F.transform(F.slice("parts", 1, F.size("parts") - 1), back)), F.array(F.lit(0)))
    return cut.select("key", "text", "n_tokens", "ends", sizes.alias("sizes"), backs.alias("backs"))


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 512, overlap: int = 64, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """key, n_tokens, piece_no (from 0), start_token, end_token, start_pos, end_pos, piece of every non-empty text.

    The pieces leave as slices of the one text, some at a time, so a very long text costs its own
    size and that of its pieces.
    """
    kind = df.schema[key].dataType.simpleString()
    arrow_key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    fields = [("key", arrow_key), *((c, pa.int32()) for c in ("n_tokens", "piece_no", "start_token", "end_token", "start_pos", "end_pos")), ("piece", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        room = _BLOCK
        for batch in batches:
            for i, (k, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                t = batch.column(1)[i].as_py()
                sizes, backs = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (4, 5))
                stops = np.cumsum(sizes)
                starts = np.concatenate([[0], stops[:-1]]) - backs
                if len(stops) == 1:
                    places = [(0, len(t))]
                else:
                    ends = np.concatenate([[0], batch.column(3)[i].values.to_numpy(zero_copy_only=False)])
                    places = list(zip(ends[starts].tolist(), ends[stops].tolist(), strict=True))
                for j, (a, b) in enumerate(places):
                    rows.append((k, n, j, int(starts[j]), int(stops[j]), a, b, t[a:b]))
                    room -= b - a
                    if room < 0:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, room = [], _BLOCK
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    out = stretches(df, key, text, limit, overlap, folder, name)
    return out.mapInArrow(run, f"key {kind}, n_tokens int, piece_no int, start_token int, end_token int, start_pos int, end_pos int, piece string").withColumnRenamed("key", key)
