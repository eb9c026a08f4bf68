import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliolake.llm import encoding as e
from foliolake.llm import splitting

pytestmark = pytest.mark.skipif(not Path(e.TOKENIZERS).exists(), reason="no tokenizers")
ALPHABET = "ab Z09'\n\t.,!?-çßйжあ漢。、ก่ำ​  \x1c\U0001f600_<|>"


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=200), st.integers(1, 9))
def test_tree_is_exact(text, leaf):
    enc = e.load()
    assert e.encode_tree(text, enc, leaf) == enc.encode_ordinary(text)


def test_against_the_other_library_and_round_trip():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(f"{e.TOKENIZERS}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    enc = e.load()
    for text in ["", "plain <|endoftext|> text", "don't   'small\n\n x", "あ" * 9000, "a" * 9000, "word " * 3000, "ก่อน ปั๊ม 123"]:
        ids = e.encode_tree(text, enc, 64)
        assert ids == tok.encode(text, add_special_tokens=False).ids
        assert enc.decode(ids) == text


def test_spark_ids(spark):
    df = spark.createDataFrame([(1, "a b", 1), (2, "", 2), (3, None, 3), (None, "x", 4), (1, "a b", 1)], "doc_id long, text string, ids int")
    rows = sorted(((r.doc_id or 0), list(r.ids)) for r in e.token_ids(df, "doc_id", "text").collect())
    assert rows == [(0, [87]), (1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert e.token_ids(df.limit(0), "doc_id", "text").count() == 0


def test_pieces(spark):
    rnd = random.Random(2)
    texts = ["", None, "short", " ".join("word%d." % rnd.randint(1, 99) + ("\n\n" if rnd.random() < 0.05 else "") for _ in range(3000)), "あいう。" * 900, "x" * 5000, "漢" * 3000, "a1" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = e.load()
    got = {}
    for r in splitting.split_oversized(df, "doc_id", "text").orderBy("doc_id", "piece_no").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {2, 3, 4, 5, 6, 7}
    for k, rows in got.items():
        n = len(enc.encode_ordinary(texts[k]))
        assert (len(rows) > 1) == (n > 512)
        assert rows[0].start_pos == 0 and rows[-1].end_pos == len(texts[k]) and rows[-1].end_token == n
        for a, b in zip(rows, rows[1:]):
            assert b.start_pos <= a.end_pos and 56 <= a.end_token - b.start_token <= 64
        assert rows[0].end_token > 448 - 64 or len(rows) == 1
        for r in rows:
            assert texts[k][r.start_pos : r.end_pos] == r.piece
            assert len(enc.encode_ordinary(r.piece)) <= 512
    words = got[3]
    assert sum(texts[3][: r.end_pos].rstrip().endswith(".") for r in words) == len(words)


def slow_marks(text, ids, enc):
    """The same marks, one place at a time."""
    marks, ends, pos, pending = "", [], 0, b""
    for piece in enc.decode_tokens_bytes(ids):
        pending += piece
        try:
            whole = pending.decode()
        except UnicodeDecodeError as x:
            marks += "x"
            ends.append(pos + len(pending[: x.start].decode()))
            continue
        pos, pending = pos + len(whole), b""
        ends.append(pos)
        after = text[pos : len(text) - len(text[pos:].lstrip())]
        before = text[:pos]
        shut = before[-4:].rstrip("'\"”’»」』)]")
        final = shut and shut[-1] in ".!?…。！？" and len(before[-4:]) - len(shut) <= 3
        if not e.safe_cut(text, pos):
            marks += "c"
        elif "\n\n" in after or pos == len(text):
            marks += "P"
        elif "\n" in after:
            marks += "L"
        elif final and (after or before[-1] in "。！？」』"):
            marks += "S"
        else:
            marks += "W"
    return marks, ends


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET + "。」)", min_size=1, max_size=120))
def test_marks(text):
    enc = e.load()
    ids = enc.encode_ordinary(text)
    marks, ends = splitting.boundary_marks(text, ids, enc)
    want, at = slow_marks(text, ids, enc)
    assert marks == want
    assert all(x == y for x, y, m in zip(ends.tolist(), at, marks, strict=True) if m != "x")


def test_joins_over_a_corpus():
    import pyarrow.parquet as pq

    path = Path("/root/testdata/sf0.001/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    enc = e.load()
    for text in pq.read_table(path, columns=["text"])["text"].to_pylist():
        if text:
            want = enc.encode_ordinary(text)
            assert all(e.encode_tree(text, enc, leaf) == want for leaf in (8, 23, 64))


def test_a_very_long_text(spark):
    rnd = random.Random(7)
    text = " ".join("w%d" % rnd.randint(1, 999) for _ in range(300_000))
    rows = splitting.split_oversized(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text").select("start_pos", "end_pos", "start_token", "end_token").orderBy("start_pos").collect()
    assert rows[0].start_pos == 0 and rows[-1].end_pos == len(text)
    assert all(56 <= a.end_token - b.start_token <= 64 for a, b in zip(rows, rows[1:]))
