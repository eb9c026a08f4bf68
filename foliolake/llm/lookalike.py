"""One consistent form for texts that look the same, computed by DuckDB inside Arrow partitions.

The embedded SQL maps compatibility forms, kinds of space, invisible characters and look-alike
letters with translate, regexp_replace and nfc_normalize. Case, accents, digits, line breaks and
the presence of spaces stay as they are. Look-alike letters of other scripts become their Latin
twins, so that the form is the same whichever script a letter was taken from.

Defined results: a null text stays null, an empty one empty. Two texts that differ only in what
can't be seen get the same form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.session import checkpointed

# Letters of other scripts and the Latin letter (or sign) they can't be told from.
CYRILLIC = "АВЕЅІЈКМНОРСТУХЬасеорухѕіјԁһԛԝ"
CYRILLIC_AS = "ABESIJKMHOPCTYXbaceopyxsijdhqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲ"
GREEK_AS = "ABEZHIKMNOPTYXovc"
ARMENIAN = "օսհոՕՏ"
ARMENIAN_AS = "ouhnOS"
OTHER = "ıɡɑ‐‑⁃−˗﹣ʼ´ꓸ․ᴏ"
OTHER_AS = "iga------''..o"
#: Kinds of space that look like a space.
SPACES = "               　\t"
#: Characters that can't be seen (zero width, joiners, direction marks, variation selectors, controls), as a class for DuckDB.
INVISIBLE = r"[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FE00}-\x{FE0F}\x{FEFF}\x{0}-\x{8}\x{B}-\x{1F}\x{7F}-\x{9F}]"
#: Texts of these characters alone are their own form: printable ASCII, Latin-1 letters and signs, kana, ideographs, CJK marks.
PLAIN = r"[\n\x20-\x7E\x{A1}-\x{AC}\x{AE}-\x{B3}\x{B5}-\x{FF}\x{2013}-\x{2019}\x{201C}-\x{201E}\x{2022}\x{2116}\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FE}\x{4E00}-\x{9FFF}]*"
# Ligatures and other forms of one character that stand for several (fixed values).
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st", "\u01c8": "Lj", "\u01c9": "lj", "\u01cb": "Nj", "\u01cc": "nj", "\u2026": "...", "\u0e4d\u0e32": "\u0e33", "\u0e40\u0e40": "\u0e41", "\u2103": "\u00b0C", "\u338f": "kg", "\u339c": "mm", "\u33a1": "m\u00b2", "\u33be": "kW"}


def _compat() -> tuple[str, str]:
    """Width forms and radicals with a one-character equivalent, from the Unicode tables."""
    import unicodedata

    have, want = [], []
    for lo, hi in ((0xFF01, 0xFFEF), (0x2E80, 0x2FD6), (0xF900, 0xFB00), (0x3131, 0x318F), (0xFE30, 0xFE6F), (0x1D400, 0x1D800)):
        for n in range(lo, hi):
            c = chr(n)
            d = unicodedata.normalize("NFKC", c)
            if d != c and len(d) == 1 and d != " ":
                # half-width sound marks must stay combining, so that NFC composes them
                have.append(c)
                want.append({"\uff9e": "\u3099", "\uff9f": "\u309a"}.get(c, d))
    return "".join(have), "".join(want)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_sql(column: str) -> str:
    """DuckDB expression of the consistent form of ``column``."""
    have, want = _compat()
    plain = f"regexp_full_match({column}, {_quoted(PLAIN)})"
    e = f"regexp_replace({column}, {_quoted(INVISIBLE)}, '', 'g')"
    e = f"nfc_normalize(translate({e}, {_quoted(have + SPACES)}, {_quoted(want + ' ' * len(SPACES))}))"
    for a, b in LIGATURES.items():
        if a != b:
            e = f"replace({e}, {_quoted(a)}, {_quoted(b)})"
    e = f"translate({e}, {_quoted(CYRILLIC + GREEK + ARMENIAN + OTHER)}, {_quoted(CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + OTHER_AS)})"
    return f"case when {plain} then {column} else {e} end"


def consistent_form(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """``df`` with ``out``, the consistent form of ``text``; a column of that name is replaced. Plain texts pass through the same SQL."""
    df = df.drop(out) if out in df.columns and out != text else df
    schema = df.schema
    sql = f"select *, {form_sql('cast(\"' + text + '\" as varchar)')} as \"{out}\" from batch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        try:
            for one in batches:
                con.register("batch", pa.Table.from_batches([one]))
                table = con.sql(sql).to_arrow_table()
                con.unregister("batch")
                yield from table.combine_chunks().to_batches()
        finally:
            con.close()

    from pyspark.sql.types import StringType, StructField, StructType

    return df.mapInArrow(run, StructType([*schema.fields, StructField(out, StringType())]))


def _mixed(df: DataFrame, group: list[str], key: str, text: str) -> tuple[DataFrame, list[str], list[str]]:
    """Rows (group, look, look2, id, th) of the looks that stand for more than one text of a group, with the names of the group's columns and of the look's key.

    Only a 16-byte digest of form and text travels. Groups in which all texts are equal - the
    hot ones, copies of one text - are dropped by a pre-aggregated minimum and maximum.
    """
    inner = [f"g{i}" for i in range(len(group))]  # the caller's names can't clash with ours
    some = df.select(*[F.col(c).alias(g) for c, g in zip(group, inner, strict=True)], F.col(key).alias("id"), F.col(text).cast("string").alias("t"))
    rows = consistent_form(some.filter("t is not null and t <> '' and id is not null"), "t")
    slim = checkpointed(rows.select(*inner, "id", F.xxhash64("form").alias("look"), F.xxhash64(F.lit(7), "form").alias("look2"), F.xxhash64("t").alias("th")).distinct())
    by = [*inner, "look", "look2"]
    mixed = slim.groupBy(*by).agg(F.min("th").alias("lo"), F.max("th").alias("hi")).filter("lo <> hi").select(*by)
    return slim.join(mixed, by, "left_semi"), inner, by


def same_look_pairs(df: DataFrame, group: list[str], key: str, text: str) -> DataFrame:
    """Pairs (id_a < id_b) of rows of a group whose texts differ as stored but look the same.

    The rows are joined by group and look, never crossed; the pairs are the result asked for. Where
    classes with their members are enough, ``same_look_classes`` gives one row for each row.
    """
    some, inner, by = _mixed(df, group, key, text)
    a, b = some.withColumnRenamed("id", "id_a").withColumnRenamed("th", "ta"), some.withColumnRenamed("id", "id_b").withColumnRenamed("th", "tb")
    pairs = a.join(b, by).filter("id_a < id_b and ta <> tb").distinct()
    return pairs.select(*[F.col(g).alias(c) for c, g in zip(group, inner, strict=True)], "id_a", "id_b").distinct()


def same_look_classes(df: DataFrame, group: list[str], key: str, text: str) -> DataFrame:
    """The rows of texts that look like another, differently stored text of their group: group, id, class_id (the least id of the look), text_id (the least id of the same text) and links (rows of other texts of the class).

    Representatives and membership in place of pairs: in proportion to the rows, however many share a look.
    """
    some, inner, by = _mixed(df, group, key, text)
    texts = some.groupBy(*by, "th").agg(F.min("id").alias("text_id"), F.count("*").alias("n"))
    looks = texts.groupBy(*by).agg(F.min("text_id").alias("class_id"), F.sum("n").alias("all"))
    known = texts.join(looks, by).select(*by, "th", "text_id", "class_id", (F.col("all") - F.col("n")).alias("links"))
    return some.join(known, [*by, "th"]).select(*[F.col(g).alias(c) for c, g in zip(group, inner, strict=True)], "id", "class_id", "text_id", "links")
