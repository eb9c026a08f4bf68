"""Text functions as columns: JVM-side, usable in any projection. Null in, null out unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def solid_length(c: Column) -> Column:
    """Characters that are no white space; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(c, r"\s+", "")), F.lit(0))


def clean_html(c: Column) -> Column:
    """Breaks to newlines, tags out, blocks between blank lines stripped, & < > escaped; an array of blocks."""
    t = F.regexp_replace(F.regexp_replace(strip(c), r"(?i)<\s*br\s*/?>", "\n"), r"<[^>]+>", "")
    blocks = F.filter(F.transform(F.split(t, r"\n\s*\n"), strip), lambda b: b != "")
    esc = lambda b: F.replace(F.replace(F.replace(b, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.transform(blocks, esc)


def paragraphs(c: Column) -> Column:
    """Parts between empty lines, stripped, empty ones dropped."""
    return F.filter(F.transform(F.split(c, "\n\n"), strip), lambda p: p != "")


def word_wrap(c: Column, width: float, font_size: float) -> Column:
    """Greedy wrapping to a budget of characters (width over 0.6 font sizes); longer words keep a line of their own.

    With single spaces a line is the longest stretch of at most that many characters that ends
    before a space: one regular expression, in proportion to the text.
    """
    most = max(1, int(width / (font_size * 0.6)))
    line = r"(?s)\S(?= |$)" if most == 1 else rf"(?s)\S(?:.{{0,{most - 2}}}\S)?(?= |$)"
    words = strip(F.regexp_replace(c, r"\s+", " "))
    return F.regexp_extract_all(words, F.lit(rf"{line}|\S+"), 0)


def fixed_chunks(c: Column, size: int = 80, most: int | None = None) -> Column:
    """Pieces of ``size`` characters; at most ``most`` of them for a preview, all by default."""
    n = F.ceil(F.length(c) / size).cast("int")
    if most is not None:
        n = F.least(n, F.lit(most))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def name_number(c: Column) -> Column:
    """The page number in a file name: 'page 7', 'p7', '_7.jpg', '7.jpg', in this order."""
    low = F.lower(c)
    found = [F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in (r"page\s*[-_]?\s*(\d{1,9})", r"p\s*[-_]?\s*(\d{1,9})", r"[_-](\d{1,9})\.[a-z0-9]+$", r"^(\d{1,9})\.[a-z0-9]+$")]
    return F.coalesce(*found).cast("int")


def text_number(c: Column) -> Column:
    """The first number of up to three digits between dashes."""
    return F.nullif(F.regexp_extract(c, r"[-—]\s*(\d{1,3})\s*[-—]", 1), F.lit("")).cast("int")


#: Scripts by code point ranges (fixed values).
SCRIPTS = {
    "hiragana": r"[\x{3040}-\x{309F}]",
    "katakana": r"[\x{30A0}-\x{30FF}]",
    "kanji": r"[\x{4E00}-\x{9FFF}]",
    "hangul": r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]",
    "arabic": r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]",
    "cyrillic": r"[\x{0400}-\x{04FF}]",
    "thai": r"[\x{0E00}-\x{0E7F}]",
    "latin": r"[A-Za-z]",
}


def script_counts(c: Column) -> dict[str, Column]:
    """Characters of each script in the whole text (0 for null)."""
    return {k: F.coalesce(F.regexp_count(c, F.lit(v)), F.lit(0)) for k, v in SCRIPTS.items()}


def detect_by_script(counts: dict[str, Column]) -> tuple[Column, Column]:
    """(language, confidence) by the first rule that fits; null where none does."""
    total = sum(counts.values(), F.lit(0))
    s = {k: F.when(total > 0, v / total) for k, v in counts.items()}
    kana = s["hiragana"] + s["katakana"]
    rules = [
        ((s["hiragana"] > 0.1) | (s["katakana"] > 0.05), "ja", F.least(F.lit(0.95), kana + 0.5)),
        (s["hangul"] > 0.3, "ko", F.least(F.lit(0.95), s["hangul"] + 0.3)),
        ((s["kanji"] > 0.3) & (s["hiragana"] == 0), "zh", F.least(F.lit(0.90), s["kanji"] + 0.2)),
        (s["arabic"] > 0.5, "ar", F.least(F.lit(0.95), s["arabic"] + 0.3)),
        (s["cyrillic"] > 0.5, "ru", F.least(F.lit(0.90), s["cyrillic"] + 0.2)),
        (s["thai"] > 0.5, "th", F.least(F.lit(0.95), s["thai"] + 0.3)),
        (s["latin"] > 0.7, "en", F.lit(0.5)),
    ]
    lang, conf = F.lit(None).cast("string"), F.lit(None).cast("double")
    for test, code, c in reversed(rules):
        lang, conf = F.when(test, code).otherwise(lang), F.when(test, c).otherwise(conf)
    return lang, F.round(conf, 6)


def salvage_json(c: Column) -> tuple[Column, Column]:
    """(language, confidence) of the first {...}, else of the bare fields, else en and 0.5; confidence within 0 and 1."""
    first = F.regexp_extract(c, r"(\{[^}]*\})", 1)
    j = F.from_json(first, "language string, confidence string")
    lang = F.coalesce(j["language"], F.nullif(F.regexp_extract(c, r'"language"\s*:\s*"([^"]+)"', 1), F.lit("")), F.lit("en"))
    conf = F.coalesce(j["confidence"].try_cast("double"), F.nullif(F.regexp_extract(c, r'"confidence"\s*:\s*([0-9]+\.?[0-9]*)', 1), F.lit("")).try_cast("double"), F.lit(0.5))
    return lang, F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf))


def expansion_scale(source: Column, target: Column) -> Column:
    """Font scale for a translation longer than its source: from a ratio of 1.3 a quarter of the excess, 0.8 at least."""
    r = target / source
    return F.when((source == 0) | (target == 0), 1.0).when(r >= 1.3, F.greatest(F.lit(0.80), 1.0 - (r - 1.0) * 0.25)).otherwise(1.0)


def paragraph_route(c: Column) -> Column:
    """What becomes of a paragraph: empty, kept (a page number), header, or body."""
    t = strip(c)
    n = F.length(t)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "empty")
        .when(t.startswith("-") & t.endswith("-") & (n < 10), "keep")
        .when((n < 50) & (c.contains("(") | c.contains(")") | ((F.upper(c) == c) & (F.lower(c) != c))), "header")
        .otherwise("body")
    )


def size_label(n: Column) -> Column:
    return F.format_string("%.1f KB", F.round(n / 1024.0, 1))


def preview(items: Column, most: int = 3) -> Column:
    """The first items and how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), "; "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))


def parse_bilingual(c: Column, marker: str = "=== TRANSLATION ===") -> Column:
    """What follows the marker of a bilingual file, else all of it."""
    parts = F.split(c, marker)
    return strip(F.when(F.size(parts) > 1, parts[1]).otherwise(c))


def format_bilingual(original: Column, translation: Column) -> Column:
    return F.concat(F.lit("=== ORIGINAL ===\n"), F.coalesce(original, F.lit("")), F.lit("\n\n=== TRANSLATION ===\n"), F.coalesce(translation, F.lit("")))


def derive_error(error: Column, steps: Column, warnings: Column, most: int = 500) -> Column:
    """A page's error: the given one, else those of the failed steps (array of struct(name, success, error)), else the first warnings."""
    failed = F.transform(F.filter(steps, lambda s: ~s["success"]), lambda s: F.coalesce(s["error"], F.concat(s["name"], F.lit(" failed"))))
    some = F.array_join(failed, ". ")
    warned = F.concat(F.lit("Processing failed: "), F.array_join(F.slice(warnings, 1, 3), "; "))
    return F.substring(F.coalesce(F.nullif(error, F.lit("Unknown error")), F.nullif(some, F.lit("")), F.when(F.size(warnings) > 0, warned), F.lit("Unknown error")), 1, most)


def prompt(text: Column, source: Column, target: Column, context: Column) -> Column:
    """Prompt for a translator with the book's context where there is one."""
    intro = F.format_string("Translate from %s to %s.", F.coalesce(source, F.lit("auto")), target)
    return F.concat(intro, F.coalesce(F.concat(F.lit(" Book: "), F.nullif(strip(context), F.lit("")), F.lit(".")), F.lit("")), F.lit("\n\n"), F.coalesce(text, F.lit("")))
