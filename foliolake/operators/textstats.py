"""Text analytics over pages: glossary, languages by script, expansion, translator seams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.functions import text as t


def glossary(pages: DataFrame, k: int = 60) -> DataFrame:
    """The k commonest terms: ASCII words of over five letters and CJK runs of two or more, in the translation, else the OCR text.

    Counts are combined on the map side; the order is by count, then by first place (page, kind, offset).
    """
    content = pages.select("page_id", F.coalesce(F.nullif("translated_text", F.lit("")), F.col("ocr_text")).alias("c"))
    words = content.select("page_id", F.lit(0).alias("kind"), F.posexplode(F.split("c", r"\s+")).alias("pos", "term")).filter(F.col("term").rlike("^[A-Za-z]{6,}$"))
    runs = content.select("page_id", F.lit(1).alias("kind"), F.posexplode(F.regexp_extract_all("c", F.lit(r"([\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]{2,})"), 1)).alias("pos", "term"))
    n = words.unionByName(runs).groupBy("term").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "kind", "pos")).alias("first"))
    return n.orderBy(F.desc("n"), "first", "term").limit(k).select("term", "n")


def script_languages(pages: DataFrame, text: str = "ocr_text") -> DataFrame:
    """Script counts of each text with the language they tell."""
    counts = pages.select("page_id", *[c.alias(k) for k, c in t.script_counts(F.col(text)).items()])
    lang, conf = t.detect_by_script({k: F.col(k) for k in t.SCRIPTS})
    return counts.withColumn("language", lang).withColumn("confidence", conf)


def cascade(pages: DataFrame, model: Callable[[pd.Series], pd.Series] | None = None, text: str = "ocr_text", default: str = "ja") -> DataFrame:
    """Blank texts get the default, sure ones the heuristic; only the rest reach the model (a split, so it sees no others). No shuffle."""
    counts = t.script_counts(F.col(text))
    d = pages.select("page_id", F.col(text).alias("t"), *[c.alias(f"_{k}") for k, c in counts.items()])
    lang, conf = t.detect_by_script({k: F.col(f"_{k}") for k in counts})
    blank = F.coalesce(t.strip(F.col("t")), F.lit("")) == ""
    method = F.when(blank, "default").when(conf > 0.9, "heuristic").otherwise("fallback" if model is None else "model")
    d = d.select("page_id", "t", lang.alias("language"), conf.alias("confidence"), method.alias("method"))
    rest = d.filter("method in ('fallback', 'model')")
    known = d.filter("method not in ('fallback', 'model')").select("page_id", F.when(F.col("method") == "default", default).otherwise(F.col("language")).alias("language"), F.when(F.col("method") == "default", 0.0).otherwise(F.col("confidence")).alias("confidence"), "method")
    if model is None:
        return known.unionByName(rest.select("page_id", F.coalesce("language", F.lit(default)).alias("language"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "method"))
    ask = F.pandas_udf(model, "string")
    return known.unionByName(rest.select("page_id", ask("t").alias("language"), F.lit(0.9).alias("confidence"), "method"))


def language_names(labels: DataFrame, languages: DataFrame) -> DataFrame:
    """Names of language codes; unknown ones say so."""
    dim = languages.select(F.col("code").alias("label"), "name").dropDuplicates(["label"])
    return labels.join(dim, "label", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("Unknown ("), F.col("label"), F.lit(")"))))


def expansion(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """Solid characters of each page's text and of its boxes' translations, with the font scale and line height they ask for."""
    target = boxes.groupBy("page_id").agg(F.sum(t.solid_length(F.col("translation"))).alias("target"))
    j = pages.select("page_id", t.solid_length(F.col("ocr_text")).cast("long").alias("source")).join(target, "page_id", "left").withColumn("target", F.coalesce("target", F.lit(0)).cast("long"))
    s = t.expansion_scale(F.col("source"), F.col("target"))
    return j.select("page_id", "source", "target", F.round(s, 6).alias("scale"), F.when(s < 0.95, 1.26).otherwise(1.4).alias("line_height"))


# -- seams for models -------------------------------------------------------------------------------


def stub_translator(texts: pd.Series) -> pd.Series:
    """Deterministic offline translator."""
    return "[EN]" + texts


def translate_once(df: DataFrame, text: str, translator: Callable[[pd.Series], pd.Series] = stub_translator) -> DataFrame:
    """Translate every different text once and join the answers back. Blank texts give ''; where the translator fails the text stays.

    Texts meet by two hashes, blank ones do not travel, and a text repeated without end is dealt
    over salts, to each of which its one answer goes.
    """

    def safe(texts: pd.Series) -> pd.Series:
        try:
            return translator(texts)
        except Exception:  # one bad text must not lose the batch
            out = []
            for x in texts:
                try:
                    out.append(translator(pd.Series([x])).iloc[0])
                except Exception:
                    out.append(None)
            return pd.Series(out, dtype=object)

    safe.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    ask = F.pandas_udf(safe, "string")
    salts, blank = 16, F.coalesce(t.strip(F.col(text)), F.lit("")) == ""
    keyed = df.withColumn("_h", F.xxhash64(text)).withColumn("_i", F.hash(text)).withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    some = keyed.filter(~blank).groupBy("_h", "_i").agg(F.min(text).alias("_t")).withColumn("_a", ask("_t")).select("_h", "_i", "_a", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    answered = keyed.filter(~blank).join(some, ["_h", "_i", "_salt"], "left").withColumn("translated", F.coalesce("_a", F.col(text)))
    return answered.select(*df.columns, "translated").unionByName(keyed.filter(blank).select(*df.columns, F.lit("").alias("translated")))


def translate_values(df: DataFrame, key: str, labels: str, translator: Callable[[pd.Series], pd.Series] = stub_translator) -> DataFrame:
    """``key`` and the map ``labels`` with its values translated, each different value once; null and empty maps stay, null values too."""
    flat = df.select(key, F.explode(labels).alias("_k", "_v"))
    done = translate_once(flat, "_v", translator).select(key, F.struct("_k", F.when(F.col("_v").isNotNull(), F.col("translated")).alias("_v")).alias("_e"))
    maps = done.groupBy(key).agg(F.map_from_entries(F.collect_list("_e")).alias("_m"))
    return df.select(key, labels).join(maps, key, "left").select(key, F.coalesce("_m", F.col(labels)).alias(labels))


def extract_rows(df: DataFrame, extract: Callable[[pd.DataFrame], Iterator[tuple]], schema: str) -> DataFrame:
    """One-to-many extraction by a model (tables, regions): ``extract`` gets a batch and yields rows of ``schema``."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame(list(extract(f)), columns=names)

    return df.mapInPandas(run, schema)
