"""Languages of pages, mixed stretches and projects, by Bayesian evidence fusion.

First pass, one scan: each page is cut into units, and each unit gets its log-likelihood under every
language (character n-gram naive Bayes). Grouped aggregation then turns the page likelihoods into
host priors - the share of each language among the pages of a project, smoothed towards that of
its user, and that towards the whole - and into the reliability of declared labels and address
suffixes: the log-odds that they name the language the likelihoods find. Second pass:
a page's units are decoded together (Viterbi over languages), with the host prior, the declared
label and the likelihoods as evidence; a page of one language gives one answer, a mixed one its
longest stretches. Confidence is the posterior of the answer.

The host of a page is its project, the declared markup language its detected_language column; an
address suffix that names a language (image paths like .../x.de.jpg) counts as a second, weaker
declaration. Defined results: blank pages and pages of furniture alone have no language; labels
are compared with the languages table; a project without readable pages has none.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

from foliolake.llm import naivebayes, pagetext, sentences

#: Weight (in pages) of the user's shares in a project's prior, and of the whole in a user's.
HOST_WEIGHT, USER_WEIGHT = 2.0, 5.0
#: Most that a declared label or an address suffix may add to its language's log-odds, however reliable they are.
MOST_ODDS = 3.0
#: Cost of a change of language between units, and the least a foreign stretch must be better by.
SWITCH = 5.0

_SUFFIX = re.compile(r"[./_-]([a-z]{2})(?:[._-][a-z]+)?\.(?:jpg|jpeg|png|tif|tiff|pdf)$", re.I)


def suffix_label(path: str | None) -> str | None:
    m = _SUFFIX.search(path or "")
    return m[1].lower() if m else None


def pieces(text: str, title: str | None, number: int | None) -> list[str]:
    """Short pieces of a page without its furniture: pages may mix languages, and headings must count too."""
    lines = text.split("\n")
    body = [s for s, k in zip(lines, pagetext.furniture(lines, title, number), strict=True) if not k and s.strip()]
    return [" ".join(body[i : i + 3]) for i in range(0, len(body), 3)]


def fit_languages(rows: list[tuple[str, str | None, int | None, str | None]], langs: list[str], codes: dict[str, str]) -> naivebayes.NaiveBayes:
    """From (text, title, number, declared label) of pages."""
    return naivebayes.fit([(x, naivebayes.normal_label(label, codes)) for text, title, number, label in rows for x in pieces(text, title, number)], langs)


def unit_likelihoods(text: str, units: list[tuple[int, int]], nb: naivebayes.NaiveBayes) -> np.ndarray:
    ll = nb.many([naivebayes.clean(text[a:b]) for a, b in units])
    ll[:, nb.prior < -20] = -1000.0  # languages no text is written in
    return ll


def decode(ll: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> list[int]:
    """The best sequence of languages; the prior is that of the page's main language."""
    n, k = ll.shape
    best = np.zeros((n, k))
    back = np.zeros((n, k), int)
    best[0] = prior + ll[0]
    for i in range(1, n):
        top = int(best[i - 1].argmax())
        stay = best[i - 1]
        change = stay[top] - switch + 0.5 * prior
        back[i] = np.where(stay >= change, np.arange(k), top)
        best[i] = np.maximum(stay, change) + ll[i]
    out = [int(best[-1].argmax())]
    for i in range(n - 1, 0, -1):
        out.append(int(back[i, out[-1]]))
    return out[::-1]


# -- Spark ------------------------------------------------------------------------------------------


def fit_on(pages, langs: list[str], codes: dict[str, str]):
    """``fit_languages`` on all ``pages`` (ocr_text, title, page_number, detected_language), broadcast."""
    import pyarrow as pa

    index = {c: k for k, c in enumerate(langs)}

    def run(batches):
        for batch in sentences.slices(batches):
            found: Counter[tuple[str, int]] = Counter()
            for t, title, number, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lab = index.get(naivebayes.normal_label(label, codes) or "", -1)
                found.update((naivebayes.clean(x), lab) for x in pieces(t, title, number))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([x for _, x in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["t", "lab", "n"])

    texts = pages.filter("ocr_text is not null").select("ocr_text", "title", "page_number", "detected_language").mapInArrow(run, "t string, lab int, n long")
    return pages.sparkSession.sparkContext.broadcast(naivebayes.fit_on(texts, langs))


def evidence(pages, model, nb, codes):
    """First pass: page_id, project_id, declared label, the languages (as places in the list, null if none) that label and suffix name, the likeliest one, starts, sizes, ll (units x languages, flat)."""
    import pyarrow as pa

    schema = "page_id long, project_id long, declared string, label int, suffix int, best int, starts array<int>, sizes array<int>, ll array<float>"
    fields = [("page_id", pa.int64()), ("project_id", pa.int64()), ("declared", pa.string()), ("label", pa.int32()), ("suffix", pa.int32()), ("best", pa.int32()), ("starts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("ll", pa.list_(pa.float32()))]

    def run(batches):
        segmenter = sentences.Segmenter(model.value)
        bayes = nb.value
        index = {c: i for i, c in enumerate(bayes.langs)}
        for batch in sentences.slices(batches):
            rows: list[tuple] = []
            for page, project, label, path, t, title, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                units = sentences.page_units(t, title, number, segmenter) if t else []
                if not units:
                    continue
                ll = unit_likelihoods(t, units, bayes)
                named = index.get(naivebayes.normal_label(label, codes)), index.get(codes.get(suffix_label(path) or ""))
                rows.append((page, project, label, *named, int(ll.sum(axis=0).argmax()), [a for a, _ in units], [b - a for a, b in units], ll.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f) for i, (_, f) in enumerate(fields)], names=[n for n, _ in fields])

    return pages.select("page_id", "project_id", "detected_language", "original_image_path", "ocr_text", "title", "page_number").mapInArrow(run, schema)


def host_priors(seen, projects, langs):
    """project_id, prior (log-shares), n: each page counts once, for its likeliest language."""
    from pyspark.sql import functions as F

    k = len(langs)
    votes = seen.select("project_id", (F.col("best") + 1).alias("best"))
    counts = [F.count_if(F.col("best") == j + 1).alias(f"c{j}") for j in range(k)]
    by_project = votes.groupBy("project_id").agg(*counts)
    by_project = by_project.join(projects.select("project_id", "user_id").dropDuplicates(["project_id"]), "project_id", "left")
    sums = [F.sum(f"c{j}").alias(f"u{j}") for j in range(k)]
    by_user = by_project.groupBy("user_id").agg(*sums)
    whole = by_project.agg(*[F.sum(f"c{j}").alias(f"w{j}") for j in range(k)])
    out = by_project.join(by_user, by_project.user_id.eqNullSafe(by_user.user_id), "left").drop("user_id")
    one = whole.select(F.struct(*[f"w{j}" for j in range(k)]).alias("w")).scalar()
    out = out.withColumn("w", one).select("*", "w.*")
    w = sum((F.col(f"w{j}") for j in range(k)), F.lit(0))
    u = sum((F.col(f"u{j}") for j in range(k)), F.lit(0))
    c = sum((F.col(f"c{j}") for j in range(k)), F.lit(0))
    share_w = [(F.col(f"w{j}") + 0.01) / (w + 0.01 * k) for j in range(k)]
    share_u = [(F.col(f"u{j}") + USER_WEIGHT * share_w[j]) / (u + USER_WEIGHT) for j in range(k)]
    share = [F.log((F.col(f"c{j}") + HOST_WEIGHT * share_u[j]) / (c + HOST_WEIGHT)).cast("float") for j in range(k)]
    return out.select("project_id", F.array(*share).alias("prior"))


def reliability(seen) -> tuple[float, float]:
    """Log-odds that declared labels, and address suffixes, name the likeliest language: counts over all pages, one row to the driver."""
    from pyspark.sql import functions as F

    count = lambda c: (F.count_if(F.col(c) == F.col("best")).alias(f"{c}_hit"), F.count_if(F.col(c) != F.col("best")).alias(f"{c}_miss"))
    n = seen.agg(*count("label"), *count("suffix")).first()
    return tuple(min(MOST_ODDS, max(0.0, math.log((n[f"{c}_hit"] + 1) / (n[f"{c}_miss"] + 1)))) for c in ("label", "suffix"))


def decided(seen, priors, langs):
    """Second pass: page_id, project_id, declared, segments (start_pos, lang, confidence), main language."""
    import pandas as pd

    from foliolake.session import lookup

    odds = reliability(seen)
    joined = lookup(seen, priors, "project_id", "page_id")

    def run(frames):
        for f in frames:
            rows = []
            for page, project, label, *named, starts, sizes, flat, prior in zip(*(f[c] for c in ("page_id", "project_id", "declared", "label", "suffix", "starts", "sizes", "ll", "prior")), strict=True):
                ll = np.asarray(flat, float).reshape(len(starts), len(langs))
                p = np.maximum(np.asarray(prior, float), -8.0) if prior is not None else np.zeros(len(langs))
                for lab, more in zip(named, odds, strict=True):
                    if lab is not None and lab == lab:  # not null
                        p = p.copy()
                        p[int(lab)] += more
                path = decode(ll, p)
                weight: Counter[int] = Counter()
                for k, n in zip(path, sizes, strict=True):
                    weight[k] += n
                main = max(weight, key=lambda k: (weight[k], -k))
                cuts = [0, *(i for i in range(1, len(path)) if path[i] != path[i - 1]), len(path)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    s = ll[a:b].sum(axis=0) + p
                    s = np.exp(s - s.max())
                    rows.append((page, project, label, int(starts[a]), langs[path[a]], float(s[path[a]] / s.sum()), langs[main], len(cuts) - 1))
            yield pd.DataFrame(rows, columns=["page_id", "project_id", "declared", "start_pos", "lang", "confidence", "main", "stretches"])

    return joined.mapInPandas(run, "page_id long, project_id long, declared string, start_pos int, lang string, confidence double, main string, stretches int")


def label_case(column, codes):
    """Column: the code a label column names, or null."""
    from pyspark.sql import functions as F

    table = F.create_map(*[F.lit(x) for kv in sorted(codes.items()) for x in kv])
    low = F.lower(F.trim(column))
    return F.coalesce(F.try_element_at(table, low), F.try_element_at(table, F.regexp_extract(low, r"^([^-_ (]*)", 1)))


def mislabelled(decisions, projects, codes):
    """rec_kind, rec_id, start_pos, lang, confidence: projects and pages with a missing or wrong label, stretches of mixed pages."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    cols = ["rec_kind", "rec_id", "start_pos", "lang", "confidence"]
    mixed = decisions.filter("stretches > 1").select(F.lit("segment").alias("rec_kind"), F.col("page_id").alias("rec_id"), "start_pos", "lang", "confidence")
    single = decisions.filter("stretches = 1 and (declared is null or declared <> lang)").select(F.lit("page").alias("rec_kind"), F.col("page_id").alias("rec_id"), F.lit(0).alias("start_pos"), "lang", "confidence")
    # one row for each project and language; a hot project is pre-aggregated on the map side
    first = decisions.filter("stretches = 1").unionByName(decisions.filter("stretches > 1").dropDuplicates(["page_id"]))
    votes = first.groupBy("project_id", "main").agg(F.count("*").alias("n"))
    w = Window.partitionBy("project_id")
    top = votes.withColumn("all", F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "main"))).filter("rank = 1")
    labels = projects.select("project_id", label_case(F.col("source_language"), codes).alias("label"))
    wrong = top.join(labels, "project_id").filter("label is null or label <> main")
    project = wrong.select(F.lit("project").alias("rec_kind"), F.col("project_id").alias("rec_id"), F.lit(0).alias("start_pos"), F.col("main").alias("lang"), (F.col("n") / F.col("all")).alias("confidence"))
    return project.select(cols).unionByName(single.select(cols)).unionByName(mixed.select(cols))
