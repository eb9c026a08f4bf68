"""Character n-gram naive Bayes over languages, vectorised over whole batches of text.

The n-grams (1 to 4 characters, numbers and part codes left out, case folded) are hashed into a
table of log-probabilities; the score of any stretch of text is a difference of running sums.
Labels are cleaned by cross-fitting: each half of the sample is labelled anew by the model of the
other half, so a wrong label can't defend itself, and languages no text is written in die out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np

BITS = 17
ORDERS = (1, 2, 3, 4)
#: n-grams of several orders at one place say much the same: their sum is damped.
DAMP = 0.4
#: Characters scored at once; longer texts are scored in pieces.
BLOCK = 200_000
#: How much better (a character, damped) a language's own model must explain its texts than any other's.
TWIN_GAP = 0.08
#: A class is a wrong label if larger classes explain so much of its texts as well, or it so much of a larger one's.
TWIN_OWN, TWIN_OTHER = 0.7, 0.5
_CODE = re.compile(r"[A-Z]{1,2}[-/]?\d+|[0-9０-９]+(?:[.,][0-9]+)*")
_OTHER, _DIGIT = re.compile(r"[\W_]+"), re.compile(r"\d")
_ASCII_OTHER = {c: " " for c in range(128) if not chr(c).isalnum()}
#: Between texts that are looked at together, so that no n-gram is of two of them: an end's n-grams reach so far.
GAP = "  "


def clean(text: str) -> str:
    """Letters with single spaces; codes, numbers and punctuation are spaces."""
    if _DIGIT.search(text):
        text = _CODE.sub(" ", text)
    if text.isascii():
        return f" {' '.join(text.translate(_ASCII_OTHER).split()).lower()} "
    return f" {_OTHER.sub(' ', text).strip().casefold()} "


def weight(n):
    """What a text seen n times counts; of few binary places, so that sums are exact in any order."""
    return np.round((1.0 + np.log(n)) * 65_536) / 65_536


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """For each order, the hash of the n-gram that ends at each place (0 where there is none)."""
    out = []
    c = codes.astype(np.uint64)
    letter = codes != 32
    for n in ORDERS:
        h = np.zeros(len(c), np.uint64)
        if len(c) >= n:
            acc = np.full(len(c) - n + 1, n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
            some = np.zeros(len(c) - n + 1, bool)
            for k in range(n):
                part = c[k : len(c) - n + 1 + k]
                acc = (acc ^ part) * np.uint64(0xBF58476D1CE4E5B9)
                acc ^= acc >> np.uint64(27)
                some |= letter[k : len(c) - n + 1 + k]
            h[n - 1 :] = np.where(some, (acc >> np.uint64(64 - BITS)) | np.uint64(1), 0)
        out.append(h.astype(np.int64))
    return out


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class NaiveBayes:
    def __init__(self, langs: list[str], counts: np.ndarray, shares: np.ndarray):
        """counts: (n-gram, language)."""
        self.langs = langs
        self.prior = np.where(shares > 0, np.log(np.maximum(shares, 1e-6)), -50.0).astype(np.float32)
        total = counts.sum(axis=0, keepdims=True) + 1.0
        table = np.log((counts + 0.02) / (total + 0.02 * 20_000))
        # against the mean over languages: an n-gram never seen says nothing
        table = table - table.mean(axis=1, keepdims=True)
        table[counts.sum(axis=1) == 0] = 0.0
        table[0] = 0.0
        # languages without any count have the same column
        none = counts.sum(axis=0) == 0
        kept = [*np.flatnonzero(~none), *np.flatnonzero(none)[:1]]
        self.place = np.where(none, len(kept) - 1, np.cumsum(~none) - 1)
        self.columns = np.ascontiguousarray(table[:, kept] * DAMP, dtype=np.float32)

    @property
    def table(self) -> np.ndarray:
        """(n-gram, language): weighted log-probabilities."""
        return self.columns[:, self.place]

    def many(self, texts: list[str]) -> np.ndarray:
        """(texts, languages) log-likelihoods of cleaned texts, in blocks of bounded size; each of its own n-grams alone."""
        out = np.zeros((len(texts), self.columns.shape[1]))
        owner, pieces = zip(*[(i, t[k : k + BLOCK]) for i, t in enumerate(texts) for k in range(0, len(t), BLOCK)], strict=True) if any(texts) else ((), ())
        for lo, hi in blocks(pieces):
            part = pieces[lo:hi]
            places = grams(codepoints(GAP + GAP.join(part) + GAP))
            per = self.columns.take(places[0], axis=0)
            for g in places[1:]:
                per += self.columns.take(g, axis=0)
            starts = len(GAP) + np.cumsum([0, *(len(t) + len(GAP) for t in part[:-1])])
            # the n-grams of the gaps, of how a text ends, stay out: of a short one they would be half the evidence
            ends = starts + [len(t) for t in part]
            sums = np.add.reduceat(per, np.stack([starts, ends], axis=1).ravel(), axis=0, dtype=np.float64)[::2]
            if len(set(owner[lo:hi])) == hi - lo:
                out[list(owner[lo:hi])] += sums
            else:
                np.add.at(out, list(owner[lo:hi]), sums)
        return out[:, self.place]


def blocks(texts, chars: int = BLOCK) -> list[tuple[int, int]]:
    """Ranges of texts of about so many characters together."""
    out, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            out.append((lo, i))
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        out.append((lo, len(texts)))
    return out


def count_grams(texts: list[str], labels: np.ndarray, weights: np.ndarray, n_langs: int) -> np.ndarray:
    out = np.zeros((1 << BITS, n_langs))
    for k in range(n_langs):
        mine = np.flatnonzero(labels == k)
        some, own = [texts[i] for i in mine.tolist()], weights[mine]
        for lo, hi in blocks(some):
            part = some[lo:hi]
            w = np.concatenate([np.zeros(len(GAP)), np.repeat(own[lo:hi], [len(t) + len(GAP) for t in part])])
            for g in grams(codepoints(GAP + GAP.join(part) + GAP)):
                out[:, k] += np.bincount(g, weights=w, minlength=1 << BITS)
    out[0] = 0
    return out


def relabelled(ll: np.ndarray, now: np.ndarray, usable: list[int]) -> np.ndarray:
    """New labels from the likelihoods: short texts keep their label unless another fits clearly better."""
    ll = ll.copy()
    ll[:, [k for k in range(ll.shape[1]) if k not in usable]] = -1e9
    own = np.where(now >= 0, ll[np.arange(len(now)), np.maximum(now, 0)], -1e9)
    return np.where((ll.max(axis=1) - own > 2.0) | (own <= -1e8), ll.argmax(axis=1), now)


def wrong_classes(near: Counter[tuple[int, tuple[bool, ...]]]) -> tuple[list[int], set[int]]:
    """Classes, smallest first, and those that are a wrong label and no language; from the numbers of texts by class and, for each class, whether it explains them as well.

    A small class of wrong labels may explain its own few texts, of one book, better than the language they are in
    does; but then it explains the texts of that language as well, as no other language could. So both
    directions count, and only a larger class stands against a smaller one.
    """
    size: Counter[int] = Counter()
    for (x, _), n in near.items():
        size[x] += n
    alive = sorted(sorted(size), key=lambda x: size[x])
    share = lambda x, others: sum(n for (y, close), n in near.items() if y == x and any(close[j] for j in others)) / size[x]
    dead: set[int] = set()
    for at, x in enumerate(alive[:-1], 1):
        larger = alive[at:]
        if size[x] < 0.5 * size[alive[-1]] and (share(x, larger) > TWIN_OWN or any(share(j, [x]) > TWIN_OTHER for j in larger)):
            dead.add(x)
    return alive, dead


def fit(rows: list[tuple[str, str | None]], langs: list[str], rounds: int = 3, fixed: bool = False) -> NaiveBayes:
    """From (text, label or None). Equal texts count once for each label (with the logarithm of their number)."""
    index = {c: k for k, c in enumerate(langs)}
    seen = Counter((clean(t), lab if lab in index else None) for t, lab in rows if t)
    items = [(t, index.get(lab, -1), weight(n)) for (t, lab), n in sorted(seen.items(), key=lambda x: (x[0][0], x[0][1] or "")) if len(t) > 2]
    texts = [t for t, _, _ in items]
    labels = np.array([k for _, k, _ in items], int)
    weights = np.array([w for _, _, w in items])
    half = np.array([zlib.crc32(t.encode()) & 1 for t in texts], int)
    now = labels.copy()
    sizes = np.array([max(1, len(t)) for t in texts], float)
    for _ in range(0 if fixed else rounds):
        ll = np.zeros((len(texts), len(langs)))
        for h in (0, 1):
            train = (half != h) & (now >= 0)
            if not train.any():
                return NaiveBayes(langs, np.zeros((1 << BITS, len(langs)), np.float32), np.full(len(langs), 1 / len(langs)))
            tt = [t for t, m in zip(texts, train, strict=True) if m]
            shares = np.bincount(now[train], minlength=len(langs)) / train.sum()
            model = NaiveBayes(langs, count_grams(tt, now[train], weights[train], len(langs)), shares)
            mine = np.flatnonzero(half == h)
            ll[mine] = model.many([texts[i] for i in mine])
        mine = np.flatnonzero(now >= 0)
        close = (ll[mine] - ll[mine, now[mine]][:, None]) / sizes[mine][:, None] > -TWIN_GAP
        close[np.arange(len(mine)), now[mine]] = False
        alive, dead = wrong_classes(Counter(zip(now[mine].tolist(), map(tuple, close.tolist()), strict=True)))
        if dead:
            ll[:, sorted(dead)] = -1e9
        now = relabelled(ll, now, [k for k in alive if k not in dead])
    shares = np.bincount(now[now >= 0], minlength=len(langs)) / max(1, (now >= 0).sum())
    keep = now >= 0
    model = NaiveBayes(langs, count_grams([t for t, m in zip(texts, keep, strict=True) if m], now[keep], weights[keep], len(langs)), shares)
    return model


def fit_on(texts, langs: list[str], rounds: int = 3) -> NaiveBayes:
    """``fit`` on all rows of ``texts`` (t: cleaned text, lab: place of its label in ``langs`` or -1, n: count), by grouped counts.

    The texts stay on the cluster with their labels and likelihoods (a checkpoint a round). What reaches the driver are
    the n-gram counts by language and, of each class, how many texts another class explains as well.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    from foliolake.session import checkpointed

    spark, k, usable = texts.sparkSession, len(langs), None
    sc = spark.sparkContext
    items = texts.filter("length(t) > 2").repartition(2 * sc.defaultParallelism, "t", "lab").groupBy("t", "lab").agg(F.sum("n").alias("n"))
    state = checkpointed(items.select("t", (F.crc32("t") % 2).cast("int").alias("half"), "n", F.col("lab").alias("now"), F.array().cast("array<float>").alias("ll")))

    def read(batch, usable):
        """Texts, weights, halves, labels before and labels of a batch."""
        t, half, n, old, ll = batch.columns
        old = now = old.to_numpy(zero_copy_only=False).astype(int)
        if usable is not None and len(t):
            now = relabelled(ll.flatten().to_numpy(zero_copy_only=False).reshape(len(t), k).astype(float), old, usable)
        return t, n.to_numpy(zero_copy_only=False), half.to_numpy(zero_copy_only=False), old, now

    def counted(state, usable):
        """(half, n-gram, language) -> counts, and (half, language) -> numbers of texts; from the second time on, what the new labels change in them."""

        def run(batches):
            sums, sizes = np.zeros((2, 1 << BITS, k)), np.zeros((2, k), np.int64)
            for batch in batches:
                t, n, half, old, now = read(batch, usable)
                for labels, sign in ((now, 1), (old, -1)) if usable is not None else ((now, 1),):
                    for h in (0, 1):
                        mine = np.flatnonzero((half == h) & (labels >= 0) & ((old != now) | (usable is None)))
                        if len(mine):
                            sums[h] += sign * count_grams([t[i].as_py() for i in mine.tolist()], labels[mine], weight(n[mine]), k)
                            sizes[h] += sign * np.bincount(labels[mine], minlength=k)
            for h in (0, 1):
                for lang in np.flatnonzero(sums[h].any(axis=0) | (sizes[h] != 0)).tolist():
                    some = np.flatnonzero(sums[h, :, lang])
                    grams_ = np.concatenate([[-1], some])
                    values = np.concatenate([[sizes[h, lang]], sums[h, some, lang]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams_), h), pa.int32()), pa.array(np.full(len(grams_), lang), pa.int32()), pa.array(grams_, pa.int32()), pa.array(values, pa.float64())], names=["half", "lang", "gram", "n"])

        got = state.mapInArrow(run, "half int, lang int, gram int, n double").groupBy("half", "lang", "gram").agg(F.sum("n").alias("n")).toArrow()
        half, lang, gram, n = (c.to_numpy() for c in got.columns)
        sums, sizes = np.zeros((2, 1 << BITS, k)), np.zeros((2, k))
        own = gram >= 0
        sums[half[own], gram[own], lang[own]] = n[own]
        sizes[half[~own], lang[~own]] = n[~own]
        return sums, sizes

    sums, sizes = counted(state, None)
    for _ in range(rounds):
        if not sizes.sum(axis=1).all():
            return NaiveBayes(langs, np.zeros((1 << BITS, k), np.float32), np.full(k, 1 / k))
        # each half is labelled by the model of the other
        models = sc.broadcast([NaiveBayes(langs, sums[1 - h].astype(np.float32), sizes[1 - h] / sizes[1 - h].sum()) for h in (0, 1)])

        def score(batches, usable=usable, models=models):
            for batch in batches:
                t, _, half, _, now = read(batch, usable)
                t, ll = t.to_pylist(), np.zeros((batch.num_rows, k), np.float32)
                for h in (0, 1):
                    mine = np.flatnonzero(half == h)
                    if len(mine):
                        ll[mine] = models.value[h].many([t[i] for i in mine.tolist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(now, pa.int32()), pa.ListArray.from_arrays(np.arange(len(t) + 1, dtype=np.int32) * k, pa.array(ll.ravel(), pa.float32()))], names=["t", "half", "n", "now", "ll"])

        state = checkpointed(state.mapInArrow(score, "t string, half int, n long, now int, ll array<float>"))
        close = [F.expr(f"(ll[{j}] - ll[now]) / length(t) > {-TWIN_GAP} and now <> {j}") for j in range(k)]
        near = state.filter("now >= 0").groupBy("now", F.array(*close).alias("close")).count().collect()
        alive, dead = wrong_classes(Counter({(r["now"], tuple(r["close"])): r["count"] for r in near}))
        usable = [x for x in alive if x not in dead]
        more, moved = counted(state, usable)
        sums, sizes = sums + more, sizes + moved
    return NaiveBayes(langs, sums.sum(axis=0).astype(np.float32), sizes.sum(axis=0) / max(1, sizes.sum()))


# Spellings of language labels beyond the codes and names of the languages table.
SPELLINGS = {
    "ger": "de", "deutsch": "de", "fre": "fr", "français": "fr", "francais": "fr", "español": "es", "espanol": "es", "castellano": "es",
    "português": "pt", "portugues": "pt", "русский": "ru", "日本語": "ja", "jp": "ja", "chi": "zh", "中文": "zh", "mandarin": "zh", "cn": "zh", "ไทย": "th",
    "nihongo": "ja", "dut": "nl", "українська": "uk",
}


def label_codes(languages: list[tuple[str, str, str]]) -> dict[str, str]:
    """spelling (lower case) -> code, of (code, code3, name) rows."""
    out = dict(SPELLINGS)
    for code, code3, name in languages:
        out |= {x.strip().lower(): code for x in (code, code3, name) if x}
    return out


def normal_label(label: str | None, codes: dict[str, str]) -> str | None:
    """The code a label names, or None."""
    if not label:
        return None
    low = label.strip().lower()
    return codes.get(low) or codes.get(re.split(r"[-_ (]", low)[0])
