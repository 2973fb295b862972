"""Toxicity by maximum-scoring segments of token log-odds.

Learning.  Every word of the labelled training documents gets the log-odds of the toxic
against the other documents, under a Dirichlet prior: a flat part plus the word's share of
all documents' words.  Presence in a document counts once, so that a repeated word is one
observation.  The log-odds are shrunk by ``SHRINK`` standard errors, and words whose rest is
zero are left out.  Beginnings of words (``STEMS`` letters) are entries like words; a word
that is no entry takes the score of its longest beginning that is one.

Scoring.  Each word scores its log-odds less a drift, so that the expected score of clean
text is negative.  One linear scan finds every maximal segment: the passages whose sums no
longer or shorter neighbour beats.  Sums of clean text follow an extreme-value law, so a
segment of sum S in a text of n words is expected K n exp(-lambda S) times by chance; lambda
is the root of E exp(lambda s) = 1 over the words of clean training documents and K the
maximum-likelihood value over their best segments.  A document's evidence adds
lambda S - ln(K n) over its significant segments (expected at most ``CHANCE`` times), or
is that of its best segment if none is; a logistic curve makes it a score from 0 to 1.

lambda, K and the curve are fitted on training documents scored by what the other folds
have learned.  Words are aggregated on the cluster; to the driver come the entries (words
of the bounded training sample), histograms and single rows.

Results for special rows: null and empty texts, and texts without words, have no segment
and the least evidence; a null key is held out and never learned from; a key with several
labels is toxic if one of them says so; of labelled keys the ``MAX_LABELLED`` with the least
hashes are learned from, all rows of such a key are; without both classes the score is the
share of toxic rows for every text; equal rows are scored one by one; an empty table gives
an empty table; columns beyond key and text are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, plain, settled

WORD = re.compile(r"[^\W\d_]+")
#: Labelled keys that are learned from at most.
MAX_LABELLED = 20_000
#: Lengths of the beginnings of words that are entries, longest first.
STEMS = (7, 6, 5)
#: Flat part of the prior, and the weight of the corpus's shares.
FLAT, WEIGHT = 0.5, 50.0
#: Standard errors that an entry's log-odds are shrunk by.
SHRINK = 1.5
#: Standard errors that an entry needs before the prior is known; fewer than it needs then.
TELLING = 1.25
#: Drift per word beyond the mean score of clean text.
DRIFT = 0.2
#: Expected number of chance segments up to which a segment is significant.
CHANCE = 0.05
FOLDS = 5
#: Width of the histograms that lambda and the curve are fitted on.
WIDTH = 0.02
#: Words whose score a worker keeps.
KEPT_WORDS = 400_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def fold(key: str) -> Column:
    """The fold of a key: the checksum of its decimal text; 0, held out, for null."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def entries_of(words: set[str]) -> set[str]:
    """The words and their beginnings (marked by a star)."""
    found = set(words)
    for size in STEMS:
        found.update(f"{w[:size]}*" for w in words if len(w) > size)
    return found


def entry_for(word: str, known: dict[str, int]) -> int:
    """The number of the word's entry, or of its longest beginning's, or -1."""
    at = known.get(word)
    if at is not None:
        return at
    for size in STEMS:
        if len(word) > size:
            at = known.get(f"{word[:size]}*")
            if at is not None:
                return at
    return -1


class Lookup:
    """Entries of words; a bounded number of answers is kept."""

    def __init__(self, names: Sequence[str]):
        self.known = {name: at for at, name in enumerate(names)}
        self.kept: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.kept)
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept = {}
            new = set(words)
        for word in new:
            self.kept[word] = entry_for(word, self.known)
        return np.fromiter(map(self.kept.__getitem__, words), np.int64, len(words))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, sum) in order, by one linear scan.

    Candidates are kept with the running sum before and after them; a positive score joins
    the candidates back to the last one that begins lower and ends lower.  Each candidate
    points to the last earlier one that begins lower, so that the search jumps.
    """
    after = np.cumsum(scores)
    at = np.flatnonzero(scores > 0)
    begin: list[int] = []
    end: list[int] = []
    low: list[float] = []
    high: list[float] = []
    link: list[int] = []
    for i, right, left in zip(at.tolist(), after[at].tolist(), (after[at] - scores[at]).tolist(), strict=True):
        first = i
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= left:
                j = link[j]
            if j < 0 or high[j] >= right:
                break
            first, left = begin[j], low[j]
            del begin[j:], end[j:], low[j:], high[j:], link[j:]
        begin.append(first)
        end.append(i + 1)
        low.append(left)
        high.append(right)
        link.append(j)
    return [(b, e, h - lo) for b, e, lo, h in zip(begin, end, low, high, strict=True)]


# --- what the labelled rows and the corpus hold ------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> DataFrame:
    """(fold, toxic, text) of the labelled rows outside the held-out fold."""
    known = labels.groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("toxic"))
    usable = known.where(F.col("_key").isNotNull() & F.col("toxic").isNotNull())
    usable = usable.withColumn("fold", fold("_key")).where("fold <> 0")
    # at most ``most`` rows of a key, a fold and a label
    sample = usable.orderBy(F.xxhash64("_key"), "_key").limit(most)
    rows = docs.select(F.col(key).alias("_mine"), F.col(text).alias("text"))
    found = rows.join(F.broadcast(sample), F.col("_mine") == F.col("_key"))
    return found.select("fold", (F.col("toxic") > 0).cast("int").alias("toxic"), "text")


def presence(rows: DataFrame) -> DataFrame:
    """(entry, fold, toxic, n): documents that hold an entry; the entry '' counts them all."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for part, toxic, text in zip(batch["fold"], batch["toxic"], plain(batch["text"]), strict=True):
                found[("", part, toxic)] += 1
                for entry in entries_of(set(words_of(text))):
                    found[(entry, part, toxic)] += 1
            yield pd.DataFrame(
                [(*k, n) for k, n in found.items()], columns=["entry", "fold", "toxic", "n"]
            )

    each = rows.mapInPandas(counted, "entry string, fold int, toxic int, n long")
    return each.groupBy("entry", "fold", "toxic").agg(F.sum("n").alias("n"))


def corpus_shares(docs: DataFrame, text: str, names: Sequence[str]) -> tuple[np.ndarray, int]:
    """How many words of all documents fall to each entry, and the number of all words."""
    names = list(names)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup, total = Lookup(names), np.zeros(len(names) + 1, np.int64)
        words = 0
        for batch in batches:
            for value in plain(batch["_text"]):
                found = lookup(words_of(value))
                words += len(found)
                total += np.bincount(found + 1, minlength=len(total))
        total[0] = words
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    each = docs.select(F.col(text).alias("_text")).mapInPandas(counted, "at long, n long")
    shares = np.zeros(len(names) + 1, np.int64)
    # a row per entry: bounded by the words of the training sample
    for row in each.groupBy("at").agg(F.sum("n").alias("n")).collect():
        shares[row["at"]] = row["n"]
    return shares[1:], int(shares[0])


def log_odds(toxic, clean, n_toxic, n_clean, share, shrink: float = SHRINK):
    """Shrunk log-odds of entries held by ``toxic`` of ``n_toxic`` and ``clean`` of
    ``n_clean`` documents, ``share`` being their share of all words."""
    held = FLAT + WEIGHT * share
    lacked = FLAT + WEIGHT * (1 - share)
    value = np.log((toxic + held) / (n_toxic - toxic + lacked)) - np.log(
        (clean + held) / (n_clean - clean + lacked)
    )
    error = shrink * np.sqrt(1 / (toxic + held) + 1 / (clean + held))
    return np.sign(value) * np.maximum(0.0, np.abs(value) - error)


# --- the model ---------------------------------------------------------------------------


@dataclass
class Model:
    """Entries with their scores, and the calibration."""

    names: list[str]
    scores: np.ndarray
    drift: float
    rate: float  # lambda
    scale: float  # K
    slope: float
    offset: float

    def evidence(self, found: list[tuple[int, int, float]], n_words: int) -> float:
        return evidence([s for _, _, s in found], n_words, self.rate, self.scale)

    def score(self, value: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, self.offset + self.slope * value))))


def evidence(sums: Sequence[float], n_words: int, rate: float, scale: float) -> float:
    """Evidence of a text's segments beyond chance."""
    chance = math.log(scale * max(1, n_words))
    above = [rate * s - chance for s in sums]
    strong = [x for x in above if x >= -math.log(CHANCE)]
    return sum(strong) if strong else max(above, default=-chance)


def root(values: np.ndarray, counts: np.ndarray) -> float:
    """lambda > 0 with mean exp(lambda value) = 1; values above zero, a mean below."""
    share = counts / counts.sum()

    def excess(x: float) -> float:
        top = float(values.max()) * x
        return top + math.log(float((share * np.exp(values * x - top)).sum()))

    high = 1.0
    while excess(high) < 0:
        high *= 2
    low = 0.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def curve(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Slope (not below zero) and offset of a logistic curve, by Newton's method with a
    weak pull of the slope to zero."""
    slope, offset = 0.0, math.log((toxic.sum() + 0.5) / (clean.sum() + 0.5))
    n = toxic + clean
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(offset + slope * x, -40, 40)))
        weight = n * p * (1 - p) + 1e-9
        gradient = np.array([((toxic - n * p) * x).sum() - 0.01 * slope, (toxic - n * p).sum()])
        hessian = np.array(
            [[(weight * x * x).sum() + 0.01, (weight * x).sum()], [(weight * x).sum(), weight.sum()]]
        )
        step = np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        slope, offset = slope + step[0], offset + step[1]
        if np.abs(step).max() < 1e-9:
            break
    if slope < 0:
        return 0.0, math.log((toxic.sum() + 0.5) / (clean.sum() + 0.5))
    return float(slope), float(offset)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most: int = MAX_LABELLED,
) -> Model:
    """Learns from the labelled rows outside the held-out fold, with priors from all rows."""
    bound_batches()
    rows = settled(training_rows(docs, labels, key, text, label, most), "labelled")
    counts = settled(presence(rows), "presence")
    n_docs = np.zeros((2, FOLDS))
    for row in counts.where("entry = ''").collect():
        n_docs[row["toxic"], row["fold"]] = row["n"]
    n_toxic, n_clean = n_docs.sum(axis=1)[[1, 0]]
    constant = math.log((n_toxic + 0.5) / (n_clean + 0.5))
    if not n_toxic or not n_clean:
        return Model([], np.zeros(0), DRIFT, 1.0, 1.0, 0.0, constant)

    # entries seen twice or more whose log-odds can outlast the shrinking
    total = counts.where("entry <> ''").groupBy("entry").agg(
        F.sum(F.col("n") * F.col("toxic")).alias("y"), F.sum("n").alias("n")
    )
    apart = F.abs(
        F.log((F.col("y") + FLAT) / (n_toxic - F.col("y") + FLAT))
        - F.log((F.col("n") - F.col("y") + FLAT) / (n_clean - F.col("n") + F.col("y") + FLAT))
    )
    error = F.sqrt(1 / (F.col("y") + FLAT) + 1 / (F.col("n") - F.col("y") + FLAT))
    telling = total.where((F.col("n") > 1) & (apart > TELLING * error)).select("entry")
    cells = [(toxic, part) for toxic in (0, 1) for part in range(1, FOLDS)]
    one = [(F.col("toxic") == toxic) & (F.col("fold") == part) for toxic, part in cells]
    found = (
        counts.join(telling, "entry")
        .groupBy("entry")
        .agg(*[F.sum(F.when(cell, F.col("n")).otherwise(0)).cast("int").alias(f"n{i}") for i, cell in enumerate(one)])
        .orderBy("entry")
        .toArrow()
    )
    names = found.column("entry").to_pylist()
    held = np.zeros((2, FOLDS, len(names)))
    for i, (toxic, part) in enumerate(cells):
        held[toxic, part] = found.column(f"n{i}").to_numpy()
    del found
    words, n_words = corpus_shares(docs, text, names)
    share = words / max(1, n_words)

    def learned(without: int) -> np.ndarray:
        use = [f for f in range(FOLDS) if f != without]
        y, n = held[:, use].sum(axis=1), n_docs[:, use].sum(axis=1)
        return log_odds(y[1], y[0], n[1], n[0], share)

    # the held-out fold is 0 and empty here, so without it all training rows count
    by_fold = [learned(f) for f in range(FOLDS)]
    top = max((float(s.max()) for s in by_fold if len(s)), default=0.0)
    drift, rate = _chance(_histogram(rows.where("toxic = 0"), _word_scores(names, by_fold)), top)
    fitted = Model(names, by_fold[0], drift, rate, 1.0, 0.0, constant)
    best = _histogram(rows.where("toxic = 0"), _evidence(names, by_fold, fitted, best=True))
    if len(best):
        # the best segments of clean rows: K n exp(-lambda S) has the mean 1
        law = np.exp(-best["bin"].to_numpy() * WIDTH)
        fitted.scale = float(best["n"].sum() / (law * best["n"].to_numpy()).sum())
    bins = _histogram(rows, _evidence(names, by_fold, fitted))
    x = np.array(sorted(bins["bin"].unique()))
    n = np.zeros((2, len(x)))
    for toxic, place, many in bins.itertuples(index=False):
        n[toxic, np.searchsorted(x, place)] = many
    fitted.slope, fitted.offset = curve(x * WIDTH, n[1], n[0])
    kept = np.flatnonzero(fitted.scores)
    fitted.names, fitted.scores = [names[i] for i in kept], fitted.scores[kept]
    return fitted


HISTOGRAM = "toxic int, bin long, n long"


def _histogram(rows: DataFrame, values) -> pd.DataFrame:
    """(toxic, bin, n) of the values of training rows in bins of ``WIDTH``; ``values`` gives
    those of a row from its fold and text."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        value_of = values()
        bins: Counter = Counter()
        for batch in batches:
            for part, toxic, text in zip(batch["fold"], batch["toxic"], plain(batch["text"]), strict=True):
                places = np.rint(np.asarray(value_of(part, text)) / WIDTH).astype(np.int64)
                for place, n in zip(*np.unique(places, return_counts=True), strict=True):
                    bins[(toxic, int(place))] += int(n)
        yield pd.DataFrame([(*k, n) for k, n in bins.items()], columns=["toxic", "bin", "n"])

    each = rows.mapInPandas(counted, HISTOGRAM)
    return each.groupBy("toxic", "bin").agg(F.sum("n").alias("n")).toPandas()


def _word_scores(names: list[str], by_fold: list[np.ndarray]):
    """Scores of a row's words, by what the other folds have learned."""

    def start():
        lookup, scores = Lookup(names), [np.append(s, 0.0) for s in by_fold]
        return lambda part, text: scores[part][lookup(words_of(text))]

    return start


def _evidence(names: list[str], by_fold: list[np.ndarray], model: Model, best: bool = False):
    """Evidence of a row, or of its best segment alone (nothing if it has none)."""

    def start():
        lookup, scores = Lookup(names), [np.append(s, 0.0) - model.drift for s in by_fold]

        def value_of(part: int, text: str) -> list[float]:
            each = scores[part][lookup(words_of(text))]
            found = segments(each)
            if not best:
                return [model.evidence(found, len(each))]
            top = max((s for _, _, s in found), default=None)
            return [] if top is None else [model.rate * top - math.log(len(each) * model.scale)]

        return value_of

    return start


def _chance(bins: pd.DataFrame, top: float) -> tuple[float, float]:
    """Drift and lambda of clean text from the histogram of its words' scores, and one
    word of the highest score, which a small sample need not hold."""
    values, counts = bins["bin"].to_numpy() * WIDTH, bins["n"].to_numpy(np.float64)
    if not len(values):
        return DRIFT, 1.0
    drift = DRIFT + max(0.0, float((values * counts).sum() / counts.sum()))
    if top <= drift:  # nothing can score above zero
        return drift, 1.0
    return drift, root(np.append(values, top) - drift, np.append(counts, 1.0))


# --- results -----------------------------------------------------------------------------

FOUND = "n_words long, score double, passages array<struct<begin:int,end:int,sum:double>>"


def scored(df: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``df`` plus a struct: number of words, score, and the significant passages (words
    from begin to end, exclusive, and their sum)."""
    bound_batches()

    @F.pandas_udf(FOUND)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lookup = Lookup(model.names)
        scores = np.append(model.scores, 0.0) - model.drift
        for batch in batches:
            rows = []
            for value in plain(batch):
                each = scores[lookup(words_of(value))]
                found = segments(each)
                chance = math.log(model.scale * max(1, len(each))) - math.log(CHANCE)
                strong = [(b, e, s) for b, e, s in found if model.rate * s >= chance]
                rows.append((len(each), model.score(model.evidence(found, len(each))), strong))
            yield pd.DataFrame(rows, columns=["n_words", "score", "passages"])

    return df.withColumn(out, judged(F.col(text)))
