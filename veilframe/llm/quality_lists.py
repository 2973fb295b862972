"""Quality rules: a decision list learned by sequential covering.

Every text gives countable features (words, symbols, repeated lines and words, ...).  From
labelled rows a list of conjunctions of thresholds is learned: a rule is grown by adding
the threshold with the best information gain, pruned back on rows it was not grown on, and
its rows are taken away before the next rule is grown.  The list becomes one ordered Spark
conditional expression that a person can read.

The rules are fitted on at most ``MAX_LABELLED`` labelled rows, those with the smallest
hash of their key; that is the only sample, and its bound is the parameter.  Features are
computed over whole texts of all rows.

Results for special rows: a null or empty text has no words and fails the base rule; a
label that is null or has no document is left out; without labels of both kinds the list
is empty and the base rule decides alone; equal rows are judged alike; columns called like
the result are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, plain, spread_free

MAX_LABELLED = 20_000
#: The base rule: fewer words, or a larger share (percent) of repeated words, fails.
MIN_WORDS = 50
MAX_REPEATED = 50
SYMBOLS = "#*$%&|<>"
#: A rule stays if so large a share of the pruning rows it covers are of its class.
MIN_PRECISION = 0.95
MAX_RULES = 16
MAX_TERMS = 4
#: Thresholds tried per feature.
CUTS = 64

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_chars_all", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct"]
#: Learned features: name, and the counts whose quotient it is.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeated_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "mean_word": ("word_chars", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "letter_share": ("n_letters", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}

_SYMBOL_BYTES = {ord(c) for c in SYMBOLS}
_NOT_SYMBOL = bytes(b for b in range(256) if b not in _SYMBOL_BYTES)
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_MARKS = set(b".,;:!?")
_NOT_MARK = bytes(b for b in range(256) if b not in _MARKS)
_UPPER = re.compile(r"[^\W\d_]")


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more; ``ids`` number the words."""
    if len(ids) < 4:
        return 0
    n = int(ids.max()) + 1
    # numbers of pairs first, so that no product overflows
    pairs = np.unique(ids[:-1].astype(np.int64) * n + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1].astype(np.int64) * n + ids[2:]
    _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
    many = count[which] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(many) + shift] |= many
    return int(covered.sum())


def features_of(text: str) -> tuple[int, ...]:
    """COUNTS + EXTRA of one whole text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes.split cuts at \x20 and \x09-\x0D alone
    number: dict[bytes, int] = {}
    ids = np.fromiter(
        (number.setdefault(w, len(number)) for w in words), np.int64, len(words)
    )
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    upper = letters = 0
    if text.isascii():
        swapped = text.lower()
        letters = sum(map(swapped.count, "abcdefghijklmnopqrstuvwxyz"))
        upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    else:
        for c, n in Counter(text).items():
            if c.isalpha():
                letters += n
                upper += n * c.isupper()
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    return (
        len(words),
        len(text) - spaces,
        len(raw.translate(None, _NOT_SYMBOL)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(text),
        len(lines),
        upper,
        letters,
        len(raw.translate(None, _NOT_DIGIT)),
        len(raw.translate(None, _NOT_MARK)),
        len(number),
    )


def features(text: Column | str) -> Column:
    """Struct of all counts of a text."""
    names = COUNTS + EXTRA

    bound_batches()

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [features_of(t) for t in plain(batch)]
            yield pd.DataFrame(rows, columns=names, dtype="int64")

    return counted(text)


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def column(self, counts: Column) -> Column:
        value = ratio(counts, self.feature)
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Term, ...]


def ratio(counts: Column, name: str) -> Column:
    above, below = RATIOS[name]
    return F.when(counts[below] > 0, counts[above] / counts[below]).otherwise(F.lit(0.0))


def ratios(table: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {
        name: np.where(table[b] > 0, table[a] / np.maximum(table[b], 1), 0.0)
        for name, (a, b) in RATIOS.items()
    }


def _covers(rule: Sequence[Term], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    held = np.ones(n, bool)
    for term in rule:
        held &= term.holds(x)
    return held


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Term]:
    """Adds the term with the largest information gain until only ``bad`` rows are left."""
    held = np.ones(len(bad), bool)
    rule: list[Term] = []
    while len(rule) < MAX_TERMS and held.any() and not bad[held].all():
        p, n = bad[held].sum(), held.sum()
        if p == 0:
            break
        base, best = np.log2(p / n), (1e-9, None)
        for name, values in x.items():
            # between neighbouring values, so that a cut is not one row's own value
            some = np.unique(np.quantile(values[held], np.linspace(0, 1, CUTS)))
            for cut in ((some[:-1] + some[1:]) / 2).tolist():
                over = values > cut
                for above in (True, False):
                    sub = held & (over if above else ~over)
                    sp, sn = bad[sub].sum(), sub.sum()
                    if sp and sn < n:
                        gain = sp * (np.log2(sp / sn) - base)
                        if gain > best[0]:
                            best = (gain, Term(name, above, cut))
        if best[1] is None:
            break
        rule.append(best[1])
        held &= best[1].holds(x)
    return rule


def _prune(rule: list[Term], x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[list[Term], float, int]:
    """The shortest front part of the rule that is worth most on unseen rows."""
    best: tuple[float, list[Term], float, int] = (-2.0, rule, 0.0, 0)
    for length in range(1, len(rule) + 1):
        held = _covers(rule[:length], x, len(bad))
        p, n = int(bad[held].sum()), int(held.sum())
        worth = (2 * p - n) / n if n else -1.0
        if worth > best[0] + 1e-12:
            best = (worth, rule[:length], p / n if n else 0.0, p)
    return best[1], best[2], best[3]


def learn(
    table: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray
) -> list[Rule]:
    """Ordered conjunctions that say ``bad``; rows of ``fold`` true prune, the rest grow."""
    x, rules = ratios(table), []
    # rows that the base rule judges never reach the list
    words = table["n_words"]
    left = (words >= MIN_WORDS) & (100 * table["n_repeat_words"] <= MAX_REPEATED * words)
    for _ in range(2 * MAX_RULES):
        if len(rules) == MAX_RULES:
            break
        grow, prune = left & ~fold, left & fold
        if not bad[grow].any() or not bad[prune].any():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        if not rule:
            break
        short, precision, covered = _prune(rule, {k: v[prune] for k, v in x.items()}, bad[prune])
        if precision < MIN_PRECISION or covered < 2:
            # not to be trusted: its growing rows are put aside, and the next one is tried
            left &= ~(_covers(rule, x, len(bad)) & ~fold)
            continue
        rules.append(tuple(short))
        left &= ~_covers(short, x, len(bad))
    return rules


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < MIN_WORDS) | (
        F.lit(100) * counts["n_repeat_words"] > F.lit(MAX_REPEATED) * counts["n_words"]
    )


def verdict(rules: Sequence[Rule], counts: Column) -> Column:
    """Whether a row is kept: the base rule, then the learned rules in their order."""
    found = F.when(base_failed(counts), F.lit(False))
    for rule in rules:
        held = F.lit(True)
        for term in rule:
            held = held & term.column(counts)
        found = found.when(held, F.lit(False))
    return found.otherwise(F.lit(True))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    most: int = MAX_LABELLED,
) -> list[Rule]:
    """The decision list for documents whose ``label`` is 0, from at most ``most`` rows."""
    some = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_key", "_label"))
        .limit(most)
    )
    rows = (
        docs.select(key, text)
        .join(F.broadcast(some), F.col(key) == F.col("_key"))
        .select("_label", F.xxhash64("_key").alias("_hash"), features(text).alias("_f"))
        .select("_label", "_hash", "_f.*")
        .toPandas()
    )
    rows = rows.sort_values(list(rows.columns), kind="stable")
    table = {n: rows[n].to_numpy(np.float64) for n in COUNTS + EXTRA}
    fold = rows["_hash"].to_numpy(np.int64) % 3 == 0
    return learn(table, rows["_label"].to_numpy() == 0, fold)


def judged(
    docs: DataFrame, rules: Sequence[Rule], text: str = "text"
) -> DataFrame:
    """``docs`` plus the counts, base_failed and kept."""
    counts = spread_free("_counts", docs.columns)
    whole = F.coalesce(F.col(text), F.lit(""))
    # the function runs once: its result is a column of its own before it is taken apart
    found = docs.withColumn(counts, features(whole))
    for name in COUNTS:
        found = found.withColumn(name, F.col(counts)[name])
    return (
        found.withColumn("base_failed", base_failed(F.col(counts)))
        .withColumn("kept", verdict(rules, F.col(counts)))
        .drop(counts)
    )
