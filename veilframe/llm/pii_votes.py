"""Personal data by weak supervision, in DataFrame functions.

Four kinds have fixed patterns (the base): e-mail addresses, IP addresses, card numbers and
phone numbers.  Their matches are always kept.  In the gaps between them every word with a
digit or an equals sign is a candidate, and so is any word behind one that announces a
secret; words end at white space, quotes, commas, braces, ``&`` and ``;``.  Labelers of three sorts vote on each candidate, for, against
or not at all: regular expressions over the word, gazetteers of words and prefixes, and
the context in front of it.  Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is, without any label, and gives every pattern a
probability; a logistic classifier over features of the span is fitted to these, and it
decides, so that a candidate that no labeler knows can still be found by its looks.

The statistics cover all candidates.  Only counts of patterns reach the driver: at most
3**labelers vote patterns times the product of the feature sizes, whatever the corpus.

Results for special rows: a null text counts as empty and has no spans; equal texts have
equal spans; without candidates, or without votes for, only base spans are found; an empty
table gives an empty table; columns called like the result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.arrays import (
    empty,
    fold_emit,
    indices,
    let,
    running_starts,
)
from veilframe.functions.spans import cut, mark_safe, splice
from veilframe.functions.sql import Sql, col, fn, lit, struct, when

from .common import spread_free

KINDS = ["email", "ip", "card", "phone"]
ADDED = ["number", "secret"]
#: The contract's patterns, written so that matching takes linear time and no recursion:
#: possessive where nothing can be given back, and tried only where a run begins or the
#: last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
SPACE = r"\x20\x09-\x0D"
#: White space and signs that end a candidate.
BREAK = rf"{SPACE}\"'`,{{}}&;"
#: Stands for the characters of base spans while candidates are cut.
FILLER = "\ufdd0"
CONTEXT = 24
SPAN = "struct<kind:string,start:int,end:int>"
CANDIDATE = "struct<kind:string,start:int,end:int,votes:array<int>,looks:array<int>>"

#: Gazetteers: words that announce personal data or a secret, words that announce a number
#: of another sort, prefixes of issued keys.
ANNOUNCE = (
    "password passwd pwd token secret key api_key apikey phone tel mobile call fax account "
    "iban ssn passport card login pin"
).split()
HARMLESS = (
    "version v license licence by by-nc by-sa chapter section page table figure part no "
    "volume step copyright"
).split()
KEY_PREFIXES = "AKIA ASIA ghp_ gho_ sk- pk_ xox AIza eyJ".split()
_ANNOUNCED = "(?i:" + "|".join(ANNOUNCE) + ")"
_SIGN = f"[^{BREAK}{FILLER}]"
#: Signs alone are no word: they stand between a word and what it announces.
WORD = (
    rf"(?<!{_SIGN})(?!=++(?!{_SIGN}))(?:[^{BREAK}{FILLER}0-9=]*+[0-9=]{_SIGN}*+"
    rf"|(?<=(?<![A-Za-z0-9_]){_ANNOUNCED}[{BREAK}:=]{{1,4}})[^{BREAK}{FILLER}:=]{_SIGN}*+)"
)


def digits(value: Sql) -> Sql:
    return fn.regexp_replace(value, lit("[^0-9]"), lit(""))


def accepted(kind: str, value: Sql) -> Sql:
    if kind == "ip":
        # at most three digits without leading zeros, so the cast is safe
        return fn.forall(
            fn.split(value, lit("[.]")),
            lambda p: let(
                fn.ltrim(lit("0"), p),
                lambda bare: (fn.length(bare) <= 3)
                & (fn.concat(lit("0"), fn.right(bare, 3)).cast("int") <= 255),
            ),
        )
    if kind == "card":
        return let(
            digits(value), lambda d: fn.length(d).between(13, 19) & fn.luhn_check(fn.left(d, 19))
        )
    if kind == "phone":
        return fn.length(digits(value)).between(9, 15)
    return lit(True)


def base_spans(text: Sql, kind: str) -> Sql:
    """Accepted matches of a kind in ``text`` (which must be ``mark_safe``), in order."""

    def locate(pieces: Sql) -> Sql:
        return let(
            running_starts(fn.transform(pieces, lambda p: fn.length(p))),
            lambda starts: fn.transform(
                fn.filter(
                    indices(fn.size(pieces) - 1, step=2, first=1),
                    lambda i: accepted(kind, pieces[i]),
                ),
                lambda i: struct(
                    kind=kind, start=starts[i], end=starts[i] + fn.length(pieces[i])
                ),
            ),
        )

    held = text.rlike("[0-9]") if kind != "email" else lit(True)
    if NEEDS[kind]:
        held = fn.contains(text, lit(NEEDS[kind])) & held
    return when(held, let(cut(text, PATTERNS[kind]), locate)).otherwise(empty(SPAN))


# --- labelers and features --------------------------------------------------------------


def _votes(value: Sql, before: Sql) -> list[Sql]:
    """For (1), against (-1) or silent (0), per labeler."""
    bare = fn.rtrim(lit(".,;:!?)"), value)
    size = fn.length(digits(value))
    last = fn.lower(fn.regexp_extract(before, lit(rf"([^{SPACE}]*)[{SPACE}]*$"), lit(1)))
    named = fn.lower(fn.regexp_extract(before, lit(rf"([^{BREAK}:=]*)[{BREAK}:=]*$"), lit(1)))
    word = fn.ltrim(lit("?("), fn.rtrim(lit(".)"), named))

    def vote(up: Sql, down: Sql | None = None) -> Sql:
        voted = when(up, 1)
        return (voted.when(down, -1) if down is not None else voted).otherwise(0)

    return [
        # regular expressions
        vote(
            bare.rlike(r"^(?i:password|passwd|pwd|token|secret|key|api_?key)[=:].{6,}"),
            bare.rlike(r"^[0-9]{1,4}$"),
        ),
        vote(bare.rlike(r"^[A-Z]{4}[A-Z0-9]{12,}$"), bare.rlike(r"^[a-z]*[0-9]{1,3}$")),
        vote(
            bare.rlike(r"^[+(]?[0-9][0-9().-]+$") & (size >= 7),
            bare.rlike(r"^v?[0-9]{1,3}(?:[.][0-9]{1,3}){0,2}$"),
        ),
        vote(bare.rlike(r"[0-9][A-Za-z]+[0-9]+[A-Za-z]+[0-9]"), fn.length(bare) <= 4),
        # gazetteers
        vote(
            bare.rlike("^(?:" + "|".join(KEY_PREFIXES) + ")"),
            fn.lower(bare).rlike("^(?:" + "|".join(HARMLESS) + ")[-.]?[0-9.]{1,6}$"),
        ),
        vote(word.isin(ANNOUNCE), word.isin(HARMLESS)),
        # context: digits, a bracket or a plus right in front
        vote(last.rlike(r"^[+(]?[0-9()-]+$") & (size >= 4), last.rlike(r"^[a-z]+,$") & (size <= 2)),
    ]


#: Values per feature.
SIZES = [5, 5, 4, 2, 2, 2, 2, 2]


def _looks(value: Sql, before: Sql) -> list[Sql]:
    bare = fn.rtrim(lit(".,;:!?)"), value)
    size = fn.length(bare)
    n = fn.length(digits(bare))

    def bucket(x: Sql, *edges: int) -> Sql:
        found = when(x < edges[0], 0)
        for i, edge in enumerate(edges[1:], 1):
            found = found.when(x < edge, i)
        return found.otherwise(len(edges))

    def flag(x: Sql) -> Sql:
        return when(x, 1).otherwise(0)

    return [
        bucket(size, 4, 7, 12, 16),
        bucket(n, 2, 4, 7, 13),
        bucket(fn.length(fn.regexp_replace(bare, lit("[^A-Za-z]"), lit(""))), 1, 4, 10),
        flag(fn.contains(bare, lit("="))),
        flag(bare.rlike("[A-Z]") & ~bare.rlike("[a-z]")),
        flag(bare.rlike("[0-9][A-Za-z]")),
        flag(bare.rlike("[-()+]")),
        flag(before.rlike(rf"[0-9)][{SPACE}]*$")),
    ]


def candidates(text: Sql, base: Sql) -> Sql:
    """Words with a digit or ``=`` and announced words in the gaps between base spans, with
    votes and looks."""

    def locate(pieces: Sql) -> Sql:
        def at(starts: Sql) -> Sql:
            def one(i: Sql) -> Sql:
                value, before = pieces[i], fn.right(pieces[i - 1], CONTEXT)
                # a candidate right behind another has its last word in front of it
                front = when(
                    (i > 1) & ~before.rlike(rf"[^{BREAK}]"),
                    fn.concat(fn.right(pieces[i - 2], CONTEXT), before),
                ).otherwise(before)
                bare = fn.length(fn.rtrim(lit(".,;:!?"), value))
                return struct(
                    kind=when(value.rlike("[A-Za-z=]|^[^0-9]*$"), "secret").otherwise("number"),
                    start=starts[i],
                    end=starts[i] + bare,
                    votes=fn.array(*_votes(value, front)),
                    looks=fn.array(*_looks(value, front)),
                )

            def is_candidate(i: Sql) -> Sql:
                # the name of a value that is a base span or quoted, such as "?user="
                names = pieces[i].rlike("^[^0-9=]*=$") & pieces[i + 1].rlike(rf"^[\"'{FILLER}]")
                return (fn.length(fn.rtrim(lit(".,;:!?"), pieces[i])) >= 1) & (
                    fn.length(pieces[i]) >= 2
                ) & ~names

            return fn.transform(
                fn.filter(indices(fn.size(pieces) - 1, step=2, first=1), is_candidate), one
            )

        return let(running_starts(fn.transform(pieces, lambda p: fn.length(p))), at)

    def gaps(m: Sql) -> Sql:
        return splice(
            text, m, fn.transform(m, lambda s: fn.repeat(lit(FILLER), s["end"] - s["start"]))
        )

    held = text.rlike(f"[0-9=]|{_ANNOUNCED}")
    cuts = when(fn.size(base) == 0, text).otherwise(let(merged(base), gaps))
    return when(held, let(cut(cuts, WORD), locate)).otherwise(empty(CANDIDATE))


def found(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` plus ``out``: struct(base, candidates) of every whole text."""

    def both(safe: Sql) -> Sql:
        base = fn.concat(*[base_spans(safe, kind) for kind in KINDS])
        return let(base, lambda b: struct(base=b, candidates=candidates(safe, b)))

    return df.withColumn(out, let(mark_safe(fn.coalesce(col(text), lit(""))), both).column())


# --- the model --------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Reliabilities by labeler, and weights per value of each feature."""

    prior: float
    reliability: tuple[tuple[tuple[float, float, float], ...], ...]
    bias: float
    weights: tuple[tuple[float, ...], ...]


NO_MODEL = Model(0.0, (), -1.0, tuple(tuple([0.0] * n) for n in SIZES))


def expectation_maximisation(
    votes: np.ndarray, counts: np.ndarray, rounds: int = 100
) -> tuple[np.ndarray, float, np.ndarray]:
    """Probability of each vote pattern, prior, and P(vote | class) per labeler.

    ``votes`` is patterns x labelers of -1, 0, 1; ``counts`` how often each occurs.
    """
    total = votes.sum(axis=1)
    q = np.where(total > 0, 0.9, np.where(total < 0, 0.1, 0.3))
    prior, table = 0.5, np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - q), counts * q])
        prior = float((weight[1].sum() + 1) / (counts.sum() + 2))
        for v in range(3):
            table[:, :, v] = weight @ (votes == v - 1) + 1.0
        # a labeler that speaks for is never taken to speak against
        table /= table.sum(axis=2, keepdims=True)
        table[1, :, 2] = np.maximum(table[1, :, 2], table[0, :, 2])
        table[0, :, 0] = np.maximum(table[0, :, 0], table[1, :, 0])
        logs = np.log(table)
        score = np.log(prior) - np.log1p(-prior) + sum(
            logs[1, j, votes[:, j] + 1] - logs[0, j, votes[:, j] + 1]
            for j in range(votes.shape[1])
        )
        new = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return q, prior, table


def logistic(looks: np.ndarray, target: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights (bias first) of one-hot features, by Newton steps with a small penalty."""
    x = np.concatenate(
        [np.ones((len(looks), 1))]
        + [np.eye(n)[looks[:, j]] for j, n in enumerate(SIZES)],
        axis=1,
    )
    share = counts / counts.sum()
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (share * (target - p)) - 1e-4 * w
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(spans: DataFrame, column: str) -> Model:
    """The model from all candidates of a table with the column of ``found``."""
    rows = (
        spans.select(F.explode(f"{column}.candidates").alias("c"))
        .groupBy("c.votes", "c.looks")
        .count()
        .collect()
    )
    if not rows:
        return NO_MODEL
    rows.sort(key=lambda r: (r["votes"], r["looks"]))
    votes = np.array([r["votes"] for r in rows])
    looks = np.array([r["looks"] for r in rows])
    counts = np.array([r["count"] for r in rows], np.float64)
    if not (votes > 0).any():
        return NO_MODEL
    patterns, which = np.unique(votes, axis=0, return_inverse=True)
    which = which.ravel()
    q, prior, table = expectation_maximisation(patterns, np.bincount(which, counts))
    w = logistic(looks, q[which], counts)
    at, weights = 1, []
    for n in SIZES:
        weights.append(tuple(float(x) for x in w[at : at + n]))
        at += n
    reliability = tuple(tuple(tuple(map(float, v)) for v in side) for side in table)
    return Model(prior, reliability, float(w[0]), tuple(weights))


def of_kind(spans: Sql, kind: str) -> Sql:
    return fn.filter(spans, lambda s: s["kind"] == kind)


def all_spans(column: Sql, model: Model) -> Sql:
    """Base spans and the candidates that the classifier takes, by kind, then start."""

    def score(c: Sql) -> Sql:
        total = lit(model.bias)
        for j, weights in enumerate(model.weights):
            total = total + fn.array(*[float(x) for x in weights])[c["looks"][j]]
        return total

    taken = fn.filter(column["candidates"], lambda c: score(c) > 0.0)

    def plain(c: Sql) -> Sql:
        return struct(kind=c["kind"], start=c["start"], end=c["end"])

    return let(
        fn.transform(taken, plain),
        lambda t: fn.concat(
            column["base"],
            *[of_kind(t, kind) for kind in ADDED],
        ),
    )


def joined(spans: Sql) -> Sql:
    return fn.array_join(
        fn.transform(
            spans,
            lambda s: fn.concat(
                s["kind"], lit(":"), s["start"].cast("string"), lit(":"), s["end"].cast("string")
            ),
        ),
        lit(","),
    )


def annotate(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` plus ``spans``: array of (kind, start, end), code points, end exclusive."""
    own = spread_free("_found", df.columns)
    return (
        found(df, text, own).withColumn("spans", all_spans(col(own), model).column()).drop(own)
    )


def merged(spans: Sql) -> Sql:
    """Spans in order of start, those that overlap as one under the kind of the first."""
    ordered = fn.array_sort(
        fn.transform(spans, lambda s: struct(start=s["start"], end=s["end"], kind=s["kind"]))
    )
    span = "struct<start:int,end:int,kind:string>"
    # the last span is put out by one that starts behind everything
    behind = fn.array(struct(start=2**31 - 1, end=2**31 - 1, kind=""))

    def step(held: Sql, s: Sql) -> Sql:
        return when(
            s["start"] < held["end"],
            struct(
                state=struct(
                    start=held["start"], end=fn.greatest(held["end"], s["end"]), kind=held["kind"]
                ),
                emit=empty(span),
            ),
        ).otherwise(
            struct(
                state=struct(start=s["start"], end=s["end"], kind=s["kind"]),
                emit=when(held["end"] > held["start"], fn.array(held)).otherwise(empty(span)),
            )
        )

    return fold_emit(fn.concat(ordered, behind), struct(start=0, end=0, kind=""), step, span)


def redact_found(df: DataFrame, model: Model, column: str, text: str = "text") -> DataFrame:
    """``df`` with the spans of ``column``, which ``found`` has made, in ``text`` replaced by
    their kinds in brackets; all other characters and columns stay, a null text stays null."""
    clean = let(
        merged(all_spans(col(column), model)),
        lambda m: splice(
            col(text),
            m,
            fn.transform(m, lambda s: fn.concat(lit("["), fn.upper(s["kind"]), lit("]"))),
        ),
    )
    return df.withColumn(text, clean.column())


def redact(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with every span in ``text`` replaced, without a column beside."""
    own = spread_free("_found", df.columns)
    return redact_found(found(df, text, own), model, own, text).select(*df.columns)
