"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi".split()


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(words))


LONG = prose(1, 30_000)
BASE = prose(2, 120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
ROWS = [
    (1, BASE),
    (2, BASE),
    (3, NEAR),
    (4, None),
    (5, ""),
    (6, "  \n\t "),
    (7, LONG),
    (8, prose(3, 80) + "\n\n" + prose(4, 80)),
    (9, "one two"),
    (9, "one two"),
    (10, "é漢字🙏 <|endoftext|> x▁y  z\r\n"),
    (None, prose(5, 60)),
    (None, BASE),
    (11, "!" * 3000),
    (12, "a" * 5000),
    (13, "spam " * 400),
]
SCHEMA = "doc_id long, text string"
#: Columns called like things that operators make.
CLASHING = "kept string, n_tokens string, ids string, spans string, shard string, _counts string"


def docs(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)


def clashing(spark):
    rows = [(*r, "k", "n", "i", "s", "h", "c") for r in ROWS]
    return spark.createDataFrame(rows, f"{SCHEMA}, {CLASHING}")


def text_of(row) -> str:
    return row[1] or ""
