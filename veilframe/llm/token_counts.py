"""Token counts: batch encoding in Arrow functions that return lengths only.

Only the text goes to Python and only the count comes back; all other columns stay in the
JVM.  Batches are cut by bytes, not by rows, so that one batch of long texts is no larger
than one of short ones, and a text longer than a batch is split where no token can cross
(before white space that follows a non-space) and its counts are added up.

Results for special rows: a null text counts as empty (0 bytes, 0 tokens); equal rows are
counted one by one; an empty table gives an empty table; columns called like the result
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import word_encoder
from .common import BATCH_BYTES, bound_batches, by_bytes, plain

#: Tokens beyond which a text counts as over the limit.
LIMIT = 512


def pieces_at_safe_boundaries(text: str, most: int) -> list[str]:
    """``text`` in pieces of about ``most`` characters, cut only where a token must end."""
    pieces, begin = [], 0
    while len(text) - begin > most:
        at = begin + most
        found = next(
            (
                i
                for i in range(at, len(text))
                if text[i] in " \n" and text[i - 1] not in word_encoder.SPACES
            ),
            len(text),
        )
        pieces.append(text[begin:found])
        begin = found
    if begin < len(text) or not pieces:
        pieces.append(text[begin:])
    return pieces


def _json_counts(path: str, texts: list[str], most: int) -> list[int]:
    encoder = word_encoder.encoder(path)
    counts = [0] * len(texts)
    owners, parts = [], []
    for i, text in enumerate(texts):
        cut = pieces_at_safe_boundaries(text, most) if encoder.by_word else [text]
        owners += [i] * len(cut)
        parts += cut
    for begin, end in by_bytes(parts, most):
        for owner, n in zip(owners[begin:end], encoder.counts(parts[begin:end]), strict=True):
            counts[owner] += n
    return counts


_PIECES: dict = {}


def _model_counts(path: str, texts: list[str], most: int) -> list[int]:
    import sentencepiece

    if path not in _PIECES:
        _PIECES[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    counts: list[int] = []
    for begin, end in by_bytes(texts, most):
        counts += map(len, _PIECES[path].encode(texts[begin:end], num_threads=1))
    return counts


def n_tokens(text: Column | str, path: str, batch_bytes: int = BATCH_BYTES) -> Column:
    """Number of tokens of a text: ``.json`` by tokenizers, ``.model`` by sentencepiece,
    without begin, end or added special tokens, never truncated or padded."""
    count = _model_counts if path.endswith(".model") else _json_counts

    bound_batches()

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(count(path, plain(batch), batch_bytes), dtype="int64")

    return counted(text)


def count_tokens(
    df: DataFrame, path: str, text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """``df`` plus n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return (
        df.withColumn("n_tokens", n_tokens(whole, path))
        .withColumn("n_bytes", F.octet_length(whole).cast("long"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
