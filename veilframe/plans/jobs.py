"""End-to-end jobs: from a source to written, checked output."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import Pattern
from ..operators import vault as vaults
from ..operators.conversation import redact_rows
from ..operators.redact import redact_frame
from ..policy import Policy
from ..session import settle
from ..sources import texts


def redact_table(
    df: DataFrame,
    policy: Policy,
    out_path: str,
    vault_path: str | None = None,
    text: str = "text",
    key: str | None = None,
    dictionaries: Sequence[Pattern] = (),
) -> None:
    """Redact once, write the rows and then the vault read back from them."""
    redact_frame(df, policy, text, key, dictionaries).write.mode("errorifexists").parquet(
        out_path
    )
    if vault_path is not None:
        written = df.sparkSession.read.parquet(out_path)
        vaults.vault_of(written).write.mode("errorifexists").parquet(vault_path)


def redact_csv(
    spark: SparkSession,
    path: str,
    out_path: str,
    policy: Policy,
    has_header: bool,
    text: str,
    group: str | None = None,
    dictionaries: Sequence[Pattern] = (),
    **dialect: object,
) -> None:
    """Redact one column of a CSV file, rows of a group read as one document.

    The rows are staged with their reading order, so that both uses of the file (text
    and other columns) see the same numbers.
    """
    rows = settle(
        texts.with_row_order(texts.read_csv(spark, path, has_header, **dialect), "_row")
    )
    grouped = rows.select(
        (F.col(f"`{group}`") if group else F.lit("constant")).alias("_group"),
        "_row",
        F.col(f"`{text}`").alias("_text"),
    )
    done = redact_rows(grouped, policy, ["_group"], "_row", "_text", dictionaries=dictionaries)
    names = [c for c in rows.columns if c != "_row"]
    joined = rows.join(done.select("_row", "redacted_text"), "_row", "left")
    out = joined.select(
        "_row",
        *[
            (F.col("redacted_text") if c == text else F.col(f"`{c}`")).alias(c)
            for c in names
        ],
    )
    texts.write_csv(out, out_path, has_header, "_row")


def redact_files(
    spark: SparkSession,
    path: str,
    out_path: str,
    policy: Policy,
    dictionaries: Sequence[Pattern] = (),
) -> None:
    """Text files in, redacted text files out, each under its path below the folder.

    The result per file is the same as redacting its text directly.
    """
    files = texts.read_texts(spark, path, below=True)
    done = redact_frame(files, policy, "text", "file_name", dictionaries)
    texts.write_files(done, out_path, "file_name", "redacted_text")


def redact_with(
    df: DataFrame,
    policy: Policy,
    detector: Callable[[DataFrame], DataFrame],
    key: str,
    text: str = "text",
) -> DataFrame:
    """Redact with a user's detector: a function from (key, text) to (key, spans).

    A model in Python runs inside ``mapInPandas`` of that function; its spans are cut to
    the text and made disjoint like any other.
    """
    found = detector(df.select(key, text))
    joined = df.join(found.select(key, F.col("spans").alias("_extra")), key, "left")
    return redact_frame(joined, policy, text, key, extra="_extra").drop("_extra")


def python_detector(
    function: Callable, key_type: str, key: str, text: str = "text"
) -> Callable[[DataFrame], DataFrame]:
    """A detector from ``function(list of texts) -> list of span lists``.

    Texts go to Python in Arrow batches; spans are dicts with start, end, label, score.
    """
    schema = (
        f"{key} {key_type}, spans array<struct<start:int,end:int,label:string,"
        "text:string,score:double>>"
    )

    def run(df: DataFrame) -> DataFrame:
        def batches(frames):
            for frame in frames:
                found = function(frame[text].fillna("").tolist())
                frame["spans"] = [
                    [
                        {**s, "text": t[s["start"] : s["end"]]}
                        for s in spans
                    ]
                    for t, spans in zip(frame[text].fillna(""), found)
                ]
                yield frame[[key, "spans"]]

        return df.select(key, text).mapInPandas(batches, schema)

    return run


__all__ = [
    "python_detector",
    "redact_csv",
    "redact_files",
    "redact_table",
    "redact_with",
]
