"""Streams: detection, redaction and synthesis are stateless, so they run unchanged.

The vault is the only thing that accumulates; each micro-batch adds the tokens the
stored vault lacks, keyed by batch so that a repeated batch overwrites its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.spans import Pattern
from ..operators.redact import redact_frame
from ..operators.vault import vault_of
from ..policy import Policy


def redact_stream(
    stream: DataFrame,
    policy: Policy,
    text: str = "text",
    key: str | None = None,
    dictionaries: Sequence[Pattern] = (),
) -> DataFrame:
    """A streaming frame with ``redacted_text``, ``usage`` and ``spans``."""
    return redact_frame(stream, policy, text, key, dictionaries)


def write_with_vault(
    redacted: DataFrame,
    out_path: str,
    vault_path: str,
    checkpoint: str,
    **trigger: object,
) -> StreamingQuery:
    """Write redacted rows and the vault.

    Every batch writes to a folder of its own id, so a batch that is run again after a
    failure replaces its rows instead of adding them twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        kept.drop("spans").write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        vault_of(kept).write.mode("overwrite").parquet(f"{vault_path}/batch={batch_id}")
        kept.unpersist()

    return (
        redacted.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def read_vault(spark, vault_path: str) -> DataFrame:
    """All batches of the vault, one row per token and text."""
    return (
        spark.read.parquet(vault_path)
        .groupBy("token", "label", "text")
        .agg(F.sum("n").alias("n"))
    )
