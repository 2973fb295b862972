"""Datasets as tables: datasets, files (manifest), processing states, fetch.

The manifest is a table ``(dataset, file_id, file_name, content_hash, n_columns, status,
error, policy_hash)``; every operation takes the stored table and returns the new rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..session import salted_join, small

READY = "Completed"


class NameExists(ValueError):
    """A dataset of this name exists."""


class FileExists(ValueError):
    """A file with the same content exists."""


def with_content_hash(files: DataFrame, text: str = "text") -> DataFrame:
    return files.withColumn("content_hash", F.sha2(F.col(text), 256))


def first_copies(files: DataFrame, name: str = "file_name") -> DataFrame:
    """One file per (dataset, content): the smallest name.

    Copies shrink to one row per task before the shuffle, so content that a third of all
    files share is no hot key; texts are not shuffled at all.
    """
    keep = files.groupBy("dataset", "content_hash").agg(F.min(name).alias(name))
    return keep


def added_files(
    new: DataFrame, manifest: DataFrame, name: str = "file_name"
) -> DataFrame:
    """Files of ``new`` whose content the dataset does not hold yet, first copies only."""
    return first_copies(new, name).join(
        manifest.select("dataset", "content_hash"), ["dataset", "content_hash"], "left_anti"
    )


def rejected_files(
    new: DataFrame, manifest: DataFrame, name: str = "file_name"
) -> DataFrame:
    """Files of ``new`` that repeat content of the dataset or of the batch."""
    kept = added_files(new, manifest, name)
    return new.select("dataset", "content_hash", name).join(
        kept, ["dataset", "content_hash", name], "left_anti"
    )


def check_add(path: str | None, content: bytes | str | None) -> None:
    """Exactly one of path and content is given."""
    if (path is None) == (content is None):
        raise ValueError("Must specify exactly one of file_path and file")


def deleted_files(manifest: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Manifest without the given files."""
    return manifest.join(file_ids, "file_id", "left_anti")


def unknown_files(manifest: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Ids to delete that the manifest does not hold."""
    return file_ids.join(manifest.select("file_id"), "file_id", "left_anti")


def by_status(manifest: DataFrame, *statuses: str) -> DataFrame:
    """Files in any of the states, in one scan."""
    unknown = set(statuses) - set(model.FILE_STATES)
    if unknown or not statuses:
        raise ValueError(f"unknown status {', '.join(sorted(unknown)) or '(none)'}")
    return manifest.where(F.col("status").isin(list(statuses)))


def open_files(manifest: DataFrame) -> DataFrame:
    """(dataset, kind, file_id, file_name): one row per file that waits or has failed, the
    part of a dataset's summary that names files."""
    kind = F.when(F.col("status") == "Failed", "failed").otherwise("waiting")
    found = by_status(manifest, "Queued", "Running", "Failed")
    return found.select("dataset", kind.alias("kind"), "file_id", "file_name")


def scorable(files: DataFrame, status: str = "status") -> DataFrame:
    """Annotated files that can be scored."""
    return files.where(F.col(status).isin(model.SCORABLE_STATES))


def reviewed(gold: DataFrame, annotations: DataFrame, file: str = "file_name") -> DataFrame:
    """Annotations saved for a file replace its old ones and mark it reviewed."""
    kept = gold.join(annotations.select(file).distinct(), file, "left_anti")
    saved = annotations.withColumn("status", F.lit("Reviewed"))
    return kept.unionByName(saved.select(*kept.columns))


def visible(datasets: DataFrame, operations: str = "operations") -> DataFrame:
    """Datasets whose settings the caller may see."""
    return datasets.where(F.array_contains(operations, "ViewSettings"))


def model_based(entities: DataFrame, kind: str = "entity_type") -> DataFrame:
    return entities.where(F.col(kind) == "ModelBased")


def duplicate_names(datasets: DataFrame, name: str = "name") -> DataFrame:
    """Names used more than once."""
    return datasets.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def created(datasets: DataFrame, name: str, **fields: object) -> DataFrame:
    """Datasets plus a new one; a name in use is refused."""
    if not datasets.where(F.col("name") == name).isEmpty():
        raise NameExists(name)
    row = {"name": name, **fields}
    columns = [
        F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in datasets.schema
    ]
    spark = datasets.sparkSession
    return datasets.unionByName(spark.range(1).select(*columns))


def renamed(datasets: DataFrame, old: str, new: str) -> DataFrame:
    if old != new and not datasets.where(F.col("name") == new).isEmpty():
        raise NameExists(new)
    return datasets.withColumn(
        "name", F.when(F.col("name") == old, F.lit(new)).otherwise(F.col("name"))
    )


def dropped(datasets: DataFrame, name: str) -> DataFrame:
    return datasets.where(F.col("name") != name)


def summary(manifest: DataFrame) -> DataFrame:
    """(dataset, status, n_files); with ``num_columns`` for the widest file.

    Files that wait or failed are rows of their own (``open_files``), not a cell.
    """
    return manifest.groupBy("dataset", "status").agg(
        F.count(F.lit(1)).alias("n_files"), F.max("n_columns").alias("num_columns")
    )


def num_columns(manifest: DataFrame) -> DataFrame:
    """Widest file per dataset; null where there is none."""
    return manifest.groupBy("dataset").agg(F.max("n_columns").alias("num_columns"))


def _of_files(cells: DataFrame, files: DataFrame) -> DataFrame:
    """Cells of the given files; one file may hold a large share of all cells."""
    ids = files.select("file_id").distinct()
    if small(ids, "file_id"):
        return cells.join(F.broadcast(ids), "file_id", "left_semi")
    return salted_join(cells, ids, "file_id", "row_idx")


def fetch_all(
    cells: DataFrame, manifest: DataFrame, width: int | None = None
) -> DataFrame:
    """All rows of the ready files as one table ``col0 .. colN-1``.

    ``cells`` is (file_id, row_idx, values ARRAY<STRING>); a raw file is one row of one
    value.  Files that are not ready are skipped; without files the frame is empty.  When
    all files are raw texts the single column is called ``text``.
    """
    ready = by_status(manifest, READY)
    if width is None:
        width = ready.agg(F.max("n_columns")).first()[0] or 0
    rows = _of_files(cells, ready)
    if width == 0:
        return rows.select("file_id", "row_idx", F.get("values", F.lit(0)).alias("text"))
    columns = [F.get("values", F.lit(i)).alias(f"col{i}") for i in range(width)]
    return rows.select("file_id", "row_idx", *columns)


def as_json(cells: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file_id, row_idx, json): every row as a JSON array."""
    rows = _of_files(cells, by_status(manifest, READY))
    return rows.select(
        "file_id", "row_idx", F.to_json("values").alias("json")
    )


def policy_hash(policy_json: str) -> str:
    """Fingerprint of a policy, stable under key order."""
    import hashlib

    text = json.dumps(json.loads(policy_json), sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def to_rescan(manifest: DataFrame, current_hash: str) -> DataFrame:
    """Files whose results were made under another policy."""
    return manifest.where(~F.col("policy_hash").eqNullSafe(F.lit(current_hash)))


def quarantined(results: DataFrame, error: str = "error") -> DataFrame:
    """Status per file from a run: rows with an error are failed, the rest complete."""
    return results.withColumn(
        "status", F.when(F.col(error).isNotNull(), "Failed").otherwise(READY)
    )
