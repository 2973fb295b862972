"""Readers and writers: texts, CSV, parsed documents, annotations, transcripts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model
from ..operators.ordered import numbered
from . import files

_CORRUPT = "_corrupt_record"


def read_texts(
    spark: SparkSession, path: str, whole: bool = True, below: bool = False
) -> DataFrame:
    """(file_name, text): one row per file, or per line.

    ``below`` reads the folders under ``path`` too; a file's name is then its path from
    there, so that files of one base name in two folders stay apart.  Spark's readers do not
    see empty files.
    """
    if not below:
        df = spark.read.text(path, wholetext=whole)
        name = F.element_at(F.split("_metadata.file_path", "/"), -1)
        return df.select(name.alias("file_name"), F.col("value").alias("text"))
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=whole)
    return df.select(path_below("_metadata.file_path", path).alias("file_name"), F.col("value").alias("text"))


def path_below(file_path: str, root: str) -> Column:
    """A file's path from ``root``, as its name was before it became a URI."""
    folder = re.sub(r"^[a-z][a-z0-9+.-]*:/*(?=/)", "", root.rstrip("/")) + "/"
    plain = F.url_decode(F.replace(F.col(file_path), F.lit("+"), F.lit("%2B")))
    return F.substring_index(plain, folder, -1)


def from_strings(spark: SparkSession, texts: Sequence[str | None]) -> DataFrame:
    """(idx, text) from a driver-side list, for interactive use."""
    return spark.createDataFrame(list(enumerate(texts)), "idx long, text string")


def csv_options(
    escape: str = '"',
    quote: str = '"',
    delimiter: str = ",",
    null_marker: str | None = "\\N",
    multi_line: bool = True,
) -> dict[str, object]:
    """Dialect of a CSV file; the null marker stands for null.

    Fields may hold line breaks unless ``multi_line`` is off, which lets Spark read one
    large file in splits.
    """
    options: dict[str, object] = {
        "escape": escape,
        "quote": quote,
        "sep": delimiter,
        "multiLine": multi_line,
    }
    if null_marker is not None:
        options["nullValue"] = null_marker
    return options


def read_csv(
    spark: SparkSession,
    path: str,
    has_header: bool,
    columns: Sequence[str] | int | None = None,
    strict: bool = True,
    **dialect: object,
) -> DataFrame:
    """CSV as strings with ``row_file``; without a header columns are "0", "1", ...

    ``columns`` (names, or a count) saves the pass that looks at the first line.  In
    strict mode a row of another width fails the job; otherwise
    such rows are kept aside in the column ``_corrupt_record``.
    """
    options = csv_options(**dialect)  # type: ignore[arg-type]
    if columns is None:
        columns = (
            spark.read.options(**options)
            .option("header", has_header)
            .option("inferSchema", False)
            .csv(path)
            .columns
        )
    if isinstance(columns, int):
        columns = [str(i) for i in range(columns)]
    names = list(columns) if has_header else [str(i) for i in range(len(columns))]
    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in names]
        + [T.StructField(_CORRUPT, T.StringType())]
    )
    df = (
        spark.read.options(**options)
        .option("header", has_header)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .schema(schema)
        .csv(path)
    )
    if not strict:
        return df
    # the check is a filter, so it runs whatever columns the query selects; naming a data
    # column (an empty slice of it) keeps Spark from reading the corrupt column alone
    message = "A CSV row is wider or narrower than the first one."
    invalid = F.raise_error(
        F.concat(F.lit(message), F.coalesce(F.substring(f"`{names[0]}`", 1, 0), F.lit("")))
    )
    valid = F.when(F.col(f"`{_CORRUPT}`").isNull(), F.lit(True)).otherwise(
        invalid.cast("boolean")
    )
    return df.where(valid).select(*[F.col(f"`{n}`") for n in names])


def with_row_order(df: DataFrame, out: str = "row_id") -> DataFrame:
    """Adds the position of each row in reading order (unique, increasing, with gaps).

    Files are read in splits whose order is the order of the data, so the id sorts rows
    as they were read without collecting or shuffling them.
    """
    return df.withColumn(out, F.monotonically_increasing_id())


def write_csv(
    df: DataFrame, path: str, has_header: bool = True, order: str | None = None
) -> None:
    """Every field quoted; rows in ``order`` across the part files when given."""
    out = df if order is None else df.orderBy(order).drop(order)
    out.write.mode("errorifexists").option("quoteAll", True).option(
        "header", has_header
    ).option("escape", '"').option("emptyValue", "").csv(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold annotations: JSON lines, blank lines skipped, names defaulted and suffixed.

    The default name counts the rows of all files, in the order of their paths and lines.
    """
    return _counted_rows(spark.read.schema(model.GOLD_SCHEMA).json(path), "test_file_")


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Training texts, one file per row."""
    return read_texts(spark, path).withColumnRenamed("file_name", "fileName")


def read_training_rows(spark: SparkSession, path: str) -> DataFrame:
    """Training texts as JSON lines (text, and fileName where one is given): (fileName, text),
    missing names counted like those of gold annotations."""
    rows = spark.read.schema("fileName string, text string").json(path)
    return _counted_rows(rows, "training_file_")


def _counted_rows(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows of files with default names by their place: Spark reads large files first, so the
    place is that of the file's path, the split and the row in it."""
    placed = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = ["_file", "_block", "_row"]
    return named_files(numbered(placed, "_order", order), prefix, "_order").drop("_order", *order)


def named_files(df: DataFrame, prefix: str, order: str | None = None) -> DataFrame:
    """Fill missing file names with ``{prefix}{i}.txt`` and enforce the suffix; i is the row's
    consecutive number, or ``order``."""
    rows = df if order is not None else numbered(df, "_order")
    index = F.col(order or "_order")
    name = F.coalesce(F.col("fileName"), F.concat(F.lit(prefix), index.cast("string")))
    suffixed = F.when(name.endswith(".txt"), name).otherwise(F.concat(name, F.lit(".txt")))
    out = rows.withColumn("fileName", suffixed)
    return out if order is not None else out.drop("_order")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript JSON files, one per row, with their file name."""
    return (
        spark.read.schema(model.TRANSCRIPT_SCHEMA)
        .option("multiLine", True)
        .json(path)
        .withColumn("file_name", F.element_at(F.split("_metadata.file_path", "/"), -1))
    )


def write_files(df: DataFrame, path: str, file: str = "file_name", text: str = "text") -> None:
    """One file per row, under its name below ``path``."""
    files.write(df, path, file, text)


def base_name(key: str) -> Column:
    """Last part of an object-store key."""
    return F.element_at(F.split(key, "/"), -1)
