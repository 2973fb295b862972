"""Token ids as flat files with 64-bit document offsets.

A data set is a folder of parts.  Part ``x`` is three flat little-endian files: ``x.ids``
(unsigned 16-bit ids, or 32-bit if the vocabulary is larger), ``x.offsets`` (unsigned
64-bit, the first id of each document within the part, and the end), ``x.docs`` (signed
64-bit document ids, the smallest value for null).  ``manifest.json`` has a line per part
with its number of documents and ids and its ``base``: the ids of all parts before it, a
prefix sum.  Documents lie in ascending order of their id, so a reader maps one file and
finds any document without reading others.

A task writes under a name of its own and hands it to the manifest, so a task that runs
twice, or an executor that is lost, leaves at most files that no manifest names.  The
folder must be one that driver and executors share.

Results for special rows: a null text counts as empty (the end id alone); documents of
null id come first; rows of equal id are ordered by text; an empty table gives a manifest
without parts; other columns are not written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import word_encoder
from .common import bound_batches, settled, slices

NULL_ID = np.iinfo(np.int64).min
MANIFEST = "part int, name string, n_docs long, n_tokens long, width int"
DOCUMENT = "doc_id long, start long, n_tokens long, ids binary"
#: Documents that a reader hands on at once, in ids.
READ_IDS = 1_000_000
#: Parts are at least so many for every split of the input.
PARTS_PER_SPLIT = 1


def _open(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def _writer(path: str, end_id: int, folder: str):
    """Function for ``mapInArrow``: writes a part, yields its line of the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder.encoder(path)
        width = 2 if encoder.library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        tail = np.array([end_id], "<u4").tobytes()
        files, root = _open(folder)
        name = uuid.uuid4().hex
        lengths: list[int] = []
        docs: list[np.ndarray] = []
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = files.open_output_stream(f"{root}/{name}.ids")
            ids = batch.column(0).cast(pa.int64()).fill_null(NULL_ID)
            docs.append(ids.to_numpy(zero_copy_only=False))
            for texts in slices(batch.column(1)):
                raw = [r + tail for r in encoder.encode(texts)]
                lengths += [len(r) >> 2 for r in raw]
                flat = np.frombuffer(b"".join(raw), "<u4")
                out.write(flat.astype(f"<u{width}").tobytes())
        if out is None:
            return
        out.close()
        offsets = np.r_[0, np.cumsum(lengths)].astype("<u8")
        for kind, data in (("offsets", offsets), ("docs", np.concatenate(docs).astype("<i8"))):
            with files.open_output_stream(f"{root}/{name}.{kind}") as side:
                side.write(data.tobytes())
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                "name": [name],
                "n_docs": [len(lengths)],
                "n_tokens": [int(offsets[-1])],
                "width": pa.array([width], pa.int32()),
            }
        )

    return write


def write(
    df: DataFrame, path: str, folder: str, end_id: int, key: str = "doc_id", text: str = "text"
) -> None:
    """Writes the ids of all texts, ``end_id`` behind each, in ascending order of ``key``."""
    bound_batches()
    files, root = _open(folder)
    files.create_dir(root, recursive=True)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    parts = max(1, PARTS_PER_SPLIT * rows.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(parts, "key").sortWithinPartitions("key", "text")
    lines = settled(ordered.mapInArrow(_writer(path, end_id, folder), MANIFEST), "parts")
    base, manifest = 0, []
    for line in lines.orderBy("part").collect():  # one line for each part
        manifest.append(line.asDict() | {"base": base})
        base += line["n_tokens"]
    with files.open_output_stream(f"{root}/manifest.json") as out:
        out.write("".join(json.dumps(x) + "\n" for x in manifest).encode())


def _mapped(files, root: str, name: str, kind: str) -> np.ndarray:
    """A flat file as an array, mapped into memory where the file system can."""
    path = f"{root}/{name}"
    if files.type_name == "local":
        size = files.get_file_info(path).size
        return np.memmap(path, kind, "r") if size else np.zeros(0, kind)
    with files.open_input_file(path) as file:
        return np.frombuffer(file.read(), kind)


def _reader(folder: str):
    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        for batch in parts:
            for line in batch.to_pylist():
                ids = _mapped(files, root, f"{line['name']}.ids", f"<u{line['width']}")
                offsets = _mapped(files, root, f"{line['name']}.offsets", "<u8").astype(np.int64)
                docs = _mapped(files, root, f"{line['name']}.docs", "<i8")
                begin = 0
                while begin < len(docs):
                    stop = int(np.searchsorted(offsets, offsets[begin] + READ_IDS))
                    stop = min(max(stop, begin + 1), len(docs))
                    some = offsets[begin : stop + 1]
                    raw = ids[some[0] : some[-1]].astype("<u4").tobytes()
                    at = ((some - some[0]) * 4).tolist()
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(
                                docs[begin:stop], pa.int64(), mask=docs[begin:stop] == NULL_ID
                            ),
                            "start": pa.array(some[:-1] + line["base"], pa.int64()),
                            "n_tokens": pa.array(np.diff(some), pa.int64()),
                            "ids": pa.array(
                                [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)],
                                pa.binary(),
                            ),
                        }
                    )
                    begin = stop

    return read


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before
    it), n_tokens, ids (little-endian unsigned 32-bit)."""
    lines = spark.read.schema(MANIFEST + ", base long").json(f"{folder}/manifest.json")
    parts = max(1, lines.count())
    cores = spark.sparkContext.defaultParallelism
    return lines.repartition(min(parts, max(cores * 4, ceil(parts / 8)))).mapInArrow(
        _reader(folder), DOCUMENT
    )
