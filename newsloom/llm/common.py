"""Table reading, batch limits and files of the training-data operators."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.steps import cut_lineage as stored
from newsloom.steps import new_dir

__all__ = ["fold", "new_dir", "read_file", "slices", "stored", "table", "text_of", "write_file"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, column: int, max_bytes: int, max_rows: int = 1 << 16):
    """Arrow batches cut into parts of at most so many bytes of the given column and so many rows, one row at least.

    The column holds texts, binaries, or lists, of which an element counts as eight bytes.

    Spark itself bounds the batches it hands over by bytes (64 MB unless set otherwise); this bounds what is worked on at
    a time, without a setting of the session.
    """
    for batch in batches:
        held = batch.column(column)
        sizes = pc.multiply(pc.list_value_length(held), 8) if pa.types.is_list(held.type) or pa.types.is_large_list(held.type) else pc.binary_length(held)
        ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, min(at + max_rows, int(np.searchsorted(ends, before + max_bytes, "right"))))
            # A copy: some Arrow functions read a slice that begins within a batch from the batch's own beginning.
            yield batch if to - at == batch.num_rows else batch.take(pa.array(range(at, to), pa.int64()))
            at = to
        del batch, held, sizes, ends  # else they stay while the next batch is read


def filesystem(uri: str):
    """A pyarrow file system and the path in it, for tasks that write files which are no tables."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    target, path = filesystem(uri)
    target.create_dir(os.path.dirname(path), recursive=True)
    with target.open_output_stream(path) as out:
        out.write(data)


def read_file(uri: str) -> bytes:
    source, path = filesystem(uri)
    with source.open_input_stream(path) as f:
        return f.read()


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id's text, modulo folds; 0 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds
