"""What the training-data operators share: table access, shared scratch tables, word classes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule, as a regular-expression class body and as bytes.
WORD_SPACE = r"\x20\x09-\x0D"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Text bytes handled at once inside a task; bounds memory, never the amount of text.
SLICE_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one is set where none is named, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends, reruns agree."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def words(text: Column) -> Column:
    """Maximal runs of characters outside WORD_SPACE; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WORD_SPACE}]+"), lambda w: w != "")


def text_slices(texts: list, limit: int = SLICE_BYTES):
    """Group consecutive texts (bytes) so that a group holds about limit bytes: yields (start, stop)."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def utf8(column) -> list:
    """An Arrow string column as bytes; null becomes empty."""
    import pyarrow as pa

    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def to_array(blobs: list) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate bytes to one uint8 array with the offsets of each."""
    sizes = np.fromiter((len(b) for b in blobs), np.int64, len(blobs))
    return np.frombuffer(b"".join(blobs), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
