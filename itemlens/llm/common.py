"""What several operators share: blocks of texts inside a task, and tables in the shared folder."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlens.session import ensure_checkpoint_dir, table

BLANKS = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str, *cols: str) -> DataFrame:
    return table(spark, folder, "documents").select(*(cols or ("doc_id", "text")))


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded to 4 MB unless the user has set another bound than Spark's 64 MB.

    Texts may be long, and several batches, in Java and in Python, are in memory for each core.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES) == "67108864b":
        conf.set(BATCH_BYTES, "4m")
    return df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table below the shared checkpoint folder and read it back, lineage cut.

    Like a checkpoint it survives lost executors; unlike one it is columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> DataFrame:
    """``df``, a small result, in few partitions: it is made at full width, and bundled by its size when it is there."""
    return df.hint("rebalance")


def blocks(batches: Iterable[pa.RecordBatch], size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in blocks of about ``size`` bytes of their second column (a text or binary).

    Keeps what a task holds at a time independent of how many rows a batch has. A row is never cut.
    """
    for batch in batches:
        column = batch.column(1)
        offsets = pa.compute.cast(pa.compute.fill_null(pa.compute.binary_length(column), 0), pa.int64()).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < len(offsets):
            before = int(offsets[at - 1]) if at else 0
            end = max(at + 1, int(offsets.searchsorted(before + size, "right")))
            yield batch.slice(at, end - at)
            at = end


SCREEN = 24  # bits of a number in a screen


def number(*cols) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << SCREEN))


def screen(numbers: DataFrame) -> np.ndarray:
    """Which of 2^SCREEN ``number`` values the only column has, as words of 63 bits: a fixed size, so it may be collected
    and sent to all tasks. It lets through every value it was made of, and others by chance."""
    at = F.col(numbers.columns[0])
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 63).cast("int"))
    out = np.zeros((1 << SCREEN) // 63 + 1, np.int64)
    found = numbers.groupBy(F.floor(at / 63).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def passes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (words[at // 63] >> (at % 63)) & 1 == 1


KEPT = 3


def kept(key: str, make):
    """What ``make`` gives, made once in a Python worker and kept there for its next tasks; of other things the oldest goes, so that a
    worker that has served many stages holds no more than one does."""
    held = sys.__dict__.setdefault("_itemlens_kept", {})
    held[key] = held.pop(key) if key in held else make()
    while len(held) > KEPT:
        del held[next(iter(held))]
    return held[key]


def strings(column: pa.Array) -> list[str]:
    """The texts of a column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def lists(values: pa.Array, lengths) -> pa.ListArray:
    """One list per length out of consecutive values."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
