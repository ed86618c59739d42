"""Reading the input tables and cutting lineage."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str, *cols: str) -> DataFrame:
    """Columns of a table; how its files are split is left to spark.sql.files.maxPartitionBytes."""
    df = table(spark, folder, name)
    return df.select(*cols) if cols else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by a hash of ``keys``: for texts that a heavy expression reads, whose files may be few or have rows of
    very different lengths. Moving a text costs little beside such an expression, and equal texts are spread like others by more keys."""
    return df.repartition(*keys)


PART_BYTES = 8 << 20  # of text in a part: what a task counts then does not grow with the table


def dealt_by_size(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """``dealt`` into as many parts as there are ``PART_BYTES`` of the column ``text``, but no fewer than keep all cores busy."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)), *keys)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that shuffles both sides, whatever Spark takes their sizes for.

    For sides that grow with the input and that Spark sizes far too low: what stands after an explode counts as a row for each
    row before it, and a stored table counts as its compressed files. Either could be sent whole to the driver and to every executor.
    """
    return df.hint("merge")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to: the one the session names, if any.

    Only a local session without one gets a temporary folder; a cluster needs a
    shared folder, as a lost executor must not take a checkpoint with it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="itemlens-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back, lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed table below the checkpoint folder and read it back, lineage cut."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
