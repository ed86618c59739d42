"""Concatenate and cut: documents as one stream of token ids, cut into windows of equal length."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemlens.llm.common import blocks, bounded, documents, kept, stored, strings


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, and the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoding(path: str, special: bool = False):
    """The byte-level vocabulary of a tokenizer file, ready to encode. The strings of its special tokens in a text are these
    tokens with ``special``, as they are for the ``tokenizers`` library by default, and ordinary text without."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    alphabet = byte_alphabet()
    added = {x["content"]: x["id"] for x in data.get("added_tokens", []) if x["special"]}
    ranks = {bytes(alphabet[c] for c in token): k for token, k in data["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added if special else {})


RUN = 100_000  # white space characters in a row that are left to the tokenizer file's own library


class Encoder:
    """Texts to ids. The faster library gives up on some hundred thousand white space characters in a row; texts with such runs go to the other."""

    def __init__(self, path: str, special: bool):
        self.path, self.special, self.fast, self.slow = path, special, encoding(path, special), None
        self.long_run = re.compile(r"\s{%d}" % RUN)

    def encode(self, text: str) -> list[int]:
        if len(text) < RUN or not self.long_run.search(text):
            return self.fast.encode(text, allowed_special="all")
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.no_truncation()
            self.slow.encode_special_tokens = not self.special
        return self.slow.encode(text, add_special_tokens=False).ids


def tokenized(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, special: bool = False) -> DataFrame:
    """(id, part, before, n, ids): the first pass. ``ids`` are little-endian unsigned 32-bit, ``before`` the ids of the
    same partition ahead of the row."""
    kind = docs.schema[id_col].dataType
    df = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = kept(f"packing {path} {special}", lambda: Encoder(path, special)), TaskContext.get().partitionId(), 0
        for batch in blocks(batches):
            ids = [np.array(encoder.encode(x) + [end_id], "<u4") for x in strings(batch.column(1))]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(n), part, np.int64)), pa.array(ends - n), pa.array(n),
                 pa.array([x.tobytes() for x in ids], pa.binary())], names=[id_col, "part", "before", "n", "ids"])
            before = int(ends[-1])

    return bounded(df).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, part long, before long, n long, ids binary")


def starts(totals: DataFrame) -> DataFrame:
    """(part, first): the global offset of each partition from (part, total), by prefix sums in two levels."""
    df = totals.withColumn("block", F.floor(F.col("part") / F.lit(1024)))
    over = df.groupBy("block").agg(F.sum("total").alias("t"))
    over = over.select("block", (F.sum("t").over(Window.orderBy("block")) - F.col("t")).alias("base"))
    inside = df.select("part", "block", (F.sum("total").over(
        Window.partitionBy("block").orderBy("part")) - F.col("total")).alias("inner"))
    return inside.join(over, "block").select("part", (F.col("base") + F.col("inner")).alias("first"))


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, special: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): every document's pieces in the stream.

    A document is its token ids and then ``end_id``. All documents stand one after another, in the order of partitions
    and of rows in them, and the stream is cut after every ``length`` ids: each id lies in exactly one piece, every
    sequence but the last is full, and only that one is padded. The first pass tokenizes and writes the ids with their
    offsets inside the partition; prefix sums over the partitions' totals (one row per input partition, the bound of
    the broadcast) make these global; the second pass cuts what was written, so a lost executor changes nothing.
    With ``special`` the string of a special token in a text is that token, as by the ``tokenizers`` library's defaults.
    A null or empty text is the end id alone. Repeated rows are packed each; null ids pass through; an empty table
    gives no pieces; other columns are left out.
    """
    ids = stored(tokenized(docs, path, end_id, id_col, text_col, special), "packing")
    firsts = starts(ids.groupBy("part").agg(F.sum("n").alias("total")))
    placed = ids.join(F.broadcast(firsts), "part").withColumn("at", F.col("first") + F.col("before"))
    size = F.lit(length).cast("long")

    def piece(s):
        start = F.greatest(s * size - F.col("at"), F.lit(0).cast("long"))
        stop = F.least((s + F.lit(1)) * size - F.col("at"), F.col("n"))
        own = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), ((stop - start) * 4).cast("int"))
        return F.struct(
            start.alias("start"), (stop - start).alias("length"), F.crc32(own).alias("ids_crc32"), F.col("n").alias("doc_tokens"),
            s.alias("sequence_id"), (F.col("at") + start - s * size).alias("offset"), *([own.alias("ids")] if with_ids else []))

    windows = F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))
    return placed.select(F.col(id_col), F.inline(F.transform(windows, piece)))


def op10_pack(spark: SparkSession, d: str) -> DataFrame:
    """All ``documents`` in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(documents(spark, d), public_tokenizers.path("byte_bpe_50k.json"), special=True)
