"""Byte-level BPE: texts to token ids and back."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlens.llm.common import blocks, bounded, documents, kept, lists, strings
from itemlens.llm.pretokens import Encoder


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: of all neighbours the pair of least rank merges, the leftmost of equals first."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that begins at each place; 0 once it is gone
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two has merged meanwhile
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i and (r := ranks.get(piece[before[i]:stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids array<int>, offsets array<int>): token ids of each whole text.

    ``offsets`` has the byte at which each token begins in the text's UTF-8. A null or empty text has no tokens
    (empty lists). Rows are independent: repeated ids or rows give a row each, other columns are left out, an empty
    table gives an empty one. Single-byte tokens must all be in the rank file (they are in byte-level vocabularies).
    """
    kind = docs.schema[id_col].dataType
    df = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(ranks_path)
        sizes = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        encoder = kept(f"bpe {ranks_path}", lambda: Encoder(lambda piece: merged(piece.encode(), ranks)))
        for batch in blocks(batches):
            ids, counts = encoder.block(strings(batch.column(1)))
            ends = np.cumsum(sizes[ids], dtype=np.int64)
            begins = ends - sizes[ids]
            firsts = np.cumsum(counts) - counts
            base = begins[np.minimum(firsts, max(len(ids) - 1, 0))] if len(ids) else np.zeros(len(counts), np.int64)
            offsets = (begins - np.repeat(base, counts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), lists(pa.array(ids), counts), lists(pa.array(offsets), counts)],
                names=[id_col, "n_tokens", "ids", "offsets"])

    return bounded(df).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_tokens long, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, ranks_path: str, keep: list[str]) -> DataFrame:
    """(columns of ``keep``, decoded binary): the bytes that each row's ``ids`` stand for.

    Tokens are written to the places ``offsets`` names. Null or empty ids decode to no bytes.
    """
    df = encoded.select("ids", "offsets", *keep)
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(ranks_path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        first = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        for batch in batches:
            at = 0
            while at < len(batch):  # some rows at a time
                rows = batch.slice(at, 256)
                at += 256
                ids, places = rows.column(0), rows.column(1)
                out = []
                for i in range(len(rows)):
                    one = ids[i].values
                    if one is None or not len(one):
                        out.append(b"")
                        continue
                    one = one.to_numpy(zero_copy_only=False)
                    place = places[i].values.to_numpy(zero_copy_only=False)
                    n = sizes[one]
                    target = np.empty(int(place[-1] + n[-1]), np.uint8)
                    shift = np.repeat(first[one] - place, n)
                    target[:] = flat[np.arange(len(target)) + shift]
                    out.append(target.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[2:], pa.array(out, pa.binary())], names=[*keep, "decoded"])

    return bounded(df).mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, d: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again; digests of both."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode(documents(spark, d), path).withColumn("ids_sha256", F.sha2(
        F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256))
    return decode(encoded, path, ["doc_id", "n_tokens", "ids_sha256"]).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
