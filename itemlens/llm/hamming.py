"""Exact nearest binary codes: multi-index hashing with radii that grow until the k-th distance is covered."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemlens.session import checkpointed, table

SEGMENTS, BITS = 4, 16  # a code of 64 bits in four indexed segments


def sign_code(vector: Column) -> Column:
    """64 bits: bit i is 1 where the vector's component i is above zero; missing components are 0. Null for null."""
    bit = lambda i: F.when(F.get(vector, F.lit(i)) > 0, F.lit((1 << i) - (1 << 64 if i == 63 else 0))).otherwise(F.lit(0)).cast("long")
    code = bit(0)
    for i in range(1, 64):
        code = code.bitwiseOR(bit(i))
    return F.when(vector.isNotNull(), code)


def masks(radius: int) -> np.ndarray:
    every = np.arange(1 << BITS, dtype=np.uint32)
    return every[np.bitwise_count(every) == radius].astype(np.uint64)


def search(codes: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance): the ``k`` nearest of ``codes`` to each query; of equal distances the first rows.

    Segment s of a row that differs from the query in d bits is within radius r for one s at least if d < 4 (r + 1).
    Radii grow segment by segment: once all segments are probed at radius r - 1 and the first s + 1 of them at r, each row within
    4 r + s is verified, and a query is done when its k-th distance is no more. Where a radius has more probes than there are rows, the
    remaining queries are verified against all rows instead, which covers any distance.
    """
    n, none = len(codes), np.iinfo(np.int64).max
    best = np.full((len(queries), k), none)
    index = []
    for s in range(SEGMENTS):
        part = (codes >> np.uint64(BITS * s)) & np.uint64(0xFFFF)
        index.append((np.argsort(part, kind="stable"), np.append(0, np.cumsum(np.bincount(part.astype(np.int64), minlength=1 << BITS)))))

    def take(query: np.ndarray, row: np.ndarray, probe: tuple[int, int] | None):
        x = codes[row] ^ queries[query]
        key = np.bitwise_count(x).astype(np.int64) * n + row
        good = key < best[query, -1]
        query, key, x = query[good], key[good], x[good]
        if probe and len(query):  # a row counts where it is found first
            r, at = probe
            d = np.stack([np.bitwise_count((x >> np.uint64(BITS * s)) & np.uint64(0xFFFF)) for s in range(SEGMENTS)])
            new = (d >= r + (np.arange(SEGMENTS) < at)[:, None]).all(0)
            query, key = query[new], key[new]
        if not len(query):
            return
        touched = np.unique(query)
        query = np.concatenate([query, np.repeat(touched, k)])
        key = np.concatenate([key, best[touched].ravel()])
        order = np.lexsort((key, query))
        query, key = query[order], key[order]
        first = np.searchsorted(query, touched)
        best[touched] = key[first[:, None] + np.arange(k)]

    active = np.arange(len(queries))
    for r in range(BITS + 1):
        flips = masks(r)
        for s in range(SEGMENTS):
            covered = SEGMENTS * r + s - 1
            active = active[best[active, -1] > covered * n + n - 1]
            if not len(active):
                break
            if len(flips) >= n:
                step = max(1, (1 << 21) // max(n, 1))
                best[active] = none
                for at in range(0, len(active), step):
                    some = active[at:at + step]
                    take(np.repeat(some, n), np.tile(np.arange(n), len(some)), None)
                active = active[:0]
                break
            rows, starts = index[s]
            step = max(1, (1 << 20) // len(flips))
            for at in range(0, len(active), step):
                some = active[at:at + step]
                value = (((queries[some] >> np.uint64(BITS * s)) & np.uint64(0xFFFF))[:, None] ^ flips[None, :]).astype(np.int64).ravel()
                size = starts[value + 1] - starts[value]
                hit = np.flatnonzero(size)
                size = size[hit]
                ends = np.cumsum(size)
                place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[value[hit]] - (ends - size), size)
                take(np.repeat(some[hit // len(flips)], size), rows[place], (r, s))
        if not len(active):
            break
    query, at = np.nonzero(best != none)
    return query, best[query, at] % max(n, 1), best[query, at] // max(n, 1)


def nearest_codes(rows: DataFrame, queries: DataFrame, k: int, row_block: int = 1 << 20, query_block: int = 512) -> DataFrame:
    """(query_id, rank int, neighbour_id, distance int): the ``k`` rows nearest to each query, other rows than itself.

    Both tables have (id long, code long). Ties in distance go to the smaller id. Of rows with one code only the ``k`` + 1
    of least id can be among the nearest, so the index holds no more of them, and queries of one code are searched once.
    Rows and query codes are dealt into blocks of bounded size; each pair of blocks is one search, and only k + 1 rows a
    query code leave it. Null codes and ids are in no result; with fewer rows than k a query gets fewer; repeated rows
    count as one row; an empty side gives no rows.
    """
    few = Window.partitionBy("code").orderBy("id")
    rows = checkpointed(rows.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct().withColumn(
        "place", F.row_number().over(few)).where(F.col("place") <= k + 1).select("id", "code"))
    queries = queries.where("id IS NOT NULL AND code IS NOT NULL").select(F.col("id").alias("query_id"), "code").distinct()
    codes = checkpointed(queries.select("code").distinct())
    n_rows, n_codes = max(1, math.ceil(rows.count() / row_block)), max(1, math.ceil(codes.count() / query_block))
    spread = lambda n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "code", spread(n_rows).alias("r"), every(n_codes).alias("q"))
    right = codes.select("code", spread(n_codes).alias("q"), every(n_rows).alias("r"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("id")
        query, row, distance = search(a["code"].to_numpy(np.int64).view(np.uint64), b["code"].to_numpy(np.int64).view(np.uint64), k + 1)
        return pd.DataFrame({"code": b["code"].to_numpy()[query], "id": a["id"].to_numpy()[row], "distance": distance.astype(np.int32)})

    found = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInPandas(run, "code long, id long, distance int")
    near = found.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("distance", "id"))).where(
        F.col("place") <= k + 1).drop("place")
    each = queries.join(near, "code").where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias("neighbour_id"), "distance")


def op8_nearest_codes(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest sign codes of every row of ``embeddings`` whose id is divisible by 20, among all rows."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return nearest_codes(rows, rows.where(F.col("id") % 20 == 0), 10).withColumnRenamed("query_id", "vec_id")


SQL_NEAREST = """
WITH d AS (
  SELECT q.vec_id, r.vec_id AS neighbour_id,
         len(list_filter(list_zip(q.embedding, r.embedding), lambda x: (x[1] > 0) <> (x[2] > 0)))::INTEGER AS distance
  FROM embeddings q JOIN embeddings r ON r.vec_id <> q.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id))::INTEGER AS rank, neighbour_id, distance FROM d
)
SELECT vec_id, rank, neighbour_id, distance FROM ranked WHERE rank <= 10
"""
