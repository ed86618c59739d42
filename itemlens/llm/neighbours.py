"""Rows next to each other in a global order, without a task that sees them all."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def in_order(df: DataFrame, key: Column, before: bool = False, ring: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """``df`` dealt out by ranges of ``key`` and sorted in each partition, with columns ``#key``, ``#bucket``, ``#ghost``.

    Partitions hold buckets one after another. A bucket's rows (ghost 0) are followed by the first row of the next
    bucket (ghost 1), so that every row stands right before its successor; with ``before`` the last row of the previous
    bucket (ghost -1) stands ahead. With ``ring`` the first row of all follows the last. Bounds are keys that occur,
    drawn from 20 keys a bucket in the order of a hash, so they and the buckets are the same in every run of a job; at
    100,000 buckets the driver sees two million keys. Keys are whole numbers or strings without nulls; rows of equal
    keys stay in one bucket, in no fixed order. ``keys`` may give the keys alone from a cheaper plan.
    """
    spark = df.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = df.withColumn("#key", key)
    number = isinstance(keyed.schema["#key"].dataType, LongType)
    keys = keyed.select("#key") if keys is None else keys.toDF("#key")
    drawn = [r[0] for r in keys.distinct().orderBy(F.xxhash64("#key"), "#key").limit(20 * count).collect()]
    ranked = sorted(drawn, key=(lambda x: x) if number else (lambda x: x.encode()))
    least = keys.agg(F.min("#key")).first()[0]
    bounds = sorted({least, *(ranked[len(ranked) * i // count] for i in range(1, count))} if ranked else set(),
                    key=(lambda x: x) if number else (lambda x: x.encode()))
    cuts = bounds if number else [x.encode() for x in bounds]

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, x if number else x.encode()) - 1 for x in k], dtype="int32")

    placed = keyed.withColumn("#at", bucket("#key"))
    firsts = spark.createDataFrame([(i, x) for i, x in enumerate(bounds)], f"`#at` int, first {'long' if number else 'string'}")
    ends = firsts.withColumn("last", F.lit(None).cast(firsts.schema["first"].dataType))
    if before and bounds:
        tails = keys.withColumn("#at", bucket("#key")).groupBy("#at").agg(F.max("#key").alias("last"))
        ends = firsts.join(tails, "#at", "left")
    # one row a bucket: the bound of this broadcast
    placed = placed.join(F.broadcast(ends), "#at")
    last = len(bounds) - 1
    seat = lambda at, ghost: F.struct(at.cast("int").alias("#bucket"), F.lit(ghost).alias("#ghost"))
    none = F.lit(None).cast("struct<`#bucket`:int,`#ghost`:int>")
    back = F.when(F.col("#at") > 0, F.col("#at") - 1)
    if ring:
        back = F.coalesce(back, F.lit(last))
    seats = [seat(F.col("#at"), 0), F.when((F.col("#key") == F.col("first")) & back.isNotNull(), seat(back, 1)).otherwise(none)]
    if before:
        seats.append(F.when((F.col("#key") == F.col("last")) & (F.col("#at") < last), seat(F.col("#at") + 1, -1)).otherwise(none))
    out = placed.select(*[f"`{c}`" for c in df.columns], "`#key`", F.inline(F.filter(F.array(*seats), lambda x: x.isNotNull())))
    # a bucket a partition: by a hash some would get several and some none
    return out.repartitionById(count, "#bucket").sortWithinPartitions("#bucket", "#ghost", "#key")
