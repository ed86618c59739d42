"""Jump consistent hashing: rows to shards without a ring table. Column functions and SQL only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemlens.llm.common import documents

# fixed values: the multiplier of the hash's 64-bit linear congruential generator, in halves
HIGH, LOW = 0x27BB2EE6, 0x87B0B0FD
MASK16, MASK32 = 0xFFFF, 0xFFFFFFFF


def _times_low(x: Column) -> tuple[Column, Column]:
    """Products of the lower and the upper 16 bits of ``x`` with the multiplier's lower half, each below 2^48."""
    return x.bitwiseAND(F.lit(MASK16)) * F.lit(LOW), F.shiftright(x, 16) * F.lit(LOW)


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """key * multiplier + 1 modulo 2^64 in 32-bit halves, no step of which overflows a long."""
    a, b = _times_low(low)
    c, d = _times_low(high)
    s = a + F.lit(1) + F.shiftleft(b.bitwiseAND(F.lit(MASK16)), 16)
    low_out = s.bitwiseAND(F.lit(MASK32))
    high_out = (F.shiftright(s, 32) + F.shiftright(b, 16) + (low * F.lit(HIGH)).bitwiseAND(F.lit(MASK32))
                + c.bitwiseAND(F.lit(MASK32)) + F.shiftleft(d.bitwiseAND(F.lit(MASK16)), 16)).bitwiseAND(F.lit(MASK32))
    return high_out, low_out


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard int, grown int): the key's shard of ``shards``, and of one more.

    The jumps of a key do not depend on the number of shards, which only says where they end: the shard is the last
    landing below it. So both are read off one chain of at most ``shards`` jumps. A null key counts as 0.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("h"), key.bitwiseAND(F.lit(MASK32)).alias("l"),
        long(0).alias("at"), long(0).alias("shard"), long(0).alias("grown"))

    def jump(acc: Column, _: Column) -> Column:
        high, low = _next(acc["h"], acc["l"])
        moved = F.struct(high.alias("h"), low.alias("l"), acc["at"].alias("at"), acc["shard"].alias("shard"),
                         acc["grown"].alias("grown"))
        return F.when(acc["at"] > F.lit(shards), acc).otherwise(_land(moved))

    def _land(acc: Column) -> Column:
        at = F.floor((acc["at"] + F.lit(1)).cast("double")
                     * (F.lit(float(1 << 31)) / (F.shiftright(acc["h"], 1) + F.lit(1)).cast("double"))).cast("long")
        return F.transform(F.array(F.struct(acc.alias("a"), at.alias("at"))), lambda x: F.struct(
            x["a"]["h"].alias("h"), x["a"]["l"].alias("l"), x["at"].alias("at"),
            F.when(x["at"] < F.lit(shards), x["at"]).otherwise(x["a"]["shard"]).alias("shard"),
            F.when(x["at"] <= F.lit(shards), x["at"]).otherwise(x["a"]["grown"]).alias("grown")))[0]

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, jump, lambda acc: F.struct(
        acc["shard"].cast("int").alias("shard"), acc["grown"].cast("int").alias("grown")))


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", parts: int = 251) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): every row's shard by its id, and its place there.

    Law "key": id and number of shards decide; with one more shard a row stays or goes to the new one. Size is the
    text's UTF-8 bytes (null: none) plus 8; the CRC-32 of a null text is that of no bytes. Slots are gapless from 0 in
    each shard, in the order of (id modulo ``parts``, id, CRC, size), so no task ever orders a whole shard: parts are
    counted first, and their prefix sums (``shards`` x ``parts`` rows, the bound of the broadcast) give each part's
    first slot. Texts are read once and not shuffled. Null ids count as key 0 and stand in their own part; repeated
    rows get slots of their own, in any order among equals; an empty table gives an empty one; other columns are left out.
    """
    bytes_ = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    df = docs.select(
        F.col(id_col), (F.octet_length(bytes_).cast("long") + F.lit(8)).alias("size"), F.crc32(bytes_).alias("text_crc32"))
    df = df.select("*", jump_shards(F.col(id_col), shards).alias("j"),
                   F.coalesce(F.pmod(F.col(id_col), F.lit(parts)), F.lit(-1)).cast("int").alias("part"))
    df = df.select(id_col, "size", "text_crc32", F.col("j.shard").alias("shard"), F.col("j.grown").alias("grown_shard"), "part")
    counts = df.groupBy("shard", "part").agg(F.count("*").alias("n"))
    firsts = counts.select("shard", "part", (F.sum("n").over(
        Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy(id_col, "text_crc32", "size"))
    out = df.withColumn("place", place).join(F.broadcast(firsts), ["shard", "part"])
    return out.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard",
                      (F.col("first") + F.col("place") - F.lit(1)).cast("long").alias("slot"), "grown_shard")


def op5_jump_shards(spark: SparkSession, d: str) -> DataFrame:
    """All ``documents`` into 24 shards."""
    return assign(documents(spark, d), 24)


# the CRC by its table of bytes, the jumps with 128-bit numbers
SQL_SHARDS = """
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, length(h) // 2 + 8 AS size, list_transform(range(1, length(h) // 2 + 1), lambda i:
    (instr('0123456789ABCDEF', substr(h, 2 * i - 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i, 1)) - 1) AS b FROM d),
summed AS (SELECT doc_id, size, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
           FROM bytes, crc),
jumped AS (SELECT *, list_reduce(list_transform(range(25), lambda i: {'k': 0::HUGEINT, 'a': 0::BIGINT, 's': 0::BIGINT, 'g': 0::BIGINT}),
  lambda x, i: CASE WHEN x.a > 24 THEN x ELSE list_transform([(x.k * 2862933555777941757 + 1) % 18446744073709551616], lambda k:
    list_transform([floor((x.a + 1)::DOUBLE * (2147483648::DOUBLE / (k // 8589934592 + 1)::DOUBLE))::BIGINT], lambda a:
      {'k': k, 'a': a, 's': CASE WHEN a < 24 THEN a ELSE x.s END, 'g': CASE WHEN a <= 24 THEN a ELSE x.g END})[1])[1] END,
  {'k': coalesce(doc_id, 0)::HUGEINT, 'a': 0::BIGINT, 's': 0::BIGINT, 'g': 0::BIGINT}) AS j FROM summed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, j.s::INTEGER AS shard,
  row_number() OVER (PARTITION BY j.s ORDER BY coalesce(doc_id % 251, -1), doc_id, text_crc32, size) - 1 AS slot, j.g::INTEGER AS grown_shard FROM jumped
"""
