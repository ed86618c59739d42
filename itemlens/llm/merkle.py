"""Merkle manifest of a dataset: a tree over rows per group, a tree over the groups, and a proof for every row."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemlens.llm.common import documents, stored

FAN = 8  # nodes that become one
HEIGHT = 4  # levels that one task folds in one go
WIDTH = FAN ** HEIGHT
PATH = "array<struct<at int, others string>>"


def joined_hash(digests) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height_of(total: int) -> int:
    """Levels that a block of a tree of ``total`` nodes is folded by: all of a small tree, ``HEIGHT`` of a larger one."""
    if total > WIDTH:
        return HEIGHT
    h = 0
    while FAN ** h < total:
        h += 1
    return h


def deliver_up(digests: list[str], height: int) -> tuple[dict, str]:
    """({node: its children's digests}, the digest of the block's top).

    A node is labelled (level, position). Digests travel through a queue in the order of the labels they are addressed to, so
    when a label comes up all of its children are at the head.
    """
    if not height:
        return {}, digests[0]
    queue = [((1, i // FAN), i, d) for i, d in enumerate(digests)]  # already a heap
    runs, top = {}, ""
    while queue:
        label = queue[0][0]
        run = []
        while queue and queue[0][0] == label:
            run.append(heapq.heappop(queue)[2])
        runs[label] = run
        level, at = label
        top = joined_hash(run)
        if level < height:
            heapq.heappush(queue, ((level + 1, at // FAN), at, top))
    return runs, top


def deliver_down(runs: dict, height: int, path: list) -> Iterator[tuple[int, list]]:
    """(position, path) of each node at the bottom of a block; ``path`` is that of the block's top.

    A path has for each level the node's place in its run and the other digests of the run. The sweep goes through the labels
    in reverse, and each node hands what lies above it to its children.
    """
    if not height:
        yield 0, path
        return
    queue = [((-height, 0), path)]
    while queue:
        (level, at), above = heapq.heappop(queue)
        run = runs[-level, -at]
        for k, _ in enumerate(run):
            own = [{"at": k, "others": "".join(run[:k] + run[k + 1:])}, *above]
            if level == -1:
                yield -at * FAN + k, own
            else:
                heapq.heappush(queue, ((level + 1, at * FAN - k), own))


def folded(digest: str, path: list) -> str:
    """The root that a digest and the other digests on its path give."""
    for step in path:
        cut = 64 * step["at"]
        digest = joined_hash((step["others"][:cut], digest, step["others"][cut:]))
    return digest


def placed(nodes: DataFrame, name: str) -> DataFrame:
    """``nodes`` (tree, place, digest, ..) with index and total long: the rank by (place, digest) in the tree, nulls first, and the tree's
    size. Rows are range partitioned, so a tree may lie in many partitions; ranks come from counts of its parts."""
    ranged = nodes.repartitionByRange("tree", "place", "digest").sortWithinPartitions("tree", "place", "digest")
    rows = stored(ranged.withColumn("part", F.spark_partition_id()).withColumn(
        "seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), name)
    parts = rows.groupBy("tree", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part")
    parts = parts.select("tree", "part", (F.sum("n").over(before) - F.col("n") - F.col("first")).alias("shift"),
                         F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    return rows.join(parts, ["tree", "part"]).withColumn("index", F.col("seq") + F.col("shift")).drop("part", "seq", "shift")


def blocks_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[dict]]:
    """The rows of each (tree, block), which come together and in order."""
    held, at = [], None
    for batch in batches:
        for row in pa.Table.from_batches([batch]).select(names).to_pylist():
            if (row["tree"], row["block"]) != at:
                if held:
                    yield held
                held, at = [], (row["tree"], row["block"])
            held.append(row)
    if held:
        yield held


def in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "index")


def level_up(nodes: DataFrame) -> DataFrame:
    """(tree, index, total, digest): the tops of blocks of ``WIDTH`` consecutive ``nodes`` of the same columns."""
    names = ["tree", "block", "total", "digest", "index"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks_of(batches, names):
            total = rows[0]["total"]
            top = deliver_up([r["digest"] for r in rows], height_of(total))[1]
            yield pa.RecordBatch.from_pylist([{"tree": rows[0]["tree"], "index": rows[0]["block"], "total": -(-total // WIDTH), "digest": top}],
                                             schema=pa.schema([("tree", pa.string()), ("index", pa.int64()), ("total", pa.int64()), ("digest", pa.string())]))

    blocked = nodes.withColumn("block", F.floor(F.col("index") / WIDTH)).select(*names)
    return in_blocks(blocked).mapInArrow(run, "tree string, index long, total long, digest string")


def levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """``nodes`` and, round by round, the tops of their blocks, up to one node a tree. The driver reads the size of the largest tree."""
    out, largest = [nodes], nodes.agg(F.max("total")).first()[0] or 1
    while largest > 1:
        out.append(stored(level_up(out[-1]), name))
        largest = -(-largest // WIDTH)
    return out


def with_paths(nodes: DataFrame, above: DataFrame, carry: list[str], finish=None, schema: str = "") -> DataFrame:
    """The columns ``carry`` of ``above`` (tree, index, path, ..) and the path of each of ``nodes``, whose blocks' tops ``above`` has.

    The path of a block's top comes before the block's rows and is not copied to them. ``finish`` makes the result row from (row, top, path);
    without it that is (tree, index, path, ``carry``).
    """
    extra = [c for c in nodes.columns if c not in ("tree", "index", "total", "digest")]
    rows = nodes.withColumn("block", F.floor(F.col("index") / WIDTH))
    tops = above.select("tree", F.col("index").alias("block"), F.lit(-1).cast("long").alias("index"), "path", *carry)
    sent = in_blocks(rows.unionByName(tops, allowMissingColumns=True))
    names = ["tree", "block", "index", "total", "digest", "path", *carry, *extra]
    plain = f"tree string, index long, path {PATH}" + "".join(f", `{c}` {above.schema[c].dataType.simpleString()}" for c in carry)
    finish = finish or (lambda row, top, path: {"tree": row["tree"], "index": row["index"], "path": path} | {c: top[c] for c in carry})
    target = pa.schema([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for top, *own in blocks_of(batches, names):
            height = height_of(own[0]["total"])
            runs, _ = deliver_up([r["digest"] for r in own], height)
            done = [finish(own[k], top, path) for k, path in deliver_down(runs, height, top["path"])]
            yield pa.RecordBatch.from_pylist(done, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema or plain), prefers_large_types=False)
    return sent.select(*names).mapInArrow(run, schema or plain)


def leaf_text(columns: list[Column]) -> Column:
    """The columns one after another: ``-`` for null, else the bytes of the value, a colon and the value."""
    text = lambda c: c.cast("string")
    return F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c))) for c in columns])


def manifest(docs: DataFrame, columns: list[str], group_col: str = "lang", id_col: str = "doc_id", tampered: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified): the Merkle tree of all rows, each with its proof.

    A leaf is the SHA-256 of ``columns``. The leaves of a group stand in the order of their ids (null first, equal ids by leaf), and
    while there is more than one node every eight become one; what remains is the group's subroot, and subroots, in the order of
    their groups (null first, by bytes), become the root alike. ``proof_sha256`` stands for the other digests on a row's way to the root;
    ``folded_root`` is computed from them and from the leaf, or from the leaf of the row with the columns ``tampered`` in place.

    Processing goes forward in the order of labels. Between tasks the shuffle, sorted by (tree, block, index), is the queue that hands
    nodes to their parents, 4,096 to a block; in a task it is a heap. A reversed sweep hands paths back from tops to leaves. A group's leaves are
    spread over all tasks however many they are, paths above a block travel once a block, and what is collected is two sizes and the root.
    Repeated rows are leaves each; an empty table gives an empty one; other columns are left out.
    """
    leaf = lambda changed: F.sha2(leaf_text([changed.get(c, F.col(f"`{c}`")) for c in columns]), 256)
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    leaves = stored(docs.select(group.alias("tree"), F.col(f"`{id_col}`").alias("place"), leaf({}).alias("digest"), leaf(tampered or {}).alias("now")), "leaves")
    lower = levels(placed(leaves, "merkle-rows"), "merkle")
    subroots = lower[-1].select(F.lit("").alias("tree"), F.col("tree").alias("place"), "digest")
    upper = levels(placed(subroots, "merkle-groups"), "merkle")
    top = upper[-1].select("tree", "index", "digest").first()
    root = top["digest"] if top else None
    spark = docs.sparkSession
    above = spark.createDataFrame([("", 0, [])] if top else [], f"tree string, index long, path {PATH}")
    for nodes in upper[-2:0:-1]:
        above = with_paths(nodes, above, [])
    if len(upper) > 1:
        above = with_paths(upper[0], above, [], lambda row, _, path: {"tree": row["place"], "index": 0, "path": path, "subroot": row["digest"]},
                           f"tree string, index long, path {PATH}, subroot string")
    else:
        above = upper[0].select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("index"), F.array().cast(PATH).alias("path"), F.col("digest").alias("subroot"))
    for nodes in lower[-2:0:-1]:
        above = with_paths(nodes, above, ["subroot"])

    def finish(row, top, path):
        return {id_col: row["place"], "leaf": row["digest"], "subroot": top["subroot"],
                "proof_sha256": joined_hash(step["others"] for step in path), "folded_root": folded(row["now"], path)}

    found = with_paths(lower[0], above, ["subroot"], finish, f"`{id_col}` {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
    return found.select(id_col, "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def op11_merkle(spark: SparkSession, d: str) -> DataFrame:
    """All ``documents``; where 3 divides the CRC-32 of the id, a tampered copy with its text's A-Z lower-cased is held against the proof."""
    lowered = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(documents(spark, d, "doc_id", "source", "lang", "n_chars", "text"), ["doc_id", "source", "lang", "n_chars", "text"],
                    tampered={"text": F.when(hit, lowered).otherwise(F.col("text"))})


# the CRC by its table of bytes; one recursion folds the leaves of each group, the other the subroots
SQL_MERKLE = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab),
hit AS (SELECT *, coalesce(xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 3 = 0, false) AS hit FROM documents, crc),
fields AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') ||
    coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
    CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM hit),
leafs AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS now FROM fields),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leafs),
up AS (SELECT tree, 0 AS level, idx, n, leaf AS h FROM ranked
  UNION ALL SELECT tree, any_value(level) + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY tree, idx // 8),
sub AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, idx, n, subroot AS h FROM sub
  UNION ALL SELECT any_value(level) + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY idx // 8),
runs AS (SELECT tree, level, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM up WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT level, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM top WHERE n > 1 GROUP BY ALL),
steps AS (SELECT r.tree, r.idx, level, hs, (r.idx // pow(8, level)::BIGINT) % 8 AS spot FROM ranked r JOIN runs ON runs.tree = r.tree AND run = r.idx // pow(8, level + 1)::BIGINT
  UNION ALL SELECT r.tree, r.idx, 100 + level, hs, (s.idx // pow(8, level)::BIGINT) % 8 FROM ranked r JOIN sub s USING (tree) JOIN top_runs ON run = s.idx // pow(8, level + 1)::BIGINT),
paths AS (SELECT tree, idx, list({'l': array_to_string(hs[1:spot], ''), 'r': array_to_string(hs[spot + 2:], ''), 'h': ''} ORDER BY level) AS path FROM steps GROUP BY ALL),
done AS (SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(array_to_string(list_transform(path, lambda s: s.l || s.r), ''), '')) AS proof_sha256,
    coalesce(list_reduce(path, lambda a, s: {'l': '', 'r': '', 'h': sha256(s.l || a.h || s.r)}, {'l': '', 'r': '', 'h': now}).h, now) AS folded_root
  FROM ranked LEFT JOIN paths USING (tree, idx) JOIN sub USING (tree))
SELECT *, folded_root = root AS verified FROM done
"""
