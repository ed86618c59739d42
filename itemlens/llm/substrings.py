"""Repeated passages: word windows that a smaller document has too, found behind a count-min sketch."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemlens.llm.common import BLANKS, blocks, bounded, documents, kept, number, passes, screen, stored, strings
from itemlens.session import shuffled

LINES = 2  # rows of the sketch
BLOCKS = 256  # parts that each row is merged in
PART = 1_000_000  # windows of a part that is sketched at a time
HELD = 500_000  # windows that a task looks up at a time
LONG_WORD = 64  # bytes of a word whose hash is kept
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


class WordHashes(dict):
    """64-bit hash of each word; a bounded number of short ones is kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG_WORD:
            if len(self) >= 100_000:
                self.clear()
            self[word] = h
        return h


def window_hashes(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: a 64-bit hash, 31 more bits, the text's place in the list and the first word's in the text.

    Both are polynomials, in different bases, of the words' hashes: different sequences agree on all 95 bits with a
    chance of some 2^-88 (swapped words cost a few bits), which is taken for never.
    """
    known = kept("words", WordHashes)
    split = [x.encode().split() for x in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    x = np.fromiter((known[w] for ws in split for w in ws), np.uint64, int(counts.sum()))
    n = max(len(x) - words + 1, 0)
    h, v = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(words):
        part = x[j:j + n]
        h += part * np.uint64(pow(ODD[0], j, 1 << 64))
        v += part * np.uint64(pow(ODD[1], j, 1 << 64))
    firsts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(texts)), np.maximum(counts - words + 1, 0))
    within = np.arange(len(owner)) - np.repeat(
        np.cumsum(np.maximum(counts - words + 1, 0)) - np.maximum(counts - words + 1, 0), np.maximum(counts - words + 1, 0))
    at = firsts[owner] + within
    return h[at], (v[at] >> np.uint64(33)).astype(np.int32), owner, within


def cells(h: np.ndarray, line: int, bits: int) -> np.ndarray:
    mixed = (h ^ (h >> np.uint64(29 + 2 * line))) * np.uint64(ODD[2 + line])
    return (mixed >> np.uint64(64 - bits)).astype(np.uint32)


def sketches(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """(line, block, weight, data): sketches of parts of each partition, sparse. A cell that a part counts once has
    weight 1, one that it counts more often weight 2; ``data`` are the steps between the block's cells, byte by byte of all."""
    df = docs.select(F.lit(0).alias("none"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        held: list[np.ndarray] = []

        def flush():
            packer = zstandard.ZstdCompressor(level=1)
            h = np.concatenate(held)
            held.clear()
            rows = []
            for line in range(LINES):
                found, count = np.unique(cells(h, line, bits), return_counts=True)
                for weight, own in ((1, found[count == 1]), (2, found[count > 1])):
                    edges = np.searchsorted(own, np.arange(BLOCKS + 1, dtype=np.int64) << (bits - 8))
                    for b in range(BLOCKS):
                        part = own[edges[b]:edges[b + 1]]
                        if len(part):
                            steps = np.diff(part, prepend=np.uint32(b << (bits - 8)))
                            rows.append((line, b, weight, packer.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                names=["line", "block", "weight", "data"])

        for batch in blocks(batches, 1 << 20):
            held.append(window_hashes(strings(batch.column(1)), words)[0])
            if sum(map(len, held)) >= PART:
                yield flush()
        if sum(map(len, held)):
            yield flush()

    return bounded(df).mapInArrow(run, "line int, block int, weight int, data binary")


def merged(parts: DataFrame, bits: int) -> DataFrame:
    """(line, block, bitmap): the cells that all parts together count twice or more, one bit a cell."""
    width = 1 << (bits - 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, unpack, at, counts = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor(), None, None

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()),
                 pa.array([pack.compress(np.packbits(counts >= 2, bitorder="little").tobytes())], pa.binary())], names=["line", "block", "bitmap"])

        for batch in batches:
            for line, block, weight, data in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (line, block):
                    if at:
                        yield done()
                    at, counts = (line, block), np.zeros(width, np.uint8)
                planes = np.frombuffer(unpack.decompress(data), np.uint8).reshape(4, -1)
                own = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)
                counts[own] = np.minimum(counts[own] + weight, 2)
        if at:
            yield done()

    # the sort brings the parts of a block together, so that one block's counters are held at a time
    return parts.repartition("line", "block").sortWithinPartitions("line", "block").mapInArrow(
        run, "line int, block int, bitmap binary")


class Sketch:
    """The merged sketch: is a cell counted twice or more? ``data`` are the compressed bitmaps of all blocks one after another, ``at`` where each ends.

    At most LINES x 2^bits bits, whatever the input, and less as they stay compressed.
    """

    def __init__(self, found: pa.Table, bits: int):
        """``found`` (line, block, bitmap)."""
        place = found.column(0).to_numpy() * BLOCKS + found.column(1).to_numpy()
        bitmaps = found.column(2).combine_chunks()
        sizes = np.zeros(LINES * BLOCKS, np.int64)
        sizes[place] = pa.compute.binary_length(bitmaps).to_numpy(zero_copy_only=False)
        self.bits, self.at = bits, np.append(0, np.cumsum(sizes))
        self.data = b"".join(bitmaps[k].as_py() for k in np.argsort(place).tolist())

    def repeated(self, h: np.ndarray, line: int) -> np.ndarray:
        """Which of the hashes may be repeated by one row of the sketch: cells are looked up in order, with one block unpacked at a time."""
        import zstandard

        reader, c, hit = zstandard.ZstdDecompressor(), cells(h, line, self.bits), np.zeros(len(h), bool)
        order = np.argsort(c)
        c = c[order]
        edges = np.searchsorted(c, np.arange(BLOCKS + 1, dtype=np.int64) << (self.bits - 8))
        for block in range(BLOCKS):
            a, b, k = edges[block], edges[block + 1], line * BLOCKS + block
            if a < b and self.at[k] < self.at[k + 1]:
                bitmap = np.frombuffer(reader.decompress(self.data[self.at[k]:self.at[k + 1]]), np.uint8)
                own = c[a:b] & np.uint32((1 << (self.bits - 8)) - 1)
                hit[order[a:b]] = (bitmap[own >> np.uint32(3)] >> (own & np.uint32(7)).astype(np.uint8)) & 1 == 1
        return hit


def estimate(docs: DataFrame, words: int, bits: int) -> Sketch:
    return Sketch(merged(sketches(docs, words, bits), bits).toArrow(), bits)


def candidates(docs: DataFrame, words: int, bits: int, sketch) -> DataFrame:
    """(row, id, h, tail): windows that the sketch estimates repeated; ``tail`` has v above and the position below 32 bits.

    A part of a partition settles what it can: where it sees a window in several documents, all but the least one's are
    surely to go and come with v = -1 (and any h); so a part sends one document for each window, and no window, however
    often it occurs, has more rows than there are parts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            row, doc, h, v, pos = (np.concatenate([x[i] for x in held]) for i in range(5))
            held.clear()
            for line in range(LINES):
                hit = sketch.value.repeated(h, line)
                row, doc, h, v, pos = (x[hit] for x in (row, doc, h, v, pos))
            order = np.argsort(h, kind="stable")
            hs, vs, ds = h[order], v[order], doc[order]
            new = np.flatnonzero(np.append(True, (hs[1:] != hs[:-1]) | (vs[1:] != vs[:-1]))[: len(hs)])
            later = np.zeros(len(h), bool)
            if len(h):
                later[order] = ds > np.repeat(np.minimum.reduceat(ds, new), np.diff(np.append(new, len(hs))))
            h = np.where(later, row.view(np.uint64) + pos.astype(np.uint64) * np.uint64(ODD[0]), h)
            tail = np.where(later, np.int64(-1) << 32, v.astype(np.int64) << 32) | pos
            # in the texts' order, which leaves ids next to each other and the shuffled blocks small
            return pa.RecordBatch.from_arrays(
                [pa.array(row), pa.array(doc), pa.array(h.view(np.int64)), pa.array(tail)], names=["row", "id", "h", "tail"])

        for batch in blocks(batches, 1 << 20):
            h, v, owner, pos = window_hashes(strings(batch.column(1)), words)
            held.append((batch.column(0).to_numpy()[owner], batch.column(2).to_numpy()[owner], h, v, pos.astype(np.int32)))
            size += len(h)
            if size >= HELD:
                yield flush()
                size = 0
        if held:
            yield flush()

    return docs.select("row", "text", "id").mapInArrow(run, "row long, id long, h long, tail long")


def cut(text: str, starts: list[int], words: int) -> tuple[str, int, int]:
    """The text without the words that the windows at ``starts`` cover, its words, and how many went.

    What stays between two cuts stays as it is; at a cut stands a line break if the gap had one, else a space.
    """
    found = [m.span() for m in re.finditer(BLANKS, text)]
    gone = np.zeros(len(found) + words, np.int32)
    for s in set(starts):
        gone[s] += 1
        gone[s + words] -= 1
    keep = np.cumsum(gone)[: len(found)] == 0
    if keep.all():
        return text, len(found), 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
    out, last = [], None
    for a, b in edges.reshape(-1, 2).tolist():
        if last is not None:
            out.append("\n" if "\n" in text[last:found[a][0]] else " ")
        last = found[b - 1][1]
        out.append(text[found[a][0]:last])
    return "".join(out), len(found), int(len(found) - keep.sum())


def remove_repeats(docs: DataFrame, words: int = 13, bits: int = 29, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(all columns of ``docs``, the text without repeats; n_words long, n_removed long).

    A window is ``words`` consecutive words of one text. Every word goes that a window covers whose word sequence also
    starts in a document of a smaller id; all windows are judged on the input. First pass: a count-min sketch of
    2 x 2^bits cells (a fixed size, the bound of its broadcast), merged from sparse sketches of parts of partitions;
    it never underestimates, so no repeat is lost. Second pass: only windows estimated repeated are sent, and grouped
    by 95 bits of hash of their words, which is what equality means here. A fuller sketch (inputs of far more than
    2^bits windows) lets more windows through, never fewer.

    Null texts have no words and stay null; texts without repeats stay as they are, even blank; a fully repeated one
    becomes empty. Ids must be whole numbers; a null id is above all others, and null ids do not remove each other.
    Rows that share an id never remove each other either, and each loses what smaller ids have. Columns named like the
    added ones are replaced; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    keyed = docs.drop("n_words", "n_removed").withColumn("#row", F.xxhash64(F.col(id_col), F.col(text_col)))
    plain = keyed.where(F.col(text_col).isNotNull()).select(
        F.col("#row").alias("row"), F.col(text_col).alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"))
    sketch = spark.sparkContext.broadcast(estimate(plain, words, bits))
    sent = candidates(plain, words, bits, sketch)
    first = F.min("id").over(Window.partitionBy("h", F.shiftright("tail", 32)))
    starts = stored(sent.withColumn("first", first).where((F.col("tail") < 0) | (F.col("id") > F.col("first"))).groupBy(
        F.col("row").alias("#r"), F.col("id").alias("#i")).agg(F.sort_array(F.collect_list(
            F.col("tail").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))).alias("#starts")), "repeats")
    sketch.destroy()  # what was looked up in it is written
    # most documents lose nothing: only those that may are dealt out to meet their windows
    touched = screen(starts.select(number("#r").alias("at")))

    @F.pandas_udf("boolean")
    def may_lose(at: pd.Series) -> pd.Series:
        return pd.Series(passes(touched, at.to_numpy()))

    held = keyed.withColumn("#id", F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)))
    joined = held.where(may_lose(number("#row"))).join(
        shuffled(starts), (F.col("#row") == F.col("#r")) & (F.col("#id") == F.col("#i")), "left").drop("#r", "#i", "#row", "#id")
    whole = held.where(~may_lose(number("#row"))).drop("#row", "#id").withColumn("#starts", F.lit(None).cast("array<int>"))
    names = [c for c in joined.columns if c != "#starts"]
    schema = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in names) + ", n_words long, n_removed long"
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 128):
                batch = whole.slice(at, 128)
                texts, lists_ = batch.column(place).to_pylist(), batch.column(len(names)).to_pylist()
                done = [cut(t or "", s or [], words) if s else (t, len(t.encode().split()) if t else 0, 0)
                        for t, s in zip(texts, lists_)]
                columns = list(batch.columns[:-1])
                columns[place] = pa.array([x[0] for x in done], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())],
                    names=[*names, "n_words", "n_removed"])

    return joined.unionByName(whole).select(*[f"`{c}`" for c in names], "`#starts`").mapInArrow(run, schema)


def op4_repeats(spark: SparkSession, d: str) -> DataFrame:
    """All ``documents`` without 13-word windows that an earlier document has."""
    kept_words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return remove_repeats(documents(spark, d)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.array_join(kept_words, " ").cast("binary"), 256).alias("kept_sha256"))


SQL_REPEATS = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS passage FROM places),
own AS (SELECT passage, min(doc_id) AS least FROM win GROUP BY passage),
late AS (SELECT doc_id, p FROM win JOIN own USING (passage) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, p + k AS pos, true AS g FROM late, range(13) r(k)),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
marked AS (SELECT word.doc_id, word, word.pos, coalesce(g, false) AS g FROM word LEFT JOIN gone USING (doc_id, pos)),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE g) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT g) AS t
         FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""
