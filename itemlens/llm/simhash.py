"""SimHash near-duplicates: fingerprints of word shingles, linked by a range join on segment bit counts; with a check of the shingles' similarity besides."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlens.llm.common import blocks, bounded, documents, few, kept, lists, number, passes, screen, stored, strings
from itemlens.llm.components import components
from itemlens.operators.pairs import block_pairs, with_key_size
from itemlens.session import checkpointed, shuffled


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (UTF-8, seed 42) of each run of ``words`` words, A-Z lower-cased, joined by one space; repeats stay."""
    import xxhash

    found = text.encode().lower().split()  # on bytes: ASCII letters and blanks only
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(found) - words + 1]
    slices = map(joined.__getitem__, map(slice, starts.tolist(), ends[words - 1:].tolist()))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), slices), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """Signed 64 bits: a bit is 1 if it is set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the SimHash of every whole text; without words (null, empty, blanks) it is zero."""
    df = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1 << 21):
            fps = [simhash(shingle_hashes(x, words)) for x in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    return bounded(df).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def segment_counts(fp: Column, bits: int) -> Column:
    """The bit counts of all segments of ``bits`` (1, 2 or 4) bits, each in the place of its segment."""
    both = lambda x, mask: x.bitwiseAND(F.lit(mask))
    if bits >= 2:
        a, b = both(fp, 0x5555555555555555), both(F.shiftrightunsigned(fp, 1), 0x5555555555555555)
        fp = a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))  # their sum, which could overflow
    if bits == 4:
        fp = both(fp, 0x3333333333333333) + both(F.shiftrightunsigned(fp, 2), 0x3333333333333333)
    return fp


def grid_cells(counts: Column, bits: int, groups: int) -> Column:
    """array<struct(part, cell, change, up)>: for each of ``groups`` runs of segments the grid cell that its counts
    name, and the cells one step away (``change``: the segment changed, -1 none; ``up``: by plus one)."""
    total = 64 // bits
    edges = [round(g * total / groups) for g in range(groups + 1)]
    return F.concat(*[_cells_of_run(counts, bits, g, range(edges[g], edges[g + 1])) for g in range(groups)])


def _cells_of_run(counts: Column, bits: int, run: int, inside: range) -> Column:
    field = (1 << bits) - 1
    mask = sum(field << (bits * i) for i in inside)
    own = counts.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))

    def cell(value: Column, change: Column, up: bool) -> Column:
        return F.struct(F.lit(run).alias("part"), value.alias("cell"), change.alias("change"), F.lit(up).alias("up"))

    def steps(i: Column) -> Column:
        at = i * F.lit(bits)
        value = F.call_function("shiftrightunsigned", own, at).bitwiseAND(F.lit(field))
        rest = own.bitwiseXOR(F.call_function("shiftleft", value, at))  # of a field that stays within 0 to bits none carries
        moved = lambda by: rest.bitwiseOR(F.call_function("shiftleft", value + F.lit(by).cast("long"), at))
        return F.array(F.when(value < F.lit(bits), cell(moved(1), i, True)), F.when(value > F.lit(0), cell(moved(-1), i, False)))

    found = F.flatten(F.transform(F.array(*[F.lit(i) for i in inside]), steps))
    return F.concat(F.array(cell(own, F.lit(-1), False)), F.filter(found, lambda x: x.isNotNull()))


def _run_mask(bits: int, groups: int, run: int) -> int:
    total, field = 64 // bits, (1 << bits) - 1
    mask = sum(field << (bits * i) for i in range(round(run * total / groups), round((run + 1) * total / groups)))
    return mask - (1 << 64) if mask >> 63 else mask


def first_run(a: Column, b: Column, part: Column, bits: int, groups: int) -> Column:
    """Is ``part`` the first run in which the counts of two fingerprints are within a distance of 2?

    Counts of one or two bits are written in unary, where their distance is the number of differing bits.
    """
    if bits > 2:
        return F.lit(True)
    unary = lambda c: c if bits == 1 else c.bitwiseOR(F.shiftrightunsigned(c, 1).bitwiseAND(F.lit(0x5555555555555555)))
    x = unary(segment_counts(a, bits)).bitwiseXOR(unary(segment_counts(b, bits)))
    out = F.lit(True)
    for g in range(groups - 1):
        out = out & ((part <= g) | (F.bit_count(x.bitwiseAND(F.lit(_run_mask(bits, groups, g)).cast("long"))) > 2))
    return out


def near_pairs(fps: DataFrame, max_bits: int, segment_bits: int = 2) -> DataFrame:
    """(a, b), a < b: the distinct fingerprints of ``fps`` (fp) that differ in at most ``max_bits`` bits.

    Each fingerprint becomes the vector of its segments' bit counts. The Manhattan distance of two vectors is at most
    the number of differing bits, so of ``max_bits // 3 + 1`` runs of segments one at least is within distance 2. In a run, vectors within 2
    meet in a grid cell that is at most one step from each; which of their common cells counts is fixed, and so is the
    run, so a pair comes once. The join's condition verifies the bits themselves. Each fingerprint has some fifty cells, so both sides are shuffled at any size.
    """
    groups = max_bits // 3 + 1
    cells = fps.select("fp").distinct().select("fp", F.inline(grid_cells(segment_counts(F.col("fp"), segment_bits), segment_bits, groups)))
    side = lambda s: cells.select("part", "cell", F.col("fp").alias(s), F.col("change").alias(f"c{s}"), F.col("up").alias(f"u{s}"))
    a, b = side("a"), side("b")
    once = (F.col("ca") == -1) | ((F.col("cb") >= 0) & (
        (F.col("ca") < F.col("cb")) | ((F.col("ca") == F.col("cb")) & (F.col("ua") != F.col("ub")))))
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    exact = exact & first_run(F.col("a"), F.col("b"), F.col("part"), segment_bits, groups)
    return shuffled(a).join(b, ["part", "cell"]).where((F.col("a") < F.col("b")) & exact & once).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4, segment_bits: int = 2,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): every document with the least id that it reaches over links of ``max_bits`` bits.

    Rows of one fingerprint are one node, however many they are; only links between different fingerprints are joined,
    and only classes travel back. Documents without words share fingerprint zero and link like any other. Repeated rows
    give a row each; a null id is never a component's id unless it has no other; an empty table gives an empty one;
    other columns are left out.
    """
    fps = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = checkpointed(few(fps.groupBy("fp").agg(F.min(id_col).alias("least"))))
    pairs = near_pairs(nodes, max_bits, segment_bits)
    return with_components(fps, nodes, pairs, id_col)


def with_components(fps: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    roots = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    linked = shuffled(nodes).join(roots, nodes["fp"] == roots["node"])
    names = linked.groupBy("root").agg(F.min("least").alias("name"))
    classes = nodes.join(linked.select("fp", "root").join(names, "root").select("fp", "name"), "fp", "left").select(
        "fp", F.coalesce("name", "least").alias("component_id"))
    return shuffled(fps).join(classes, "fp").select(id_col, "fp", "component_id")


BANDS, ROWS = 40, 8  # sets of similarity s share no band with probability (1 - s**ROWS)**BANDS: 0.0006 at 0.8


def set_name(found: np.ndarray) -> bytes:
    """128 bits of hash that stand for a sorted set of shingles."""
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


SKETCH = BANDS * ROWS // 16  # words of four bits for each hash function


def set_sketch(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bands, sketch): for each band a hash of the set's least values under ``ROWS`` hash functions of its own, and four bits of each of
    these values; an empty set has no bands."""
    import xxhash

    if not len(found):
        return np.zeros(0, np.int64), np.zeros(SKETCH, np.int64)
    by, plus = kept("simhash bands", lambda: [np.array(
        [xxhash.xxh64_intdigest(str(k), seed) | 1 for k in range(BANDS * ROWS)], np.uint64)[:, None] for seed in (1, 2)])
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), 256):
        some = found[None, at:at + 256] * by
        some += plus
        np.minimum(least, some.min(axis=1), out=least)
    raw = least.tobytes()
    bands = np.array([xxhash.xxh64_intdigest(raw[8 * ROWS * k:8 * ROWS * (k + 1)], k) for k in range(BANDS)], np.uint64).view(np.int64)
    bits = (least >> np.uint64(32) & np.uint64(15)).reshape(SKETCH, 16)  # the highest ones are 0 in all least values
    return bands, (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def may_be_alike(a: str, b: str, similarity: float) -> Column:
    """May sets of these sketches be that similar? Of the hash functions a share as large as the similarity gives both sets one value, and of the
    others a sixteenth the same four bits; 3.4 standard deviations below that are let through, so one pair in 3,000 at the similarity itself is not."""
    n, p = 16 * SKETCH, similarity + (1 - similarity) / 16
    least = int(n * p - 3.4 * (n * p * (1 - p)) ** 0.5)
    differ = F.lit(0)
    for i in range(SKETCH):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for by in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return F.lit(n) - differ >= least


PARITY = 1024  # bits


def set_parity(found: np.ndarray) -> np.ndarray:
    """``PARITY`` bits: whether the number of the set's hashes with these last ten bits is odd. Where two sets' bits differ, a hash is in one of them only."""
    odd = np.bincount((found & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def differ_little(a: str, b: str, similarity: float) -> Column:
    """Do the parities ``a`` and ``b`` of sets of ``n_a`` and ``n_b`` hashes differ in no more bits than sets of that similarity can? Each bit is a hash of its own
    that one set lacks, so no similar pair is left out; of sets of up to a thousand hashes hardly any others are let through."""
    differ = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(PARITY // 64)), F.lit(0))
    return differ <= (F.col("n_a") + F.col("n_b")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)


def text_marks(text_col: str) -> list[Column]:
    """Two hashes of a text, 128 bits, which with a row's id tell it from others."""
    text = F.col(text_col).cast("string")
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def shingle_sets(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t1, t2, set binary, n int, fp long, bands, sketch, parity array<long>): the name, size, SimHash, bands, sketch and parity of the set of each
    whole text's shingles. Each shingle counts once for the SimHash, so a much repeated line weighs no more than another."""
    df = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), *text_marks(text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1 << 21):
            found = [np.unique(shingle_hashes(x, words)) for x in strings(batch.column(1))]
            bands, sketch = zip(*(set_sketch(x) for x in found)) if found else ([], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array([set_name(x) for x in found], pa.binary()),
                 pa.array([len(x) for x in found], pa.int32()), pa.array([simhash(x) for x in found], pa.int64()),
                 *[lists(pa.array(np.concatenate(y)), [len(x) for x in y]) for y in (bands, sketch, [set_parity(x) for x in found])]],
                names=[id_col, "t1", "t2", "set", "n", "fp", "bands", "sketch", "parity"])

    return bounded(df).mapInArrow(run, f"`{id_col}` {kind}, t1 long, t2 long, set binary, n int, fp long, bands array<long>, sketch array<long>, parity array<long>")


def fits(similarity: float) -> Column:
    return F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b")


def near_sets(nodes: DataFrame, similarity: float, max_bits: int) -> DataFrame:
    """(a, b): sets of ``nodes`` (set, n, fp) whose fingerprints differ in at most ``max_bits`` bits (``near_pairs``) and whose sizes allow the similarity.

    Sets of one fingerprint are paired with the least of them, which stands for them beside other fingerprints.
    """
    least = checkpointed(few(nodes.groupBy("fp").agg(F.min(F.struct("set", "n")).alias("x")).select("fp", F.col("x.set").alias("a"), F.col("x.n").alias("n_a"))))
    same = nodes.select("fp", F.col("set").alias("b"), F.col("n").alias("n_b")).join(least, "fp").where(F.col("a") != F.col("b")).select("a", "b", "n_a", "n_b")
    other = least.select(F.col("fp").alias("fp_b"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    near = checkpointed(few(near_pairs(least, max_bits))).toDF("fp", "fp_b").join(least, "fp").join(other, "fp_b").select("a", "b", "n_a", "n_b")
    return same.union(near).where(fits(similarity)).select("a", "b")


def shared_cells(nodes: DataFrame) -> DataFrame:
    """(band, set, n, parity): the bands of ``nodes`` (set, n, bands, parity) that several sets have. Most bands have one set, and are shuffled by two numbers only."""
    key = F.xxhash64("set").alias("key")
    cells = nodes.select(key, F.explode("bands").alias("band"))
    several = cells.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band")
    met = cells.join(shuffled(several), "band", "left_semi")
    return shuffled(met).join(nodes.select(key, "set", "n", "parity"), "key").select("band", "set", "n", "parity")


def stars(cells: DataFrame, similarity: float) -> DataFrame:
    """(a, b): in each band of ``cells`` (band, set, n, parity) its least and its greatest set, and each other one whose size and parity allow the similarity."""
    one = F.struct("set", "n", "parity")
    ends = cells.groupBy("band").agg(F.min(one).alias("x"), F.max(one).alias("y")).where("x.set <> y.set").select("band", F.explode(F.array("x", "y")).alias("x")).select(
        "band", F.col("x.set").alias("a"), F.col("x.n").alias("n_a"), F.col("x.parity").alias("parity_a"))
    other = cells.select("band", F.col("set").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("parity_b"))
    return shuffled(other).join(ends, "band").where((F.col("a") != F.col("b")) & fits(similarity) & differ_little("parity_a", "parity_b", similarity)).select("a", "b").distinct()


def apart(cells: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(a, b): sets that share a band of ``cells`` (band, set, n, of), differ in ``of``, and whose sizes and ``sketches`` (set, sketch, parity) allow the similarity.

    Only bands with two ``of`` or more are looked at; a large one is cut into blocks, each pair of which is a join of its own. Parities and sketches are
    compared in the join, so a large group of texts that are somewhat alike, but not enough, makes few pairs.
    """
    mixed = cells.groupBy("band").agg(F.min("of").alias("x"), F.max("of").alias("y")).where("x <> y").select("band")
    met = stored(shuffled(cells).join(mixed, "band"), "mixed")
    sized = stored(with_key_size(shuffled(met), "band", "set").join(sketches, "set"), "sized")  # each is read several times below: a plan of its own keeps the driver's plans small
    pairs = block_pairs(sized, "band", "set", ["n", "of", "parity", "sketch"])
    possible = (F.col("of_a") != F.col("of_b")) & fits(similarity) & differ_little("parity_a", "parity_b", similarity) & may_be_alike("sketch_a", "sketch_b", similarity)
    return pairs.where(possible).select("a", "b").distinct()


def linked_sets(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str, max_bits: int = 4) -> tuple[DataFrame, DataFrame]:
    """((id, t1, t2, set) of every row, (node, root) of the sets that are linked)."""
    sets = stored(shingle_sets(docs, words, id_col, text_col), "sets")
    nodes = stored(sets.groupBy("set").agg(F.min("t1").alias("t1"), *[F.first(c).alias(c) for c in ("n", "fp", "bands", "sketch", "parity")]), "nodes")
    cells = stored(shared_cells(nodes), "cells")
    first = near_sets(nodes, similarity, max_bits).union(stars(cells, similarity))
    near = checkpointed(few(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    links = checkpointed(few(alike(docs, nodes, near, words, similarity, text_col)))
    as_links = lambda pairs: pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(as_links(links))
    placed = stored(cells.join(roots, cells["set"] == roots["node"], "left").select("set", "n", "band", F.coalesce("root", "set").alias("of")), "placed")
    rest = checkpointed(few(apart(placed, nodes.select("set", "sketch", "parity"), similarity).join(near, ["a", "b"], "left_anti")))
    more = alike(docs, nodes, rest, words, similarity, text_col)
    known = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))  # as good as all links found before, and fewer
    return sets.select(id_col, "t1", "t2", "set"), components(checkpointed(few(known.union(as_links(more)))))


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t1, t2, component_id, first boolean): like ``near_duplicates``, but a link is a Jaccard similarity of sets of word shingles.

    A node is a set of shingles, named by 128 bits of hash: rows of one set are one node, and whatever else two texts have in
    common, their sets are compared before they are linked. Sets whose SimHashes ``near_pairs`` finds at 4 or fewer differing bits are
    candidates, and as these are only some of those of the similarity, so are sets that share a band of least hash values; the sets
    themselves decide: first the SimHashes' pairs and each band's least and greatest set against its others, which brings a large group of copies together by about
    as many comparisons as it has sets, then all that share a band and are not together yet. At a similarity of 0.8 a pair is missed with a probability of
    0.0009 at most, at 0.85 of less than 0.00001; raise ``BANDS`` for less.
    A row is told by its id and its text (hashes ``t1``, ``t2``), so rows that share an id are rows of their own. ``first`` marks the one of
    least id (null last; of one id, of least hashes) of its component, and all rows equal to it.
    """
    rows, roots = linked_sets(docs, words, similarity, id_col, text_col)
    rows = rows.join(roots, rows["set"] == roots["node"], "left").select(id_col, "t1", "t2", F.coalesce("root", "set").alias("of"))
    place = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("t1"), F.col("t2"))
    least = rows.groupBy("of").agg(F.min(place).alias("least"))
    return rows.join(least, "of").select(id_col, "t1", "t2", F.col(f"least.`{id_col}`").alias("component_id"), (place == F.col("least")).alias("first"))


def without_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are first of their component (``similar_documents``), once each.

    Only rows that may have to go, told by a bitmap of a fixed size, are dealt out to meet the list of those that stay; the others are not shuffled.
    """
    found = stored(similar_documents(docs, words, similarity, id_col, text_col).groupBy(
        F.col(id_col).alias("#id"), F.col("t1").alias("#t1"), F.col("t2").alias("#t2")).agg(F.max("first").alias("#first"), F.count("*").alias("#n")), "fates")
    touched = screen(found.where("NOT `#first` OR `#n` > 1").select(number("#id", "#t1", "#t2").alias("at")))

    @F.pandas_udf("boolean")
    def may_go(at: pd.Series) -> pd.Series:
        return pd.Series(passes(touched, at.to_numpy()))

    marks = [c.alias(f"#{name}") for c, name in zip(text_marks(text_col), ("t1", "t2"))]
    rows = docs.select("*", F.col(id_col).alias("#key"), *marks)
    doubt = may_go(number("#key", "#t1", "#t2"))
    stays = found.where(F.col("#first")).select("#id", F.col("#t1").alias("#s1"), F.col("#t2").alias("#s2"))
    met = rows.where(doubt).join(shuffled(stays), F.col("#key").eqNullSafe(F.col("#id")) & (F.col("#t1") == F.col("#s1")) & (F.col("#t2") == F.col("#s2")), "left_semi")
    return rows.where(~doubt).unionByName(met.dropDuplicates(["#key", "#t1", "#t2"])).select(*docs.columns)


def alike(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, similarity: float, text_col: str) -> DataFrame:
    """The pairs (a, b) of names of sets that have the similarity. Sets are read again from the texts and known by name."""
    ends = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct()
    wanted = checkpointed(few(ends.join(nodes, "set").select("set", "t1")))
    wanted_numbers = screen(wanted.select(number("t1").alias("at")))
    texts = docs.select(number(text_marks(text_col)[0]).alias("at"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1 << 21):
            batch = batch.filter(pa.array(passes(wanted_numbers, batch.column(0).to_numpy())))  # few documents are in any pair
            found = [np.unique(shingle_hashes(x, words)) for x in strings(batch.column(1))]
            values = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([set_name(x) for x in found], pa.binary()), lists(pa.array(values), [len(x) for x in found])],
                                             names=["set", "hashes"])

    found = texts.mapInArrow(sets, "set binary, hashes array<long>")
    found = stored(found.join(wanted, "set", "left_semi").groupBy("set").agg(F.first("hashes").alias("hashes")), "shingles")
    found = shuffled(found)
    both = pairs.join(found.select(F.col("set").alias("a"), F.col("hashes").alias("set_a")), "a").join(
        found.select(F.col("set").alias("b"), F.col("hashes").alias("set_b")), "b")

    same = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(same >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - same)).select("a", "b")


def op2_simhash(spark: SparkSession, d: str) -> DataFrame:
    """All ``documents`` by 4-word shingles, linked at 4 or fewer differing bits."""
    return near_duplicates(documents(spark, d)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
