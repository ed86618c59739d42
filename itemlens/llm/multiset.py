"""Homomorphic document fingerprints: sums of wide vectors hashed from paragraphs."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlens.llm.common import blocks, bounded, documents, kept
from itemlens.llm.neighbours import in_order
from itemlens.llm.substrings import WordHashes

WIDE = 8  # lanes modulo 2^64 that tell multisets of paragraphs apart
SIGNS = 256  # lanes modulo 2^16 that tell how alike two are
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(wide, signs): the fingerprint of each text as a row of each array.

    A paragraph is what stands between line feeds, if not empty. It adds its hash, stretched over the wide lanes, and
    plus or minus one in each sign lane for each of its pieces. Pieces end where a word's hash says so (every eighth
    or so) or the paragraph does, so an edit changes only the pieces it touches.
    """
    import xxhash

    n = len(texts)
    wide, signs = np.zeros((n, WIDE), np.uint64), np.zeros((n, SIGNS), np.uint16)
    lines = [(k, line) for k, text in enumerate(texts) for line in text.split("\n") if line]
    if not lines:
        return wide, signs
    owner = np.fromiter((k for k, _ in lines), np.int64, len(lines))
    both = np.array([divmod(xxhash.xxh3_128_intdigest(line.encode()), 1 << 64) for _, line in lines], np.uint64)
    for lane in range(WIDE):
        np.add.at(wide[:, lane], owner, mixed(both[:, 0] + both[:, 1] * np.uint64(2 * lane + 1)))
    known = kept("words", WordHashes)
    split = [line.encode().split() for _, line in lines]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    x = np.fromiter((known[w] for ws in split for w in ws), np.uint64, int(sizes.sum()))
    if not len(x):
        return wide, signs
    last = np.zeros(len(x), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    last |= (x >> np.uint64(40)) & np.uint64(7) == 0
    stops = np.flatnonzero(last)
    starts = np.append(0, stops[:-1] + 1)
    place = np.arange(len(x)) - np.repeat(starts, stops - starts + 1)
    piece = np.add.reduceat(mixed(x + place.astype(np.uint64) * np.uint64(MIX[0])), starts)
    of = np.repeat(owner, sizes)[starts]
    for at in range(0, len(piece), 1 << 16):  # of many pieces some at a time
        some, docs = piece[at:at + (1 << 16)], of[at:at + (1 << 16)]
        words = np.stack([mixed(some * np.uint64(2 * k + 1) + np.uint64(MIX[0])) for k in range(SIGNS // 64)], axis=1)
        bits = np.unpackbits(words.view(np.uint8), axis=1)
        edges = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        ones = np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
        count = np.diff(np.append(edges, len(docs)))
        signs[docs[edges]] += (2 * ones - count[:, None]).astype(np.uint16)
    return wide, signs


def text_of(wide: np.ndarray, signs: np.ndarray) -> str:
    return base64.b64encode(wide.tobytes() + signs.tobytes()).decode()


def vectors_of(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    data = base64.b64decode(fingerprint)
    return np.frombuffer(data[: 8 * WIDE], np.uint64), np.frombuffer(data[8 * WIDE:], np.uint16)


def combined(first: str, second: str, sign: int = 1) -> str:
    """The fingerprint of both texts' paragraphs together; with sign -1 without those of the second."""
    a, b = vectors_of(first), vectors_of(second)
    return text_of(*((x + y if sign > 0 else x - y) for x, y in zip(a, b)))


def likeness(a: tuple, b: tuple) -> float:
    """Shared pieces over all pieces (Tanimoto on piece counts), estimated from the sign lanes; 1 for equal ones."""
    if np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    x, y = a[1].view(np.int16).astype(np.float64), b[1].view(np.int16).astype(np.float64)
    dot = float(x @ y)
    rest = float(x @ x) + float(y @ y) - dot
    return min(max(dot / rest, 0.0), 1.0) if rest > 0 else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint string): each whole text's fingerprint.

    Texts of the same paragraphs in any order have the same one; ``combined`` inserts or deletes paragraphs without the
    text. A null or empty text has the neutral one, to which nothing was added. Repeated rows give a row each, an empty
    table gives an empty one, other columns are left out.
    """
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1 << 21):
            wide, signs = vectors(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([text_of(w, s) for w, s in zip(wide, signs)])], names=[id_col, "fingerprint"])

    return bounded(df).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text has the last quarter of the code points (floor) replaced by the first as many, or all, of the next
    document in ascending id; after the last comes the first, which may be the document itself. Its fingerprint comes
    from the document's by deleting the paragraphs after the cut and inserting the new ones. Null texts are empty, null
    ids come first, among equal ids the order is that of the texts' hash; an empty table gives an empty one.
    """
    low = F.lit(-(1 << 63)).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = in_order(df, F.coalesce(F.col("id").cast("long"), low), ring=True)
    rows = rows.sortWithinPartitions("#bucket", "#ghost", "#key", F.xxhash64("text")).select("id", "text", "#bucket", "#ghost")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (id, text, wide, signs, bucket): waits for its successor
        for batch in blocks(batches, 1 << 21):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            buckets, ghosts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            wide, signs = vectors(texts)
            done = []
            for i in range(len(ids)):
                if last is not None and last[4] == buckets[i]:
                    done.append((last, (ids[i], texts[i], wide[i], signs[i])))
                last = None if ghosts[i] else (ids[i], texts[i], wide[i], signs[i], buckets[i])
            if not done:
                continue
            edited, gone, come = [], [], []
            for (_, old, *_), (_, new, *_) in done:
                k = len(old) // 4
                cut = len(old) - k
                edited.append(old[:cut] + new[:k])
                kept_to = old.rfind("\n", 0, cut) + 1
                gone.append(old[kept_to:])
                come.append(edited[-1][kept_to:])
            minus, plus = vectors(gone), vectors(come)
            out = []
            for i, (a, b) in enumerate(done):
                own, other = (a[2], a[3]), (b[2], b[3])
                new = (own[0] - minus[0][i] + plus[0][i], own[1] - minus[1][i] + plus[1][i])
                out.append((a[0], len(a[1]), hashlib.sha256(edited[i].encode()).hexdigest(), text_of(*own), text_of(*new),
                            likeness(own, new), likeness(own, other)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=pa.schema(
                list(zip(names, [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]))))

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return bounded(rows).mapInArrow(run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                                "edited_fingerprint string, near_edited double, near_next double")


def op3_multiset(spark: SparkSession, d: str) -> DataFrame:
    """Every document of ``documents`` against its edited text and the next document."""
    return edit_likeness(documents(spark, d))
