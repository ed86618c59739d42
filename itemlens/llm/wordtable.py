"""Byte-level BPE by a table of distinct words: texts are split once, each distinct word is encoded once."""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlens.llm.common import blocks, bounded, documents, kept, strings
from itemlens.llm.packing import byte_alphabet
from itemlens.llm.pretokens import PreTokenizer, segments
from itemlens.session import ensure_checkpoint_dir

BLOCK = 32 << 20  # bytes of text that share a table of words


def library(path: str):
    """The tokenizer of a file, without threads of its own and without its truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


class Splitter:
    """Texts to words: the strings of added tokens, and between them the pre-tokens of the byte-level pattern.

    Character classes come from Python's tables. A part with a code point that these call unassigned (the library's tables may be
    newer) is split by the library itself.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            added = json.load(file).get("added_tokens", [])
        if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that look at their surroundings are not supported")
        self.tokenizer = library(path)
        self.pre = PreTokenizer()
        names = sorted((x["content"] for x in added), key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.names = set(names)
        every = range(0x110000)
        self.unknown = np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in every), bool, 0x110000)

    def known(self, text: str) -> bool:
        return text.isascii() or not self.unknown[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any()

    def parts(self, text: str) -> Iterator[str]:
        """The text cut at added tokens, and where it is long at places where a word surely begins."""
        for piece in self.added.split(text) if self.added and any(n in text for n in self.names) else (text,):
            if piece in self.names or len(piece) <= 1 << 20:
                yield piece
            else:
                yield from segments(piece)

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """All words of the texts in order, and how many each text has."""
        parts, owner = [], []
        for k, text in enumerate(texts):
            for part in self.parts(text):
                parts.append(part)
                owner.append(k)
        plain = [p if p not in self.names and self.known(p) else "" for p in parts]
        found, counts, at = [], np.zeros(len(texts), np.int64), 0
        while at < len(parts):  # about a million characters at a time
            end, held = at + 1, len(parts[at])
            while end < len(parts) and held + len(parts[end]) <= 1 << 20:
                held += len(parts[end])
                end += 1
            words, n = self.pre.slices(plain[at:end])
            first = 0
            for k, m in zip(range(at, end), n.tolist()):
                if parts[k] in self.names:
                    own = [parts[k]]
                elif parts[k] and not plain[k]:
                    own = [parts[k][a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(parts[k])]
                else:
                    own = words[first:first + m]
                first += m
                counts[owner[k]] += len(own)
                found += own
            at = end
        return found, counts


class Numbers(dict):
    """Words to numbers in the order they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def split(docs: DataFrame, path: str, id_col: str, text_col: str, size: int = BLOCK) -> DataFrame:
    """(block long, words array<string>, ids array, counts array<long>, places binary): one row for some ``size`` bytes of texts.

    ``words`` are the block's distinct words; ``places`` has for each word of its texts, one text after another, its number
    among them (compressed unsigned 32-bit), ``counts`` the words of each text. A text is never cut, so a block has one at least.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    df = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer, splitter = zstandard.ZstdCompressor(level=3), kept(f"word splitter {path}", lambda: Splitter(path))
        base, k = TaskContext.get().partitionId() << 32, 0
        table, ids, counts, places, held = Numbers(), [], [], [], 0

        def done():
            return pa.RecordBatch.from_arrays([
                pa.array([base + k], pa.int64()), pa.array([list(table)], pa.list_(pa.string())),
                pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids)),
                pa.array([np.concatenate(counts)], pa.list_(pa.int64())), pa.array([packer.compress(planes(np.concatenate(places)))], pa.binary())],
                names=["block", "words", "ids", "counts", "places"])

        for batch in blocks(batches, min(size, 1 << 19)):
            texts = strings(batch.column(1))
            words, n = splitter.words(texts)
            places.append(np.fromiter(map(table.__getitem__, words), np.uint32, len(words)))
            ids.append(batch.column(0))
            counts.append(n)
            held += sum(map(len, texts))
            if held >= size:
                yield done()
                k += 1
                table, ids, counts, places, held = Numbers(), [], [], [], 0
        if ids:
            yield done()

    return bounded(df).mapInArrow(run, f"block long, words array<string>, ids array<{kind}>, counts array<long>, places binary")


SHORT = 32  # longest word that is its own key
HELD = 1 << 19  # words of blocks that a task gathers before it sends them on


def keyed(word: Column) -> list[Column]:
    """A key of bounded length for each word, and the word itself where that is another."""
    is_long = F.length(word) > SHORT
    return [F.when(is_long, F.concat(F.lit("#"), F.sha2(word, 256))).otherwise(word).alias("key"), F.when(is_long, word).alias("long")]


def planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as their lowest bytes, then their second ones and so on, which compresses well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(block long, n int, data binary) from ``words`` (block, no, key, long): the ids of words, each distinct one encoded once.

    Equal words come one after another. What belongs to one block is sent on together: ``n`` words' numbers, their counts of ids and
    these ids, compressed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer, tokenizer = zstandard.ZstdCompressor(level=3), kept(f"word tokenizer {path}", lambda: library(path))
        held, rows, last, last_ids = [], 0, None, None

        def packs():
            block, no, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            flat = np.concatenate([x[3] for x in held])
            held.clear()
            order = np.lexsort((no, block))
            first, block, no = (np.cumsum(n) - n)[order], block[order], no[order]
            edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            out = []
            for a, b in zip(edges, np.append(edges[1:], len(block))):
                ids, sizes = gathered(flat, first[a:b], n[order[a:b]], np.arange(b - a))
                out.append((int(block[a]), int(b - a), packer.compress(planes(np.diff(no[a:b], prepend=0)) + planes(sizes) + planes(ids))))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], names=["block", "n", "data"])

        for batch in batches:
            for start in range(0, len(batch), 1 << 14):
                some = batch.slice(start, 1 << 14)
                coded = some.column(2).dictionary_encode()
                keys, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                full, longs = list(keys), some.column(3)
                for k in np.flatnonzero(longs.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    full[at[k]] = longs[k].as_py()
                known = 1 if keys and keys[0] == last else 0  # a word that the last rows had, too
                ids = [last_ids] * known + [x.ids for x in tokenizer.encode_batch_fast(full[known:], add_special_tokens=False)]
                last, last_ids = keys[-1], ids[-1]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat, n = gathered(np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), np.cumsum(sizes) - sizes, sizes, at)
                held.append((some.column(0).to_numpy(), some.column(1).to_numpy(), n, flat))
                rows += len(some) + len(flat) // 8
                if rows >= HELD:
                    yield packs()
                    rows = 0
        if held:
            yield packs()

    return words.repartition("key").sortWithinPartitions("key").select("block", "no", "key", "long").mapInArrow(run, "block long, n int, data binary")


def pieces(path: str) -> list[bytes]:
    """The bytes of every id of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    alphabet = byte_alphabet()
    added = {x["id"]: x["content"].encode() for x in data.get("added_tokens", [])}
    found = {k: bytes(alphabet[c] for c in token) for token, k in data["model"]["vocab"].items() if k not in added} | added
    return [found.get(k, b"") for k in range(max(found) + 1)]


class Pieces:
    """The id-to-piece table, joined to ids by their number."""

    def __init__(self, path: str):
        every = pieces(path)
        self.size = np.fromiter(map(len, every), np.int64, len(every))
        self.first, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(every), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all pieces one after another, bytes of each)"""
        return gathered(self.flat, self.first, self.size, ids)


def gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that ``at`` names, one after another, and their sizes."""
    n = size[at]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(first[at] - (ends - n), n)], n


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder in as many buckets of ``key`` as a shuffle has partitions: what is joined to it by
    ``key`` is shuffled to the buckets, and the table itself is not."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", f"{ensure_checkpoint_dir(spark)}/{name}").bucketBy(count, key).saveAsTable(name)
    return spark.table(name)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """(id, n_tokens long, ids binary, decoded binary): token ids of each whole text and the bytes that they stand for.

    Tasks split their texts into words and replace these by numbers in a table of each block's distinct words; the numbers stay where they are
    written, and the tables alone are shuffled, by word. Every distinct word of all blocks is encoded once, its ids go back to the
    blocks that have it, are joined with the id-to-piece table (as large as the vocabulary), and each text is put together
    by position. A word has at most one row a block, however frequent it is.
    ``ids`` are little-endian unsigned 32-bit. The strings of added tokens in a text are these tokens, as for the library. A null
    or empty text has no tokens. Repeated rows give a row each; null ids pass through; other columns are left out; an empty
    table gives an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    parts = bucketed(split(docs, path, id_col, text_col, size), "block", "words")
    words = parts.select("block", F.posexplode("words").alias("no", "word")).select("block", "no", *keyed(F.col("word")))
    packs = encode_words(words, path).groupBy("block").agg(F.collect_list(F.struct("n", "data")).alias("packs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        reader, table = zstandard.ZstdDecompressor(), kept(f"word pieces {path}", lambda: Pieces(path))
        for batch in batches:
            for row in range(len(batch)):
                names, counts, places, found = (batch.column(i)[row] for i in range(4))
                names, counts = names.values, counts.values.to_numpy(zero_copy_only=False)
                at = numbers(reader.decompress(places.as_py()))
                no, sizes, ids = [], [], []
                for pack in found.as_py() or []:
                    n, data = pack["n"], reader.decompress(pack["data"])
                    no.append(np.cumsum(numbers(data[:4 * n])))
                    sizes.append(numbers(data[4 * n:8 * n]).astype(np.int64))
                    ids.append(numbers(data[8 * n:]))
                one = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
                no, own, flat = one(no, np.int64), one(sizes, np.int64), one(ids, np.uint32)
                first, size = np.zeros(len(no), np.int64), np.zeros(len(no), np.int64)
                first[no], size[no] = np.cumsum(own) - own, own
                chars, lengths = table.join(flat)
                begins = np.append(0, np.cumsum(lengths))
                begin, length = begins[first], begins[first + size] - begins[first]
                edges, k = np.append(0, np.cumsum(counts)), 0
                while k < len(counts):  # some texts at a time
                    end = max(k + 1, int(np.searchsorted(edges, edges[k] + (1 << 17), "right")) - 1)
                    words = at[edges[k]:edges[end]]
                    tokens, n = gathered(flat, first, size, words)
                    text, m = gathered(chars, begin, length, words)
                    inner = edges[k:end + 1] - edges[k]
                    cuts, ends = np.append(0, np.cumsum(n))[inner], np.append(0, np.cumsum(m))[inner]
                    yield pa.RecordBatch.from_arrays([
                        names.slice(k, end - k), pa.array(np.diff(cuts)),
                        pa.array([tokens[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                        pa.array([text[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], names=[id_col, "n_tokens", "ids", "decoded"])
                    k = end

    return bounded(parts.join(packs, "block", "left")).select("ids", "counts", "places", "packs").mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary")


def op13_word_table(spark: SparkSession, d: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again; digests of both."""
    import public_tokenizers

    return round_trip(documents(spark, d), public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
