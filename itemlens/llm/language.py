"""Language identification: the nearest of several centroids per language, by cosine of TF-IDF n-gram vectors."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemlens.llm.common import blocks, bounded, documents, kept

WIDTH = 1 << 13  # hashed n-grams of 1 to 3 code points
UNKNOWN = "und"
ENOUGH = 400  # characters from which on a text must be as near to a centroid as the sample was


def letter_table() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, bool)
    for c in range(sys.maxunicode + 1):
        out[c] = unicodedata.category(chr(c))[0] == "L"
    return out


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, count) of all n-grams of letters with a blank for whatever stands between, and which texts have letters."""
    letters = kept("letters", letter_table)
    joined = " " + " ".join(x.lower() for x in texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    is_letter = letters[points]
    lengths = np.fromiter((len(x.lower()) for x in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths + 1)  # each text with the blank before it
    x = np.where(is_letter, points, 32).astype(np.uint64)
    # of a run of blanks one stays
    stay = is_letter.copy()
    stay[1:] |= is_letter[:-1]
    stay[0] = True
    x, owner_of = x[stay], np.append(owner, len(texts) - 1)[stay]
    found = []
    code = np.zeros(len(x), np.uint64)
    for n in (1, 2, 3):
        code = code[: len(x) - n + 1] * np.uint64(0x110001) + x[n - 1:] + np.uint64(n)
        same = owner_of[: len(code)] == owner_of[n - 1:]
        if n == 1:
            same = same & (x != 32)
        gram = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)).astype(np.int64)
        found.append((owner_of[: len(code)] * WIDTH + gram)[same])
    counts = np.bincount(np.concatenate(found), minlength=0)
    at = np.flatnonzero(counts)
    has = np.zeros(len(texts), bool)
    has[np.append(owner, len(texts) - 1)[is_letter]] = True
    return at // WIDTH, at % WIDTH, counts[at], has


def unit_vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of length 1 per text (0 without letters): log-damped counts times inverse document frequency."""
    doc, gram, count, has = gram_counts(texts)
    w = np.log1p(count) * idf[gram]
    size = np.sqrt(np.bincount(doc, w * w, minlength=len(texts)))
    out = np.zeros((len(texts), WIDTH), np.float32)
    out[doc, gram] = w / np.maximum(size[doc], 1e-12)
    return out, has


def parts(batches, docs: int = 64) -> Iterator[pa.RecordBatch]:
    """Rows in blocks of bounded bytes and number, the text second."""
    for block in blocks(batches, 1 << 18):
        for at in range(0, len(block), docs):
            yield block.slice(at, docs)


def centroids(rows: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means, begun at the row nearest to the mean and then the rows least like those chosen."""
    def unit(x):
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    chosen = [int(np.argmax(rows @ rows.mean(0)))]
    for _ in range(min(k, len(rows)) - 1):
        best = (rows @ rows[chosen].T).max(1)
        nearest = int(np.argmin(best))
        if best[nearest] > 1 - 1e-6:
            break
        chosen.append(nearest)
    out = rows[chosen]
    for _ in range(rounds):
        of = np.argmax(rows @ out.T, axis=1)
        out = unit(np.stack([rows[of == j].mean(0) if (of == j).any() else out[j] for j in range(len(out))]))
    return out


class Model:
    """Inverse document frequencies, centroids with their languages in order, and the least cosine that is accepted."""

    def __init__(self, idf: np.ndarray, languages: list[str], vectors: np.ndarray, accept: np.ndarray):
        self.idf, self.languages, self.vectors, self.accept = idf, languages, vectors, accept


def fit(docs: DataFrame, per_language: int = 600, k: int = 4, slack: float = 0.5,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows of ``docs`` that have a language and a text.

    Document frequencies are counted over all of them. Centroids are clustered, one language a task, from at most
    ``per_language`` documents each: those of least hash of their id, the one bounded sample here. A text is too far
    from a language if its cosine is below ``slack`` times the 1 % quantile of the language's sample.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(WIDTH, np.int64), 0
        for batch in parts(batches):
            doc, gram, _, has = gram_counts(batch.column(1).to_pylist())
            seen += np.bincount(gram, minlength=WIDTH)
            n += int(has.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH + 1)), pa.array(np.append(seen, n))], names=["gram", "n"])

    df = bounded(known).select("id", "text").mapInArrow(frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    seen = np.zeros(WIDTH + 1)
    for gram, n in df.collect():  # WIDTH + 1 rows
        seen[gram] = n
    idf = np.log((1 + seen[WIDTH]) / (1 + seen[:WIDTH])) + 1

    totals = known.groupBy("lang").agg(F.count("*").alias("total"))
    place = F.xxhash64("id")
    share = F.pmod(place, F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = known.join(F.broadcast(totals), "lang").where(share * F.col("total") < 2 * per_language)  # one row a language
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(place, "id", F.xxhash64("text")))).where(
        F.col("rank") <= per_language).select("lang", "text")

    def cluster(key, group: pd.DataFrame) -> pd.DataFrame:
        rows, has = unit_vectors(group["text"].tolist(), idf)
        rows = rows[has]
        if not len(rows):
            return pd.DataFrame({"lang": [], "vector": [], "accept": []})
        found = centroids(rows, k)
        least = slack * float(np.quantile((rows @ found.T).max(1), 0.01))
        return pd.DataFrame({"lang": [key[0]] * len(found), "vector": [x.tolist() for x in found], "accept": least})

    learned = sorted(few.groupBy("lang").applyInPandas(cluster, "lang string, vector array<float>, accept double").collect(),
                     key=lambda r: (r[0], r[1]))  # k rows a language
    vectors = np.array([r[1] for r in learned], np.float32).reshape(len(learned), WIDTH)
    return Model(idf, [r[0] for r in learned], vectors, np.array([r[2] for r in learned]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(all columns of ``docs``, lang_pred string, score double, rejected boolean).

    The language of the nearest centroid and its cosine; of equal ones the first by name. ``rejected`` marks texts too
    far from it, and those without letters (null or empty ones too), which are ``und`` with score 0; so is all where
    nothing was learned. Columns of these names are replaced; repeated rows give a row each, an empty table an empty one.
    """
    df = bounded(docs).drop("lang_pred", "score", "rejected")
    names = df.columns
    rest = [c for c in names if c != text_col]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names) + ", lang_pred string, score double, rejected boolean"
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # k vectors of WIDTH a language; plain values need no import

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(**sent.value)
        for batch in parts(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            rows, has = unit_vectors(texts, known.idf)
            size = np.fromiter((min(len(x), ENOUGH) for x in texts), np.int64, len(texts))
            if len(known.languages):
                cos = rows @ known.vectors.T
                best = cos.argmax(1)
                score = np.where(has, np.clip(cos[np.arange(len(cos)), best], 0, 1), 0.0).astype(np.float64)
                lang = [known.languages[b] if h else UNKNOWN for b, h in zip(best, has)]
                # short texts cannot come near a centroid, so the bound grows with the root of their length
                least = known.accept[best] * np.sqrt(size / ENOUGH)
                rejected = ~has | (score < least)
            else:
                score, lang, rejected = np.zeros(len(texts)), [UNKNOWN] * len(texts), np.ones(len(texts), bool)
            held = dict(zip([rest[0] if rest else None, text_col, *rest[1:]], batch.columns))
            yield pa.RecordBatch.from_arrays(
                [*[held[c] for c in names], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                names=[*names, "lang_pred", "score", "rejected"])

    return df.select(*[f"`{c}`" for c in (rest[0], text_col, *rest[1:])]).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def op9_language(spark: SparkSession, d: str) -> DataFrame:
    """The language of all ``documents``, learned from those not held out."""
    docs = documents(spark, d, "doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
