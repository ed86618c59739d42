import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from itemlens.llm import wordtable
from tests.llm.conftest import ODD

JSON = public_tokenizers.path("byte_bpe_50k.json")
SPECIAL = ["<|endoftext|> and more", "a<|endoftext|><|endoftext|>\n b ", "<|endoftext|>", "<|endoftext|", " <|endoftext|>'s", "x \n\n <|endoftext|>  y"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def check(rows, pairs, library):
    want = sorted((i or -1, library.encode(t or "", add_special_tokens=False).ids) for i, t in pairs)
    assert sorted((r.doc_id or -1, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in rows) == want
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == sorted((i, len(x)) for i, x in want)
    back = sorted((i, library.decode(x, skip_special_tokens=False).encode()) for i, x in want)
    assert sorted((r.doc_id or -1, bytes(r.decoded)) for r in rows) == back


def test_odd_texts_and_added_tokens(spark, docs_of, library):
    pairs = [*ODD, *((20 + k, t) for k, t in enumerate(SPECIAL))]
    found = wordtable.round_trip(docs_of(pairs), JSON, size=300)
    assert found.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    check(found.collect(), pairs, library)
    assert wordtable.round_trip(docs_of([]), JSON).count() == 0


def test_very_long_texts(spark, docs_of, library):
    n = 2_000_000
    pairs = [(1, " " * n), (2, "\n" * n), (3, "x" * n), (4, "7" * n), (5, "!" * n), (6, "words of a long text. " * (n // 20))]
    check(wordtable.round_trip(docs_of(pairs, 6), JSON).collect(), pairs, library)


def test_every_code_point(library):
    """Also those that are newer than Python's tables."""
    splitter = wordtable.Splitter(JSON)
    for base in range(0, 0x32000, 4096):
        texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}" for c in range(base, base + 4096) if not 0xD800 <= c < 0xE000]
        if not texts:
            continue
        words, counts = splitter.words(texts)
        cuts = np.append(0, np.cumsum(counts))
        for k in range(0, len(texts), 1 if base in (0, 0x1000, 0xA000, 0x10000) else 7):
            own = words[cuts[k]:cuts[k + 1]]
            assert own == [texts[k][a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(texts[k])]


def test_a_word_is_encoded_once(spark, docs_of, monkeypatch):
    docs = docs_of([(k, f"the same words and {k}") for k in range(50)])
    parts = wordtable.split(docs, JSON, "doc_id", "text", 100)
    assert parts.count() > 5
    words = [w for r in parts.collect() for w in r.words]
    rows = parts.select("block", F.posexplode("words").alias("no", "word")).select("block", "no", *wordtable.keyed(F.col("word")))
    seen = spark.sparkContext.accumulator(0)

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, words, **how):
            seen.add(len(words))
            return self.tokenizer.encode_batch_fast(words, **how)

    library = wordtable.library
    monkeypatch.setattr(wordtable, "library", lambda path: Counted(library(path)))
    monkeypatch.setattr(wordtable, "kept", lambda _, make: make())
    assert sum(r.n for r in wordtable.encode_words(rows, JSON).collect()) == len(words)
    assert seen.value == len(set(words)) < len(words)


def test_query_digests(spark, library):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = wordtable.op13_word_table(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
