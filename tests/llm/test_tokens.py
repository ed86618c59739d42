import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
import tiktoken

from itemlens.llm import bpe, packing
from itemlens.llm.pretokens import Encoder, PreTokenizer, segments
from tests.llm.conftest import ODD

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def own():
    ranks = bpe.read_ranks(RANKS)
    return Encoder(lambda piece: bpe.merged(piece.encode(), ranks))


def test_pretokens_are_those_of_the_pattern():
    import regex

    pattern, pre, r = regex.compile(public_tokenizers.PATTERN), PreTokenizer(), random.Random(5)
    letters = "a'strevmldlL 1\n\t  é.!’٣ 漢"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(4000)] + ["", "'", " 's", "''ll", "\n's", "x's's"]
    found, counts = pre.slices(texts)
    assert found == [m for t in texts for m in pattern.findall(t)]
    assert counts.tolist() == [len(pattern.findall(t)) for t in texts]


def test_every_code_point(own, library):
    for base in range(0, 0x30000, 8192):
        texts = [f"a{chr(c)}b 1{chr(c)}2" for c in range(base, base + 8192, 3) if not 0xD800 <= c < 0xE000]
        ids, counts = own.block(texts)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [library.encode_ordinary(t) for t in texts]


def test_long_texts_are_cut_where_a_pretoken_begins(own, library):
    text = ("It's  a\n test of words " * 400).strip()
    parts = list(segments(text, 1000))
    assert len(parts) > 5 and "".join(parts) == text
    assert [i for p in parts for i in library.encode_ordinary(p)] == library.encode_ordinary(text)
    assert list(segments("x" * 5000, 1000)) == ["x" * 5000]


def test_encode_and_decode_odd_texts(spark, docs_of, library):
    encoded = bpe.encode(docs_of(ODD), RANKS)
    assert encoded.columns == ["doc_id", "n_tokens", "ids", "offsets"]
    back = bpe.decode(encoded, RANKS, ["doc_id", "ids", "offsets", "n_tokens"]).collect()
    assert len(back) == len(ODD)
    want = sorted((i or -1, library.encode_ordinary(t or "")) for i, t in ODD)
    assert sorted((r.doc_id or -1, list(r.ids)) for r in back) == want
    texts = sorted((i or -1, (t or "").encode()) for i, t in ODD)
    assert sorted((r.doc_id or -1, bytes(r.decoded)) for r in back) == texts
    for r in back:
        tokens = [library.decode_single_token_bytes(i) for i in r.ids]
        assert list(r.offsets) == np.cumsum([0, *map(len, tokens)])[:-1].tolist()
    assert bpe.encode(docs_of([]), RANKS).count() == 0


def test_packing_is_one_stream(spark, docs_of):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    pairs = [*ODD, (9, "<|endoftext|> and more"), *((100 + i, f"doc {i} " * (i % 40)) for i in range(60))]
    rows = packing.pack(docs_of(pairs), JSON, 64, with_ids=True).collect()
    stream, fill = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length and 0 < r.length <= 64
        stream.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(fill) == list(range(len(fill)))
    for s, parts in fill.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or s == len(fill) - 1
    got = sorted((k[0] or -1, [i for _, p in sorted(v) for i in p]) for k, v in stream.items() if k[0] not in (4, None))
    want = sorted((i or -1, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in pairs if i not in (4, None))
    assert got == want
    assert sum(r.length for r in rows) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in pairs)
    assert packing.pack(docs_of([]), JSON).count() == 0


def test_two_tokenizer_files_agree(library):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    encoder, r = packing.encoding(JSON), random.Random(9)
    for _ in range(300):
        t = "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x3000), 10, 32, 39, 0x1F600])) for _ in range(r.randrange(80)))
        assert encoder.encode_ordinary(t) == tokenizer.encode(t, add_special_tokens=False).ids == library.encode_ordinary(t)


def test_query_digests(spark, library):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = bpe.op1_bpe(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_special_tokens_as_the_library_reads_them(spark, docs_of, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    texts = ["<|endoftext|> and more", "a<|endoftext|><|endoftext|>\n b ", "<|endoftext|>", "<|endoftext|", "plain  text", ""]
    pairs = list(enumerate(texts))
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in pairs}
    assert want[0] == [50256, 290, 517, 1]
    rows = packing.pack(docs_of(pairs), JSON, with_ids=True, special=True).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {i: len(x) for i, x in want.items()}
    assert {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in rows} == want
    docs_of(pairs).write.parquet(f"{tmp_path}/documents.parquet")
    for rows in (packing.op10_pack(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs_of(pairs), "")):
        assert {r.doc_id: r.doc_tokens for r in rows.collect()} == {i: len(x) for i, x in want.items()}


def test_packing_very_long_runs(spark, docs_of):
    from tokenizers import Tokenizer

    tokenizer, n = Tokenizer.from_file(JSON), 2_000_000
    pairs = [(k, c * n) for k, c in enumerate([" ", "\n", "x", "7", "!"])] + [(9, "a" + "\u00a0" * n + "<|endoftext|>")]
    rows = packing.pack(docs_of(pairs, 6), JSON, 1 << 22, special=True).groupBy("doc_id").agg({"doc_tokens": "max"}).collect()
    assert {r[0]: r[1] for r in rows} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in pairs}
