import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from itemlens.llm import merkle
from tests.llm.conftest import ODD

COLS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute(rows):
    """[(id, leaf, subroot, root, proof, folded)] with plain lists, level by level."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def fold(nodes):  # every node is (digest, members); proofs and places are noted per member
        while len(nodes) > 1:
            runs = [nodes[i:i + 8] for i in range(0, len(nodes), 8)]
            for run in runs:
                for k, (_, members) in enumerate(run):
                    for m in members:
                        m["way"].append(([x for x, _ in run[:k]], [x for x, _ in run[k + 1:]]))
            nodes = [(H(*(x for x, _ in run)), [m for _, ms in run for m in ms]) for run in runs]
        return nodes[0]

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append({"row": r, "leaf": leaf(r), "way": []})
    tops = []
    for g in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        members = sorted(groups[g], key=lambda m: (m["row"][0] is not None, m["row"][0] or 0, m["leaf"]))
        subroot, _ = fold([(m["leaf"], [m]) for m in members])
        for m in members:
            m["subroot"] = subroot
        tops.append((subroot, members))
    root, _ = fold(tops)
    out = []
    for members in groups.values():
        for m in members:
            r = m["row"]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf((*r[:4], r[4].translate(lower) if hit and r[4] is not None else r[4]))
            for left, right in m["way"]:
                now = H(*left, now, *right)
            proof = H(*(x for left, right in m["way"] for x in left + right))
            out.append((r[0], m["leaf"], m["subroot"], root, proof, now, now == root))
    return out


def manifest(docs):
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(docs, COLS, tampered={"text": F.when(hit, text).otherwise(F.col("text"))})


def compare(spark, rows, parts=5):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("tree", F.lit(1)).withColumn("index", F.lit("x"))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, manifest(docs.repartition(parts)).collect()), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 100])
def test_one_group_of_each_size(spark, n):
    compare(spark, [(k, "s", "en", 3, f"Text {k}") for k in range(n)])


def test_nulls_ties_repeats_and_many_groups(spark):
    rows = [(i, None if k % 2 else "src", None if k % 3 else "en", None if t is None else len(t), t) for k, (i, t) in enumerate(ODD)]
    compare(spark, rows * 2 + [(100 + k, "s", f"lang{k % 75}é", k, "A b") for k in range(300)] + [(7, "s", "", 1, "empty name"), (7, "s", "-", 1, "")])


def test_more_rounds_than_one(spark, monkeypatch):
    """Blocks of 64 leaves: three rounds, with last blocks of one node."""
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "WIDTH", 64)
    for n in (64, 65, 513, 4097):
        compare(spark, [(k, "s", "en" if k < n else "de", 3, f"Text {k}") for k in range(n + 130)])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    out = manifest(docs)
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_a_changed_row_does_not_verify(spark):
    rows = [(k, "s", "en", 3, "Upper" if k % 2 else "lower") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    bad = {r.doc_id for r in manifest(docs).collect() if not r.verified}
    assert bad == {k for k in range(60) if k % 2 and zlib.crc32(str(k).encode()) % 3 == 0}
