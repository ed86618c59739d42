import corpus_pipeline
from itemlens.llm import queries


def test_stages_on_planted_cases(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rows = [tuple(r) for r in docs.collect()]
    base = max(rows, key=lambda r: len(r[1]) if len(r[1]) < 6000 else 0)
    passage = " ".join(f"shared{k}" for k in range(60))
    words = base[1].split()
    planted = [
        (900, base[1], base[2], "s", None), (901, " ".join([*words[:9], "changed", *words[10:]]), base[2], "s", None), (902, "123 456 !!", "en", "s", None),
        (903, None, None, None, None), (904, " ".join(sorted(words)) + "\n" + passage, base[2], "s", None),
        (905, " ".join(words[::-1]) + "\n" + passage + " password=abcdefgh1", base[2], "s", None)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema)).withColumn("row", docs["doc_id"])
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
            assert docs.where("n_chars <> length(text)").count() == 0 or k < 2
    assert {902, 903} & set(seen["language"]) == set() and set(seen["language"]) >= {900, 901, 904, 905, base[0]}
    assert not {900, 901} & set(seen["near duplicates"]) and base[0] in seen["near duplicates"]
    assert passage in seen["repeated passages"][904] and "shared5" not in seen["repeated passages"][905]
    assert seen["secrets"][905].endswith("[secret]")
    assert docs.select("doc_id").distinct().count() == len(seen["secrets"])


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "repeated passages", "secrets", "packing"]
