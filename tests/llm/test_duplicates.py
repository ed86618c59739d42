import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from itemlens.llm import components, credentials, simhash, substrings
from tests.llm.conftest import ODD


def plain_simhash(text, words=4):
    found = (text or "").encode().lower().split()
    shingles = [b" ".join(found[k:k + words]) for k in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    parent = {x: x for x in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in linked:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    return {x: top(x) for x in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    r = random.Random(3)
    links = {"path": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(80)],
             "random": [(r.randrange(150), r.randrange(150)) for _ in range(110)]}[shape] + [(7, 7)]
    want = groups({x for l in links for x in l}, links)
    got = dict(tuple(x) for x in components.components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {x: t for x, t in want.items() if any(x in l and l[0] != l[1] for l in links)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("bits,segment", [(4, 2), (4, 4), (3, 1), (8, 2), (11, 1)])
def test_range_join_finds_every_pair_once(spark, bits, segment):
    r = np.random.default_rng(bits)
    found = {0, -1, 1}
    for b in r.integers(-2**63, 2**63 - 1, 40).tolist():
        for _ in range(15):
            for _ in range(int(r.integers(0, bits + 2))):
                b ^= 1 << int(r.integers(0, 63))
            found.add(b)
    xs = np.array(sorted(found), np.int64)
    near = np.bitwise_count(xs.view(np.uint64)[:, None] ^ xs.view(np.uint64)[None, :]) <= bits
    want = {(int(xs[i]), int(xs[j])) for i, j in zip(*np.nonzero(np.triu(near, 1)))}
    got = [tuple(x) for x in simhash.near_pairs(spark.createDataFrame([(int(x),) for x in xs], "fp long"), bits, segment).collect()]
    assert len(got) == len(want) and set(got) == want


def plan(df):
    """The plan that ``df`` was run by, with what Spark changed on the way."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_fingerprints_are_never_broadcast(spark, tmp_path):
    """Spark takes the fifty cells of a fingerprint for one row: a table that it calls small may be more than the driver holds."""
    spark.createDataFrame([(k, k * 0x9E3779B97F4A7C15 % 2**62) for k in range(300)], "doc_id long, fp long").write.parquet(f"{tmp_path}/fps")
    fps = spark.read.parquet(f"{tmp_path}/fps")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    pairs = simhash.near_pairs(nodes, 4)
    assert "Generate" in plan(pairs) and "Broadcast" not in plan(pairs)
    joins = [x for x in plan(simhash.with_components(fps, nodes, pairs, "doc_id")).splitlines() if "Join" in x]
    assert "SortMergeJoin [fp" in joins[0], joins  # rows with their classes


def test_near_duplicates_by_brute_force(spark, docs_of):
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(120)] for _ in range(12)]
    pairs = [*ODD]
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = r.choice(words)
        pairs.append((100 + i, " ".join(w).upper() if i % 5 == 0 else "  ".join(w)))
    fps = [(i, plain_simhash(t)) for i, t in pairs]
    distinct = sorted({f for _, f in fps})
    top = groups(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for i, f in fps:
        if i is not None:
            least[top[f]] = min(least.get(top[f], i), i)
    got = simhash.near_duplicates(docs_of(pairs)).collect()
    assert sorted((x.doc_id or -1, x.fp % (1 << 64), x.component_id or -1) for x in got) == sorted(
        (i or -1, f, least.get(top[f]) or -1) for i, f in fps)
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_similar_documents_by_shingles(spark, docs_of):
    r = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    text = [r.choice(words) for _ in range(200)]
    near, far = list(text), list(text)
    near[50] = "other"
    far[::12] = ["other"] * len(far[::12])  # about half of the shingles
    pairs = [(1, " ".join(text)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(text)), (5, "alone"), (6, None), (None, "x y")]
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(docs_of(pairs)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6, None: None}


def test_a_repeated_line_makes_no_duplicates(spark, docs_of):
    r = random.Random(7)
    line = " ".join(f"line{k}" for k in range(9)) + "\n"
    texts = [line * 180 + " ".join(f"w{r.randrange(10**6)}" for _ in range(400)) for _ in range(6)]
    assert len({simhash.simhash(simhash.shingle_hashes(t, 5)) for t in texts}) < 6  # counted with repeats, they look alike
    copy = texts[0] + "\n" + line * 60  # the same set but for a few shingles at the seam
    pairs = [*((k + 1, t) for k, t in enumerate(texts)), (7, copy), (None, texts[1]), (7, texts[2])]  # one id, two texts
    got = sorted((x.doc_id or -1, x.component_id or -1) for x in simhash.similar_documents(docs_of(pairs)).collect())
    assert got == sorted([(-1, 2), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 1), (7, 3)])


def test_rows_that_share_an_id_are_rows_of_their_own(spark, docs_of):
    r = random.Random(13)
    a, b, c, d, e = (" ".join(f"w{r.randrange(10**6)}" for _ in range(80)) for _ in range(5))
    near = " ".join([*a.split()[:79], "other"])
    rows = [(1, a), (7, a), (7, b), (8, c), (8, d), (8, d), (None, e), (None, e), (None, near), (None, c + " more"), (9, None), (10, ""), (None, "")]
    got = sorted(((x.doc_id or -1, x.text) for x in simhash.without_near_duplicates(docs_of(rows)).collect()), key=repr)
    assert got == sorted([(1, a), (7, b), (8, c), (8, d), (-1, e), (9, None)], key=repr)
    assert simhash.without_near_duplicates(docs_of([])).count() == 0


def test_simhashes_link_similar_documents(spark, docs_of, monkeypatch):
    """Without any pair from the bands, texts whose SimHashes are near are compared and linked, those of one SimHash too, and sets decide."""
    r = random.Random(21)
    rows, want = [], {}
    for group in range(8):
        words = [f"g{group}w{r.randrange(10**6)}" for _ in range(900)]
        near = [*words[:899], "other"]
        a, b = (simhash.simhash(np.unique(simhash.shingle_hashes(" ".join(x), 5))) for x in (words, near))
        assert ((a ^ b) % (1 << 64)).bit_count() <= 4
        rows += [(3 * group, " ".join(words)), (3 * group + 1, " ".join(near)), (3 * group + 2, " ".join(words[:300]))]  # a third is too little
        want |= {3 * group: 3 * group, 3 * group + 1: 3 * group, 3 * group + 2: 3 * group + 2}
    none = spark.createDataFrame([], "a binary, b binary")
    monkeypatch.setattr(simhash, "stars", lambda *a: none)
    monkeypatch.setattr(simhash, "apart", lambda *a: none)
    assert {x.doc_id: x.component_id for x in simhash.similar_documents(docs_of(rows)).collect()} == want
    same = spark.createDataFrame([(b"c", 10, 5), (b"a", 10, 5), (b"b", 10, 5), (b"d", 100, 5), (b"e", 9, 7), (b"f", 10, -1)], "set binary, n int, fp long")
    found = {tuple(sorted(bytes(v).decode() for v in x)) for x in simhash.near_sets(same, 0.8, 4).collect()}
    assert found == {("a", "b"), ("a", "c"), ("a", "e")}


def test_no_plan_of_the_stage_is_large(spark, docs_of, monkeypatch, capsys):
    """The driver holds a plan, its stages and their metrics in memory: what is read several times is written first, not planned again and again."""
    r = random.Random(17)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = [(k, " ".join([*base[:k], *(f"x{k}y{j}" for j in range(3)), *base[k:]])) for k in range(0, 120, 10)] + [(200, "alone"), (201, None)]
    lines = {}

    def seen(of, name):
        run = getattr(of, name)

        def planned(df, *args):
            capsys.readouterr()
            df.explain()
            lines[f"{name} {len(lines)} {args}"] = capsys.readouterr().out.count("\n")
            return run(df, *args)
        monkeypatch.setattr(of, name, planned)

    for of in (simhash, components):
        seen(of, "checkpointed")
    seen(simhash, "stored")
    kept = simhash.without_near_duplicates(docs_of(rows))
    assert {x.doc_id for x in kept.collect()} == {0, 200, 201}
    assert len(lines) > 12 and max(lines.values()) <= 110, lines


def test_groups_against_all_pairs(spark, docs_of):
    """A large group whose members are not all like its least one, small groups, and texts that share much but too little."""
    r = random.Random(14)
    texts = []
    for group in range(12):
        base = [f"g{group}w{r.randrange(400)}" for _ in range(120)]
        for _ in range(60 if group == 0 else 4):
            own = list(base)
            for _ in range(r.randrange(6)):
                own[r.randrange(120)] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(own))
    pairs = list(enumerate(texts))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    want = {i: top(i) for i in range(len(texts))}
    assert len({x for x in want.values()}) > 13
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(docs_of(pairs)).collect()}
    assert got == want
    left = {x.doc_id for x in simhash.without_near_duplicates(docs_of(pairs)).collect()}
    assert left == {i for i, t in want.items() if i == t}


@pytest.mark.parametrize("same", [178, 182, 190])  # similarities of 0.802, 0.835 and 0.905 of 200 shingles each
def test_isolated_similar_pairs_are_candidates(same):
    r = np.random.default_rng(same)
    met = 0
    for _ in range(300):
        x = r.integers(0, 2**64, 400 - same, dtype=np.uint64)
        a, b = np.unique(x[:200]), np.unique(np.append(x[:same], x[200:]))
        met += bool((simhash.set_sketch(a)[0] == simhash.set_sketch(b)[0]).any())
    assert met >= 298


def test_sketches_let_similar_sets_through(spark):
    """All but a few in a thousand at the similarity, hardly any of a much smaller one."""
    r = np.random.default_rng(5)

    def through(shared, count=300):
        rows = []
        for _ in range(count):
            x = r.integers(0, 2**64, 400 - shared, dtype=np.uint64)
            a, b = np.unique(x[:200]), np.unique(np.append(x[:shared], x[200:]))
            rows.append((simhash.set_sketch(a)[1].tolist(), simhash.set_sketch(b)[1].tolist()))
        frame = spark.createDataFrame(rows, "a array<long>, b array<long>")
        return frame.where(simhash.may_be_alike("a", "b", 0.8)).count()

    assert through(178) >= 298 and through(190) == 300  # similarities of 0.802 and 0.905
    assert through(150) < 10 and through(100) == 0  # of 0.6 and 0.333


def sets_like(r, shared, count):
    """Sets of 200 hashes each of which has ``shared`` in common with every other one."""
    common = r.integers(0, 2**64, shared, dtype=np.uint64)
    return [np.unique(np.append(common, r.integers(0, 2**64, 200 - shared, dtype=np.uint64))) for _ in range(count)]


def as_cells(spark, sets):
    """All sets in band 1, as ``apart`` and ``stars`` take them, and their sketches."""
    rows = [(1, simhash.set_name(x), len(x), simhash.set_parity(x).tolist(), simhash.set_sketch(x)[1].tolist()) for x in sets]
    frame = spark.createDataFrame(rows, "band long, set binary, n int, parity array<long>, sketch array<long>")
    return frame.select("band", "set", "n", "parity"), frame.select("set", "sketch", "parity")


def test_a_group_not_alike_enough_makes_few_pairs(spark):
    """Of 1,770 pairs of a similarity of 0.75 sketches alone let most through; of 0.81 hardly one is missed."""
    r = np.random.default_rng(6)
    for shared, least, most in ((171, 0, 18), (179, 1765, 1770)):
        cells, sketches = as_cells(spark, sets_like(r, shared, 60))
        assert cells.join(sketches.toDF("b", "sketch_b", "p"), cells["set"] < F.col("b")).join(sketches.select("set", "sketch"), "set").where(
            simhash.may_be_alike("sketch", "sketch_b", 0.8)).count() > 1000
        assert least <= simhash.apart(cells.select("band", "set", "n", F.col("set").alias("of")), sketches, 0.8).count() <= most


def test_least_and_greatest_set_of_a_band_meet_the_others(spark):
    sets = sets_like(np.random.default_rng(8), 185, 20)
    cells, _ = as_cells(spark, sets)
    names = sorted(simhash.set_name(x) for x in sets)
    want = {frozenset((end, x)) for end in (names[0], names[-1]) for x in names if x != end}
    assert {frozenset((bytes(x.a), bytes(x.b))) for x in simhash.stars(cells, 0.8).collect()} == want


def test_bands_are_never_broadcast(spark, tmp_path):
    """Spark takes the bands of a set for one row, and a stored table for its files, which a set that stands in many rows hardly adds to."""
    sets = sets_like(np.random.default_rng(8), 185, 20)
    rows = [(simhash.set_name(x), len(x), simhash.set_sketch(x)[0].tolist(), simhash.set_parity(x).tolist(), simhash.set_sketch(x)[1].tolist()) for x in sets]
    spark.createDataFrame(rows, "set binary, n int, bands array<long>, parity array<long>, sketch array<long>").write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"{tmp_path}/nodes")
    cells = simhash.shared_cells(nodes)
    assert "Generate" in plan(cells) and "Broadcast" not in plan(cells)
    cells.write.parquet(f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells")
    assert "Broadcast" not in plan(simhash.stars(cells, 0.8))
    pairs = simhash.apart(cells.select("band", "set", "n", F.col("set").alias("of")), nodes.select("set", "sketch", "parity"), 0.8)
    assert pairs.count() == 190 and "Broadcast" not in plan(pairs)


def test_rows_that_meet_places_are_never_broadcast(spark, docs_of):
    """What later stages of the pipeline store and look up has some numbers or lists of them for a row of the documents."""
    text = " ".join(f"w{k}" for k in range(40))
    docs = docs_of([(1, text), (2, text + " more"), (3, text + " key AKIA" + "Q" * 16 + " Abcdefghijklmnopqrst12"), (4, None), (5, "alone")])
    for df in (simhash.without_near_duplicates(docs), substrings.remove_repeats(docs, bits=12), credentials.scan(docs)):
        assert "Join" in plan(df) and "Broadcast" not in plan(df)


def test_parities_leave_no_similar_set_out(spark):
    """Sets of many sizes, right at the similarity, above and far below it, empty ones too."""
    r = np.random.default_rng(9)
    rows = []
    for _ in range(400):
        n = int(r.integers(0, 2500))
        m = n + int(r.integers(0, 1 + n // 8))
        both = n - int(r.integers(0, 1 + n // (6 if r.integers(2) else 1)))
        x = r.integers(0, 2**64, n + m - both, dtype=np.uint64)
        a, b = np.unique(x[:n]), np.unique(np.append(x[:both], x[n:]))
        alike = both >= 0.8 * (len(a) + len(b) - both)
        rows.append((len(a), len(b), simhash.set_parity(a).tolist(), simhash.set_parity(b).tolist(), bool(alike), both / max(1, n + m - both)))
    for n in (5, 45, 450, 900):  # the bound is met exactly: 8 of 10 parts in common
        x = r.integers(0, 2**64, 2 * n, dtype=np.uint64)
        a, b = np.unique(x[:9 * n // 5]), np.unique(x[n // 5:])
        rows.append((len(a), len(b), simhash.set_parity(a).tolist(), simhash.set_parity(b).tolist(), True, 0.8))
    got = spark.createDataFrame(rows, "n_a int, n_b int, a array<long>, b array<long>, alike boolean, s double").select(
        "alike", "n_a", "n_b", "s", simhash.differ_little("a", "b", 0.8).alias("passes")).collect()
    assert sum(x.alike for x in got) > 30 and all(x.passes for x in got if x.alike)
    far = [x for x in got if x.s < 0.6 and 100 < x.n_a < 1000 and 100 < x.n_b < 1000]
    assert len(far) > 10 and not any(x.passes for x in far)


def plain_repeats(pairs, n):
    own, top = {}, 1 << 62
    for i, t in pairs:
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            key = tuple(w[k:k + n])
            own[key] = min(own.get(key, top), top if i is None else i)
    out = []
    for i, t in pairs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if own[tuple(w[k:k + n])] < (top if i is None else i):
                gone[k:k + n] = [True] * n
        out.append((i or -1, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


def test_repeats_by_brute_force(spark, docs_of):
    r = random.Random(4)
    passages = [" ".join(r.choice("abcdefgh") + str(r.randrange(9)) for _ in range(r.randrange(5, 40))) for _ in range(12)]
    pairs = [*ODD, (5, "z " * 40)]
    for i in range(120):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(f"u{r.randrange(10**6)}" for _ in range(20)) for _ in range(r.randrange(1, 6))]
        pairs.append((i + 20, "\n".join(parts)))
    for bits in (12, 20):  # an overfull sketch lets more windows through and changes nothing
        got = substrings.remove_repeats(docs_of(pairs), 13, bits)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "id", "row", "fp", "h", "n_words", "n_removed"]
        assert sorted((x.doc_id or -1, x.n_words, x.n_removed, b" ".join((x.text or "").encode().split()).decode())
                      for x in got.collect()) == plain_repeats(pairs, 13)
    assert substrings.remove_repeats(docs_of([]), 13, 12).count() == 0


def test_cut_keeps_the_rest_as_it_is():
    text = "a  b\nc d e\tf g"
    assert substrings.cut(text, [], 2) == (text, 7, 0)
    assert substrings.cut(text, [2], 2) == ("a  b\ne\tf g", 7, 2)
    assert substrings.cut(text, [0, 5], 2) == ("c d e", 7, 4)
    assert substrings.cut(text, [3], 1) == ("a  b\nc e\tf g", 7, 1)


def test_queries(spark):
    d = "/root/testdata/sf0.001"
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = [(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in plain_repeats(pairs, 13)]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op4_repeats(spark, d).collect())
    assert got == want
    rows = simhash.op2_simhash(spark, d).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{plain_simhash(t):016x}" for i, t in pairs}
