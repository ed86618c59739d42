import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from itemlens.llm import dialogue
from itemlens.llm.dialogue import NONE, Survivors

SCHEMA = "conv_id long, turn long, role string, text string, mark string, n int, first string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    """[(initial, cut, doomed, fault)] of (role, text) rows in order."""
    out, seen = [], set()
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1], fault == "truncated", fault in ("blank", "duplicate"), fault))
    return out


def every_way(rows):
    """The cheapest audit by trying all edits, with at most two inserted turns in a row."""
    best = None
    inserts = ["", "u", "a", "uu", "ua", "au", "aa"]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        if sum(map(len, gaps)) > len(rows) + 2:
            continue
        for edits in itertools.product("DKua", repeat=len(rows)):
            cost, roles, audit = 2 * len(gaps[0]), gaps[0], "I" * len(gaps[0])
            for (initial, cut, doomed, _), edit, gap in zip(rows, edits, gaps[1:]):
                if edit != "D" and doomed:
                    break
                cost += {"D": 3, "K": 0}.get(edit, 2) + (cut and edit != "D") + 2 * len(gap)
                roles += ("" if edit == "D" else initial if edit == "K" else edit) + gap
                audit += ("R" if edit in "ua" else edit) + "I" * len(gap)
            else:
                if LEGAL.match(roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def plain(rows):
    """The cheapest audit by whole strings per state, nothing pruned."""
    def more(ways):
        out = dict(ways)
        for _ in range(2):
            for q, (c, a) in list(out.items()):
                t = dialogue.GIVEN[q]
                out[t] = min(out.get(t, (c + 2, a + "I")), (c + 2, a + "I"))
        return out

    ways = {NONE: (0, "")}
    for initial, cut, doomed, _ in rows:
        new = {}
        for q, (c, a) in more(ways).items():
            steps = [(q, c + 3, a + "D")]
            if not doomed:
                steps.append((dialogue.GIVEN[q], c + 2 + cut, a + "R"))
                if (q, initial) in dialogue.NEXT:
                    steps.append((dialogue.NEXT[q, initial], c + cut, a + "K"))
            for t, x, y in steps:
                new[t] = min(new.get(t, (x, y)), (x, y))
        ways = new
    ways = more(ways)
    return min(ways[q] for q in (NONE, dialogue.ASSISTANT) if q in ways)


def search(rows):
    run, widest = Survivors(), 0
    for initial, cut, doomed, _ in rows:
        run.row(initial, cut, doomed)
        held, todo = 0, [run.root]
        while todo:
            node = todo.pop()
            held += len(node.label)
            todo += node.children
        widest = max(widest, held)
    return run.end(), widest


def test_all_edits_of_short_conversations():
    r = random.Random(3)
    for n in (0, 1, 2, 3):
        for _ in range(25):
            rows = [(r.choice("suax"), r.random() < 0.3, r.random() < 0.25, "") for _ in range(n)]
            assert search(rows)[0] == every_way(rows) == plain(rows), rows


def test_long_conversations_with_ties():
    r = random.Random(4)
    for k in range(400):
        letters = r.choice(["ua", "suax", "uuas", "s", "xs", "uax"])
        rows = [(r.choice(letters), r.random() < 0.3, r.random() < r.choice([0.1, 0.6]), "") for _ in range(r.randrange(40))]
        assert search(rows)[0] == plain(rows), rows


def test_survivors_share_their_past():
    """What is held is bounded where survivors coalesce, and a byte an edit where ties keep them apart."""
    r = random.Random(5)
    fine = [("ua"[k % 2], r.random() < 0.3, r.random() < 0.1, "") for k in range(20_000)]
    assert search(fine)[1] < 400
    (cost, audit), widest = search([("u", False, False, "")] + [("s", False, False, "")] * 5000)
    assert widest < 3 * 5001 and len(audit) >= 5001


def test_parts_put_together_give_the_whole():
    r = random.Random(6)
    for _ in range(150):
        rows = [(r.choice("suax"), r.random() < 0.3, r.random() < 0.3, "") for _ in range(r.randrange(1, 40))]
        cuts = sorted(r.randrange(len(rows) + 1) for _ in range(3))
        whole = Survivors()
        for part in (rows[:cuts[0]], rows[cuts[0]:cuts[1]], rows[cuts[1]:cuts[2]], rows[cuts[2]:]):
            moves = {}
            for start in range(4):
                run = Survivors(start)
                for initial, cut, doomed, _ in part:
                    run.row(initial, cut, doomed)
                for m in run.exits(start):
                    moves.setdefault(m["stop"], []).append((start, m["cost"], m["audit"]))
            whole.advance(moves)
        assert whole.end() == plain(rows)


def brute(rows):
    """Contract columns of (conv, turn, role, text) rows, without damage."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest()))
        marks = faults([(role, text) for _, role, text in own])
        cost, audit = plain(marks)
        turns = [t for t, _, _ in own if t is not None]
        done, k, last = [], 0, None
        for edit in audit:
            nxt = "assistant" if last == "user" else "user"
            if edit == "I":
                done.append((nxt, ""))
            else:
                _, role, text = own[k]
                k += 1
                if edit == "D":
                    continue
                done.append((nxt if edit == "R" else role, text))
            last = {"u": "user", "a": "assistant", "s": "system"}[done[-1][0][0]]
        repaired = "\n".join(f"{a}:{b}" for a, b in done)
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        count = [m[3] for m in marks].count
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
                     pairs, cost, audit, hashlib.sha256(repaired.encode()).hexdigest(), done)
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        k = zlib.crc32(key.encode()) % 20
        row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        out += [] if k == 0 else [row] * (2 if k == 3 else 1)
    return out


def check(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, "x", 3, "y") for r in rows], SCHEMA).repartition(parts)
    audits = dialogue.repair(df)
    want = brute(rows)
    got = {r.conv_id: tuple(r)[1:] for r in audits.collect()}
    assert got == {c: w[:7] for c, w in want.items()}
    assert {r.conv_id: r.repaired_sha256 for r in dialogue.digests(df, audits).collect()} == {c: w[7] for c, w in want.items()}
    turns = {}
    for r in dialogue.repaired(df, audits).orderBy("place").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert turns == {c: w[8] for c, w in want.items() if w[8]}
    return got


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "A."), (1, 1, "assistant", "B."), (2, 0, "user", None), (3, None, "user", "x."), (3, None, None, "y?"), (3, 4, "assistant", "x."),
        (None, 0, "user", "Hi."), (None, None, "assistant", "Yo!"), (4, 0, "system", "S."), (4, 1, "user", "U"), (4, 1, "user", "U"), (4, 5, "", "no role."),
        (5, 2, "assistant", " \n\t "), (5, 3, "assistant", " \n\t "), (6, 0, "user", "w " * 200_000), (6, 1, "assistant", "!" * 300_000),
        (7, 0, "umbrella", "Kept by its initial."), (7, 1, "assistant", "no end  "), (8, 9, "assistant", "a."), (8, 9, "user", "a."), (8, 9, "user", "b.")]
    check(spark, rows)
    check(spark, rows * 3, 7)
    empty = spark.createDataFrame([], SCHEMA)
    assert dialogue.repair(empty).count() == 0 and dialogue.digests(empty, dialogue.repair(empty)).count() == 0


def test_a_long_conversation_is_spread_over_tasks(spark):
    r = random.Random(8)
    rows = [(1, k if r.random() < 0.9 else None, r.choice(["user", "assistant", "system", "tool"]), r.choice(["One.", "two", "", f"t{r.randrange(500)}."])) for k in range(4000)]
    rows += [(c, k, r.choice(["user", "assistant"]), f"{r.randrange(40)}.") for c in (0, 2, 3) for k in range(20)]
    df = spark.createDataFrame([(*x, "x", 3, "y") for x in rows], SCHEMA)
    parts = dialogue.segments(dialogue.marked(dialogue.prepared(df, "conv_id", "turn", "role", "text")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert parts.where("conv = 1").count() > 3
        check(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001"])
def test_query(spark, d):
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(damaged(rows))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r.conv_id: tuple(r)[1:] for r in dialogue.op12_dialogue(spark, d).collect()}
    assert got == {c: want[c][:8] if c in want else none for c, *_ in rows}


def test_query_with_lost_conversations(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {c} {t}.") for c in range(60) for t in range(3)] + [(c, None, None, None) for c in range(200, 260)] + [(None, 1, "user", "x.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    want = brute(damaged(rows))
    assert len(want) < len({r[0] for r in rows})
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = dialogue.op12_dialogue(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == {c: want[c][:8] if c in want else none for c, *_ in rows}
