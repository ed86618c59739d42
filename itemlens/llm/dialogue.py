"""Structure repair of conversations: cheapest edits that make roles alternate, by a Viterbi search that keeps survivors only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlens.llm.common import bounded, stored
from itemlens.session import table

NONE, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired conversation ends with
NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
GIVEN = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # after an inserted or re-roled turn
NAMES = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
# BEHIND[p][q]: whatever follows, going on from p costs at most so much more than going on from q
BEHIND = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))
LEGAL = {"su", "ua", "au"}


class Node:
    """An edge of the tree of survivors' pasts: the edits on it, and the edges that go on from it."""

    __slots__ = ("parent", "label", "children", "state")

    def __init__(self, parent, label: bytes, state=None):
        self.parent, self.label, self.children, self.state = parent, bytearray(label), [], state


class Survivors:
    """The cheapest way to every state, as leaves of one tree of edits.

    An edge whose last reference is gone goes, one with a single child is joined with it, and edits that all survivors share are
    handed to ``audit``: what is held is the part of the past on which survivors differ, a byte an edit. Of ways that cost the same the least
    in ASCII order stays. They take the same rows, so neither is the beginning of the other: an inserted turn costs something,
    and edits tell the roles. So whole unresolved pasts are compared and no later edit can turn the order.
    """

    def __init__(self, start: int = NONE):
        self.root = Node(None, b"", start)
        self.leaves, self.cost, self.audit = {start: self.root}, {start: 0}, bytearray()

    def less(self, a: Node, x: bytes, b: Node, y: bytes) -> bool:
        """Is the past of leaf ``a`` and then ``x`` before that of ``b`` and then ``y``?"""
        if a is b:
            return x < y
        ways = []
        for node in (a, b):
            way = []
            while node is not None:
                way.append(node)
                node = node.parent
            ways.append(way[::-1])
        k = 0
        while k < min(map(len, ways)) and ways[0][k] is ways[1][k]:
            k += 1
        left, right = ([n.label for n in way[k:]] + [end] for way, end in zip(ways, (x, y)))
        if left[0].startswith(right[0]) or right[0].startswith(left[0]):
            return b"".join(left) < b"".join(right)
        return left[0] < right[0]

    def best(self, choices: Iterable[tuple[int, Node, bytes]]):
        out = None
        for cost, leaf, label in choices:
            if out is None or cost < out[0] or cost == out[0] and self.less(leaf, label, out[1], out[2]):
                out = (cost, leaf, label)
        return out

    def advance(self, moves: dict[int, list[tuple[int, int, bytes]]]) -> None:
        """On to the states that are keys of ``moves``: lists of (state before, cost, edits)."""
        chosen = {}
        for state, ways in moves.items():
            found = self.best((self.cost[p] + c, self.leaves[p], label) for p, c, label in ways if p in self.leaves)
            if found:
                chosen[state] = found
        for state in list(chosen):  # a way that another one beats whatever follows is not a survivor
            if any(chosen[p][0] + BEHIND[p][state] < chosen[state][0] for p in chosen):
                del chosen[state]
        old = list(self.leaves.values())
        self.leaves, self.cost = {}, {}
        for leaf in old:
            leaf.state = None
        for state, (cost, leaf, label) in chosen.items():
            self.leaves[state] = node = Node(leaf, label, state)
            leaf.children.append(node)
            self.cost[state] = cost
        for leaf in old:
            self.release(leaf)
        self.emit()

    def release(self, node: Node) -> None:
        """Take out ``node`` if nothing refers to it any more, or join it with its only child."""
        while node.parent is not None and node.state is None and len(node.children) < 2:
            if not node.children:
                gone, node = node, node.parent
                node.children.remove(gone)
                gone.parent = None
                continue
            child = node.children[0]
            node.label += child.label
            node.children, node.state = child.children, child.state
            child.parent, child.children, child.state = None, [], None
            for c in node.children:
                c.parent = node
            if node.state is not None:
                self.leaves[node.state] = node

    def emit(self) -> None:
        while self.root.state is None and len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            self.audit += self.root.label
            self.root.label = bytearray()

    def past(self, leaf: Node) -> bytes:
        labels = []
        while leaf is not None:
            labels.append(leaf.label)
            leaf = leaf.parent
        return bytes(self.audit) + b"".join(labels[::-1])

    def row(self, initial: str, cut: bool, doomed: bool) -> None:
        """One row: turns may be inserted before it; it is kept, given another role or deleted (``doomed``: deleted)."""
        moves: dict[int, list] = {}
        for start in self.leaves:
            state, cost, label = start, 0, b""
            for _ in range(3):  # two inserted turns lead back to where one was
                moves.setdefault(state, []).append((start, cost + DELETE, label + b"D"))
                if not doomed:
                    if (state, initial) in NEXT:
                        moves.setdefault(NEXT[state, initial], []).append((start, cost + CUT * cut, label + b"K"))
                    moves.setdefault(GIVEN[state], []).append((start, cost + REROLE + CUT * cut, label + b"R"))
                state, cost, label = GIVEN[state], cost + INSERT, label + b"I"
        self.advance(moves)

    def end(self) -> tuple[int, str]:
        """(cost, all edits) of the cheapest way to a complete conversation."""
        closing = {NONE: (0, b""), ASSISTANT: (0, b""), USER: (INSERT, b"I"), SYSTEM: (2 * INSERT, b"II")}
        cost, leaf, label = self.best((c + closing[q][0], self.leaves[q], closing[q][1]) for q, c in self.cost.items())
        return cost, (self.past(leaf) + label).decode()

    def exits(self, start: int) -> list[dict]:
        return [{"start": start, "stop": q, "cost": c, "audit": self.past(self.leaves[q])} for q, c in self.cost.items()]


def prepared(convs: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, mark, blank, cut) of all rows; null role and text are one space. ``mark``: 128 bits of the text's SHA-256."""
    rows = convs.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), *[
        F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(name) for c, name in ((role, "role"), (text, "text"))])
    end = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    return rows.withColumn("mark", F.substring(F.unhex(F.sha2("text", 256)), 1, 16)).withColumn("blank", end == "").withColumn(
        "cut", ~F.substring(end, -1, 1).isin(".", "!", "?"))


def marked(rows: DataFrame, text: bool = False) -> DataFrame:
    """(conv, turn, role, mark, blank, cut, n, first, text): equal rows of a turn as one with their number ``n``; right after the one that is the first
    of its role and text in its conversation comes a row ``first``, which has the text if asked for. All sums are merged before they shuffle."""
    each = rows.groupBy("conv", "turn", "role", "mark", "blank", "cut").agg(F.count("*").alias("n")).withColumn("first", F.lit(False)).withColumn(
        "text", F.lit(None).cast("string"))
    least = F.min(F.struct(F.col("turn").isNotNull(), "turn"))["turn"].alias("turn")
    firsts = rows.where(~F.col("blank")).groupBy("conv", "role", "mark").agg(least, *([F.min("text").alias("text")] if text else [])).select(
        "conv", "turn", "role", "mark", F.lit(False).alias("blank"), F.lit(False).alias("cut"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("first"),
        F.col("text") if text else F.lit(None).cast("string").alias("text"))
    return each.unionByName(firsts)


ORDER = ["conv", "turn", "role", "mark", "first"]


def copies(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict]:
    """The counted rows, each with ``fresh`` and ``text`` of the row that follows if that says it is the first of its kind."""
    held = None
    for batch in batches:
        for row in pa.Table.from_batches([batch]).select(names).to_pylist():
            if row.get("first"):
                held["fresh"], held["text"] = True, row.get("text")
                continue
            if held:
                yield held
            held = row | {"fresh": False}
    if held:
        yield held


COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
SEGMENT = ("conv {kind}, part int, whole boolean, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, "
           "first string, last string, cost long, audit string, moves array<struct<start int, stop int, cost int, audit binary>>")


class Segment:
    """What one partition has of a conversation: counts, and the search from one state or from every state."""

    def __init__(self, conv, starts):
        self.conv, self.runs = conv, {s: Survivors(s) for s in starts}
        self.count = dict.fromkeys(COUNTS, 0)
        self.first = self.last = self.low = self.high = None

    def add(self, row: dict) -> None:
        initial, n = row["role"][:1], row["n"]
        kept = row["fresh"] and not row["blank"]
        self.count["blank"] += n if row["blank"] else 0
        self.count["duplicate"] += 0 if row["blank"] else n - kept
        self.count["truncated"] += bool(kept and row["cut"])
        self.count["illegal"] += n - 1  # a role after itself
        if self.last is not None:
            self.count["illegal"] += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.last = initial
        if row["turn"] is not None:
            self.count["turns"] += self.high != row["turn"]
            self.low, self.high = row["turn"] if self.low is None else self.low, row["turn"]
        for run in self.runs.values():
            for k in range(n):
                run.row(initial, row["cut"], k > 0 or not kept)

    def out(self, part: int, whole: bool) -> dict:
        cost, audit = self.runs[NONE].end() if whole else (None, None)
        moves = None if whole else [m for s, run in self.runs.items() for m in run.exits(s)]
        return {"conv": self.conv, "part": part, "whole": whole, **self.count, "low": self.low, "high": self.high, "first": self.first,
                "last": self.last, "cost": cost, "audit": audit, "moves": moves}


def arrow_schema(text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(text), prefers_large_types=False)


def segments(rows: DataFrame) -> DataFrame:
    """Conversations, and the parts of those that a partition may share with another.

    Rows are range partitioned by conversation and place, so a long conversation lies in many tasks. Of the first conversation of a partition
    it is not known what came before: its search starts from every state, and the ways from each state to each are kept.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    schema, names = SEGMENT.format(kind=kind), [*ORDER, "blank", "cut", "n"]
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, done, first = TaskContext.get().partitionId(), None, [], True
        for row in copies(batches, names):
            if now is None or now.conv != row["conv"]:
                if now:
                    done.append(now.out(part, not first))
                    first = False
                    if len(done) >= 1000:
                        yield pa.RecordBatch.from_pylist(done, schema=target)
                        done = []
                now = Segment(row["conv"], [NONE] if not first or now else range(4))
            now.add(row)
        if now:
            done.append(now.out(part, False))
            yield pa.RecordBatch.from_pylist(done, schema=target)

    return rows.select(*names).repartitionByRange(*ORDER[:4]).sortWithinPartitions(*ORDER).mapInArrow(run, schema)


def joined(parts: DataFrame) -> DataFrame:
    """The parts of conversations (rows of ``segments``) put together, in the same columns."""
    schema = SEGMENT.format(kind=parts.schema["conv"].dataType.simpleString())
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = None, None

        def done():
            now["cost"], now["audit"] = runs.end()
            return pa.RecordBatch.from_pylist([now | {"whole": True, "moves": None}], schema=target)

        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                if now is None or now["conv"] != row["conv"]:
                    if now:
                        yield done()
                    now, runs = row, Survivors()
                else:
                    for c in COUNTS:
                        now[c] += row[c]
                    now["illegal"] += now["last"] + row["first"] not in LEGAL
                    now["turns"] -= now["high"] is not None and now["high"] == row["low"]
                    now["low"] = row["low"] if now["low"] is None else now["low"]
                    now["high"] = row["high"] if row["high"] is not None else now["high"]
                    now["last"] = row["last"]
                moves: dict[int, list] = {}
                for m in row["moves"]:
                    moves.setdefault(m["stop"], []).append((m["start"], m["cost"], m["audit"]))
                runs.advance(moves)
        if now:
            yield done()

    return parts.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(run, schema)


def repair(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost long, audit string) for every conversation with rows.

    Rows stand in the order of their turns, nulls first, then of role and of a hash of the text; null role and text are one space. The counts are
    of first faults, of turns missing and of neighbours whose roles' initials are none of su, ua, au. ``audit`` has the edits in order: K(eep),
    D(elete), I(nsert), R(erole), the cheapest that lead to roles of the form ``(s?(ua)+)?``, of equal ones the least in ASCII order.
    Blank and duplicate rows are deleted. The texts stay where they are: only a hash and marks are dealt out, in ranges, so that a
    conversation of any length is spread over tasks; parts of conversations are put together by the ways from each state to each.
    A null id is a conversation; an empty table gives an empty one; other columns are left out.
    """
    parts = stored(segments(marked(prepared(convs, conv, turn, role, text))), "segments")
    found = parts.where("whole").unionByName(joined(parts.where("NOT whole")))
    return found.select(F.col("conv").alias(conv), F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"),
                        "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def walked(audit: str, rows: Iterable[dict]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of every edit of ``audit`` on the counted ``rows``."""
    state, edits = NONE, iter(audit)

    def inserted(edit):
        nonlocal state
        while edit == "I":
            state = GIVEN[state]
            yield edit, NAMES[state], ""
            edit = next(edits, None)
        return edit

    for row in rows:
        for _ in range(row["n"]):
            edit = yield from inserted(next(edits))
            if edit == "K":
                state = NEXT[state, row["role"][:1]]
                yield edit, row["role"], row["text"]
            elif edit == "R":
                state = GIVEN[state]
                yield edit, NAMES[state], row["text"]
            else:
                yield edit, row["role"], ""
    yield from inserted(next(edits, None))


def _edited(convs: DataFrame, audits: DataFrame, names: tuple[str, str, str, str], finish, schema: str) -> DataFrame:
    """``finish(conv, edits)`` gives the result rows of a conversation from its (edit, role, text)s; a conversation passes through one task in order."""
    conv = names[0]
    rows = marked(prepared(convs, *names), text=True)
    lead = audits.select(F.col(conv).alias("conv"), F.col("audit"))
    sent = rows.withColumn("lead", F.lit(1)).unionByName(lead.withColumn("lead", F.lit(0)), allowMissingColumns=True)
    cols = ["conv", "lead", "audit", "role", "n", "first", "text"]
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = copies(batches, cols)
        head = next(rows, None)
        while head:
            after = None

            def own():
                nonlocal after
                for row in rows:
                    if not row["lead"]:
                        after = row
                        return
                    yield row

            yield from (pa.RecordBatch.from_pylist(some, schema=target) for some in finish(head["conv"], walked(head["audit"], own())))
            head = after

    return bounded(sent).repartition("conv").sortWithinPartitions("conv", "lead", *ORDER[1:]).select(*cols).mapInArrow(run, schema)


def repaired(convs: DataFrame, audits: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, role, text): the turns of the conversations after the edits of ``audits`` (a result of ``repair``), numbered from 0."""
    kind = convs.schema[conv].dataType.simpleString()

    def finish(name, edits):
        some, place = [], 0
        for edit, who, what in edits:
            if edit != "D":
                some.append({conv: name, "place": place, "role": who, "text": what})
                place += 1
                if len(some) >= 500:
                    yield some
                    some = []
        yield some

    return _edited(convs, audits, (conv, turn, role, text), finish, f"`{conv}` {kind}, place long, role string, text string")


def digests(convs: DataFrame, audits: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, repaired_sha256): the hash of the repaired ``role:text``, joined by line feeds; texts pass through it one by one."""
    kind = convs.schema[conv].dataType.simpleString()

    def finish(name, edits):
        state, some = hashlib.sha256(), False
        for edit, who, what in edits:
            if edit != "D":
                state.update((("\n" if some else "") + f"{who}:{what}").encode())
                some = True
        yield [{conv: name, "repaired_sha256": state.hexdigest()}]

    return _edited(convs, audits, (conv, turn, role, text), finish, f"`{conv}` {kind}, repaired_sha256 string")


def damaged(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of ``convs``, damaged by the CRC-32 of ``conv_id:turn`` modulo 20 (nulls: one space): 0 drops a row, 1 empties its text,
    2 removes full stops, 3 repeats the row, 4 makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = convs.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (
        F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("k"))
    return rows.where("k <> 0").withColumn("again", F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1)))).select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"))


def op12_dialogue(spark: SparkSession, d: str) -> DataFrame:
    """All ``conversations``, damaged and repaired."""
    convs = table(spark, d, "conversations")
    rows = damaged(convs)
    audits = stored(repair(rows), "audits")
    found = audits.join(digests(rows, audits).withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    every = convs.select(F.col("conv_id").alias("id")).distinct()
    none: dict[str, Column] = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(F.col("id").alias("conv_id"), *[
        F.coalesce(F.col(c), none.get(c, F.lit(0).cast("long"))).alias(c)
        for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")])


# one recursion step a row: the cheapest way to each of the states (n)one, (s)ystem, (u)ser, (a)ssistant
SQL_DIALOGUE = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)) AS b FROM conversations),
hit AS (SELECT *, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 20 AS k FROM keyed, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE k <> 0),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM hurt),
seen AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN body[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(role[1]) OVER (PARTITION BY c ORDER BY pos) || role[1] AS pair FROM rows_),
facts AS (SELECT c, any_value(conv_id) AS conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM seen GROUP BY c),
put AS (SELECT q, g, x, l, replace(replace(t, 'U', chr(10) || 'user:'), 'A', chr(10) || 'assistant:') AS t FROM (VALUES
    ('n', 'n', 0, '', ''), ('n', 'u', 2, 'I', 'U'), ('n', 'a', 4, 'II', 'UA'), ('s', 's', 0, '', ''), ('s', 'u', 2, 'I', 'U'), ('s', 'a', 4, 'II', 'UA'),
    ('u', 'u', 0, '', ''), ('u', 'a', 2, 'I', 'A'), ('u', 'u', 4, 'II', 'AU'), ('a', 'a', 0, '', ''), ('a', 'u', 2, 'I', 'U'), ('a', 'a', 4, 'II', 'UA')) v(q, g, x, l, t)),
moves AS (SELECT * FROM (VALUES ('n', 'K', 's', 's'), ('n', 'K', 'u', 'u'), ('s', 'K', 'u', 'u'), ('u', 'K', 'a', 'a'), ('a', 'K', 'u', 'u'),
    ('n', 'R', '', 'u'), ('s', 'R', '', 'u'), ('u', 'R', '', 'a'), ('a', 'R', '', 'u'), ('n', 'D', '', 'n'), ('s', 'D', '', 's'), ('u', 'D', '', 'u'), ('a', 'D', '', 'a')) v(g, e, initial, z)),
w AS (SELECT c, 0::BIGINT AS pos, 'n' AS q, {'x': 0, 'a': '', 't': ''} AS best FROM facts
  UNION ALL
  SELECT w.c, any_value(s.pos), z, min({'x': best.x + put.x + CASE e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN fault = 'truncated' AND e <> 'D' THEN 1 ELSE 0 END,
      'a': best.a || l || e, 't': best.t || put.t || CASE e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text
        ELSE chr(10) || CASE z WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text END})
  FROM w JOIN seen s ON s.c = w.c AND s.pos = w.pos + 1 JOIN put ON put.q = w.q JOIN moves m ON m.g = put.g
  WHERE e = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR initial = role[1])) GROUP BY w.c, z),
ends AS (SELECT w.c, min({'x': best.x + put.x, 'a': best.a || l, 't': best.t || put.t}) AS best
  FROM w JOIN facts f ON f.c = w.c AND f.n = w.pos JOIN put ON put.q = w.q WHERE g = 'a' OR (g = 'n') GROUP BY w.c),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.x, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t[2:], '')) AS repaired_sha256
FROM every e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN ends USING (c)
"""
