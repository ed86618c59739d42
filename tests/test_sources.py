"""Readers and writers on small landed files."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from itemlens import constants as K
from itemlens.operators import matching as M
from itemlens.operators.comparison import distinct_proposals
from itemlens.sources import readers as R
from itemlens.sources import writers as W


def put(folder: Path, name: str, rows: list, array: bool = False) -> str:
    """Rows as one object per line, or as one JSON array over many lines."""
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(rows, indent=2) if array else "".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


PEOPLE = [
    {"mpFirstLastName": "Nora Quill", "mpLastFirstName": "Quill Nora", "partySname": "RED", "partyFname": "Red List", "stateName": "North"},
    {"mpFirstLastName": "Ola van Dam", "partyFname": "Blue List", "stateName": None},
    {"mpFirstLastName": "", "mpLastFirstName": "Ash Ember", "partySname": "", "partyFname": None, "stateName": "South"}]
ASKED_A = [
    {"quesNo": 41, "sessionNo": 3, "date": "2031-05-06", "type": "STARRED", "ministry": "Roads & Bridges", "subjects": "  Toll gates ", "member": ["Dr. Nora Quill", "Ola van Dam"]},
    {"quesNo": 42, "ministry": "Ports", "member": ["Shri Dam van Ola"]}, {"quesNo": 43, "member": ["Ash Ember"], "subjects": None},
    {"quesNo": 44, "member": ["Unlisted Person"]}, {"quesNo": 45, "member": []}, {"quesNo": 46}]


@pytest.mark.parametrize("array", [False, True])
def test_chamber_a(spark, tmp_path, array):
    people = R.read_roster_a(spark, put(tmp_path, "people.json", PEOPLE, array), array)
    index = M.roster_index(M.canonical_roster_a(people), ["mpFirstLastName", "mpLastFirstName"], "roster_order")
    items = M.enrich_items_a(R.read_items_a(spark, put(tmp_path, "asked.json", ASKED_A, array), array), index)
    got = {r.ques_no: r for r in items.collect()}
    assert len(got) == 6 and all(r.chamber == K.CHAMBER_A for r in got.values())
    assert [(got[n].party, got[n].state, got[n].matched) for n in range(41, 47)] == [
        ("RED", "North", True), ("Blue List", "Unknown", True), ("Unknown", "South", True), ("Unknown", "Unknown", False),
        ("Unknown", "Unknown", False), ("Unknown", "Unknown", False)]
    assert (got[41].subject, got[41].member, got[41].all_members, got[41].ministry) == (
        "Toll gates", "Dr. Nora Quill", "Dr. Nora Quill; Ola van Dam", "ROADS AND BRIDGES")
    assert (got[43].subject, got[45].all_members, got[46].member) == ("", "", None)
    unmatched = M.unmatched_askers(items, "chamber", "member", [K.CHAMBER_A]).collect()
    assert [(r["name"], r["count"]) for r in unmatched] == [("Unlisted Person", 1)]


def test_chamber_b(spark, tmp_path):
    now = put(tmp_path, "now.json", [{"mpsno": 5, "partyCode": "RED", "party": "Red List", "state": "East"}, {"mpsno": 6, "partyCode": "", "state": "West"}])
    former = put(tmp_path, "former.json", [{"mpsno": 5, "partyCode": "OLD", "party": "Old List", "state": "East"}, {"mpsno": 7, "partyCode": "OLD"}])
    asked = put(tmp_path, "asked.json", [
        {"qno": 1, "ses_no": 9, "ans_date": "2030-01-02", "qtype": " UNSTARRED ", "min_name": "Ports", "qtitle": " Docks ", "name": " A. Person ", "mp_code": 5,
         "qn_text": "<i>How&nbsp;many</i> docks", "ans_text": "<p></p>", "files": "a.pdf"}, {"qno": 2, "mp_code": 6}, {"qno": 3, "mp_code": 8, "name": "Gone"}, {"qno": 4}])
    people = M.canonical_roster_b(R.read_roster_b(spark, [now, str(tmp_path / "none.json"), former]))
    got = {r.ques_no: r for r in M.enrich_items_b(R.read_items_b(spark, asked), people).collect()}
    assert (got[1].party, got[1].party_full, got[1].type, got[1].subject, got[1].member, got[1].question_text, got[1].answer_text) == (
        "OLD", "Old List", "UNSTARRED", "Docks", "A. Person", "How many docks", None)  # the later file wins
    assert [(got[n].party, got[n].state, got[n].matched) for n in (2, 3, 4)] == [("Unknown", "West", True), ("Unknown", "Unknown", False), ("Unknown", "Unknown", False)]


def test_row_order_follows_files_not_tasks(spark, tmp_path):
    """Spark reads bigger files first; the later row of the later file has to win all the same."""
    put(tmp_path, "r/1.json", [{"mpFirstLastName": "Same Name", "partySname": "FIRST"}])
    put(tmp_path, "r/2.json", [{"mpFirstLastName": f"Other {k}", "partySname": "X"} for k in range(400)] + [
        {"mpFirstLastName": "Same Name", "partySname": "SECOND"}, {"mpFirstLastName": "Same Name", "partySname": "LAST"}])
    people = R.read_roster_a(spark, str(tmp_path / "r"))
    order = [r.mpFirstLastName for r in people.orderBy("roster_order").collect()]
    assert order == ["Same Name", *(f"Other {k}" for k in range(400)), "Same Name", "Same Name"]
    index = M.roster_index(M.canonical_roster_a(people), ["mpFirstLastName", "mpLastFirstName"], "roster_order")
    assert index.where("name = 'same name'").first().party == "LAST"


@pytest.mark.parametrize("envelope", [True, False])
def test_last_proposal_wins_over_pages(spark, tmp_path, envelope):
    first = [{"proposal_no": f"N{k}", "investment_cost": k, "status": "first"} for k in range(30)]
    second = [{"proposal_no": "N7", "investment_cost": 70, "status": "second"}, {"proposal_no": "N8", "status": "second"}, {"proposal_no": "N7", "investment_cost": 77}]
    third = [{"proposal_no": "N8", "investment_cost": 88, "status": "third"}]
    wrap = lambda rows: [{"status": 200, "data": rows}] if envelope else rows
    put(tmp_path, "p/a.json", wrap(first))
    put(tmp_path, "p/b.json", wrap(second) + wrap(third))
    got = {r.proposal_no: r for r in distinct_proposals(R.read_proposals(spark, str(tmp_path / "p"), envelope), ["load_order"]).collect()}
    assert len(got) == 30 and (got["N7"].investment_cost, got["N7"].status) == (77.0, None)
    assert (got["N8"].investment_cost, got["N8"].status, got["N9"].status) == (88.0, "third", "first")


def test_one_object_per_line_is_split(spark, tmp_path):
    put(tmp_path, "big.json", [{"quesNo": k, "subjects": "x" * 200} for k in range(2000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        assert R.read_items_a(spark, str(tmp_path / "big.json")).select(F.spark_partition_id()).distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_absent_files(spark, tmp_path):
    none = str(tmp_path / "none")
    assert R.read_roster_b(spark, [none]).count() == R.read_contacts(spark, none).count() == 0
    assert R.read_table_inferred(spark, none) is None and W.register_tables(spark, str(tmp_path)) == []


def test_table_round_trip(spark, tmp_path):
    rows = [("one, two", 1, ["k", "l"]), ('she said "so"', 2, []), ("Grüße", 3, None)]
    W.write_table(spark.createDataFrame(rows, "a STRING, b INT, c ARRAY<STRING>"), str(tmp_path / "t"), ["b", "a", "c"])
    back = {r.b: (r.a, r.c or "") for r in R.read_table(spark, str(tmp_path / "t"), "b INT, a STRING, c STRING").collect()}
    assert back == {1: ("one, two", "k; l"), 2: ('she said "so"', ""), 3: ("Grüße", "")}
    assert dict(R.read_table_inferred(spark, str(tmp_path / "t")).dtypes)["b"] == "int"


def test_catalogues_of_both_shapes(spark, tmp_path):
    core = put(tmp_path, "core.json", [
        {"title": {"rendered": "Plain"}, "modified": "2030-02-03T04:05:06"},
        {"title": {"rendered": "Rich"}, "acf": {"l3_introduction": "", "introduction": "<div>An <b>intro</b></div>"}, "link": "https://c.example/rich"}])
    post = put(tmp_path, "post.json", [{"posts": [{"post_title": "Posted", "acf_data": {"l3_introduction": "Short", "introduction": "Long"}, "post_slug": "posted"},
                                                  {"post_title": "Bare"}], "total_pages": 1}])
    got = {r.title: r for r in R.read_catalogue(spark, {"T1": core}, {"T2": (post, "c.example")}).collect()}
    assert {t: r.target for t, r in got.items()} == {"Plain": "T1", "Rich": "T1", "Posted": "T2", "Bare": "T2"}
    assert (got["Plain"].intro, got["Plain"].page, got["Rich"].intro, got["Rich"].page) == ("", "", "An intro", "https://c.example/rich")
    assert got["Posted"].intro == "Short" and got["Posted"].page.endswith("/details/posted") and got["Bare"].page.endswith("/details/")


def test_cached_dump_of_both_shapes(spark, tmp_path):
    hooks = {"T1": {"schema": "wp_core"}, "T2": {"schema": "post_page"}}
    dump = {
        "T1": [{"title": {"rendered": "Plain"}, "modified": "2030-02-03T04:05:06"}, {"title": {"rendered": "Rich"}, "modified": None, "link": "https://c.example/rich",
                "acf": {"l3_introduction": "", "introduction": "<div>An <b>intro</b></div>"}}],
        "T2": [{"post_title": "Posted", "post_modified": "2031", "acf_data": {"l3_introduction": "Short", "introduction": "Long"}, "post_slug": "posted"},
               {"post_title": "Bare", "acf_data": False}],
        "Other": [{"post_title": "By its shape"}, {"title": {"rendered": "By its title"}, "link": "https://o.example"}, {}], "None here": []}
    (tmp_path / "dump.json").write_text(json.dumps(dump, indent=2))
    (tmp_path / "empty.json").write_text("{}")
    got = {(r.target, r.title): (r.modified, r.intro, r.page) for r in R.read_catalogue_dump(spark, str(tmp_path / "*.json"), hooks).collect()}
    assert got == {
        ("T1", "Plain"): ("2030-02-03T04:05:06", "", ""), ("T1", "Rich"): (None, "An intro", "https://c.example/rich"),
        ("T2", "Posted"): ("2031", "Short", ""), ("T2", "Bare"): (None, "", ""),
        ("Other", "By its shape"): (None, "", ""), ("Other", "By its title"): (None, "", "https://o.example"), ("Other", None): (None, "", "")}


def test_documents(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, None), ('a "q"', 2, 1.5), ("c", 9, 0.0)], "name STRING, n INT, x DOUBLE")
    none = rows.filter("n > 99")
    doc = W.nested({
        "ranked": W.listed(rows, [-F.col("n"), F.col("name")]), "names": W.listed(rows, [F.col("name")], F.col("name")), "empty": W.listed(none, [F.col("n")]),
        "by": W.lists_by_key(rows, "name", [F.col("n")]), "one": W.single(rows.agg(F.sum("n").alias("n"))), "no": W.single(none),
        "deep": W.nested({"inner": W.listed(rows.filter("n > 2"), [F.col("n")])})})
    W.write_document(doc, str(tmp_path / "doc"))
    parts = list((tmp_path / "doc").glob("part-*"))
    assert len(parts) == 1 and (tmp_path / "doc" / "_SUCCESS").exists()
    assert json.loads(parts[0].read_text()) == {
        "ranked": [{"name": "c", "n": 9, "x": 0.0}, {"name": 'a "q"', "n": 2, "x": 1.5}, {"name": "b", "n": 2, "x": None}],
        "names": ['a "q"', "b", "c"], "empty": [], "by": {'a "q"': [{"n": 2, "x": 1.5}], "b": [{"n": 2, "x": None}], "c": [{"n": 9, "x": 0.0}]},
        "one": {"n": 13}, "no": None, "deep": {"inner": [{"name": "c", "n": 9, "x": 0.0}]}}


def test_press_filter_reaches_the_scan(spark, tmp_path, capsys):
    rows = [("2029-12-31", "note"), ("2030-01-01", "note"), ("2030-01-01", "photo"), ("2030-06-01", "note")]
    spark.createDataFrame(rows, "date STRING, kind STRING").write.parquet(str(tmp_path / "press"))
    found = R.read_press_items(spark, str(tmp_path / "press"), "2030-01-01", "note")
    assert sorted(r.date for r in found.collect()) == ["2030-01-01", "2030-06-01"]
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(date,2030-01-01)" in plan and "EqualTo(kind,note)" in plan
