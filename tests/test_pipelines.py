"""Landed files to result tables."""

import json

from itemlens import pipelines as P


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_run_on_landed_files(spark, tmp_path):
    people = [{"mpFirstLastName": f"Person {w}", "partySname": g, "partyFname": f"{g} List", "stateName": s}
              for w, g, s in [("Lark", "RED", "North"), ("Wren", "RED", "North"), ("Finch", "BLUE", "South"), ("Heron", "BLUE", "South")]]
    asked = [{"quesNo": k, "sessionNo": 1, "date": f"2030-01-{k % 28 + 1:02d}", "type": "STARRED" if k % 2 else "UNSTARRED",
              "ministry": ["Ports", "Ports", "Roads", "Roads"][k % 4], "subjects": ["Harbour crane repair", "Toll bridge safety"][k % 4 // 2],
              "member": [f"Person {['Lark', 'Wren', 'Finch', 'Heron'][k % 4]}"] + (["Person Heron"] if k % 4 == 0 else [])} for k in range(160)]
    # an item that came twice, signed by others the second time
    asked.append({"quesNo": 0, "sessionNo": 1, "date": "2030-12-31", "type": "STARRED", "ministry": "Ports", "subjects": "Harbour crane repair",
                  "member": ["Person Lark", "Person Finch"]})
    asked += [{"quesNo": 500, "member": ["Nobody At All"], "ministry": "Ports", "subjects": "x"}, {"quesNo": 501}]
    b = [{"qno": 9, "mp_code": 1, "min_name": "Ports", "qtype": "STARRED", "qtitle": "Dock", "name": "B One"}, {"qno": 10, "mp_code": 7, "name": "B Two"}]
    landed = P.Landed(lines(tmp_path / "a.json", asked), lines(tmp_path / "ra.json", people), lines(tmp_path / "b.json", b),
                      [lines(tmp_path / "rb.json", [{"mpsno": 1, "partyCode": "GREEN", "party": "Green List", "state": "East"}])])
    names = P.run(spark, landed, str(tmp_path / "out"))
    assert {"party_summary", "topic_keywords", "kg_pagerank", "kg_party_communities", "kg_mp_coasking_bridges"} <= set(names)
    rows = lambda view, *cols: sorted(tuple(r[c] for c in cols) for r in spark.table(view).collect())
    assert rows("party_summary", "party", "total_questions") == [("BLUE", 80), ("GREEN", 1), ("RED", 81), ("Unknown", 3)]
    assert rows("state_summary", "state", "questions") == [("East", 1), ("North", 81), ("South", 80), ("Unknown", 3)]
    assert ("RED", 81, 0) in rows("party_ministry_matrix_wide", "party", "PORTS", "ROADS")
    assert rows("unmatched_members", "name", "count") == [("B Two", 1), ("Nobody At All", 1)]
    assert {(r.party, r.term) for r in spark.table("topic_keywords").collect()} >= {("ALL", "harbour crane"), ("RED", "harbour crane"), ("BLUE", "toll bridge")}
    bridges = {frozenset((r.asker_a, r.asker_b)): r.joint_items for r in spark.table("kg_mp_coasking_bridges").collect()}
    # of item 0 the later signing counts
    assert bridges == {frozenset(("Person Lark", "Person Heron")): 39, frozenset(("Person Lark", "Person Finch")): 1}
    assert rows("kg_party_communities", "group") == [("BLUE",), ("RED",)]
    assert abs(sum(r.pagerank for r in spark.table("kg_pagerank").collect()) - 1) < 1e-3
    data, relations = (json.loads("".join(f.read_text() for f in (tmp_path / "out" / f"{n}.json").glob("part-*"))) for n in ("data", "graph"))
    assert data["party_summary"][0] == {"party": "RED", "lok_sabha_questions": 81, "rajya_sabha_questions": 0, "total": 81}
    assert data["ministry_summary"] == [{"ministry": m, "questions": n} for m, n in (("PORTS", 83), ("ROADS", 80), ("Unknown", 2))]
    matrix = data["party_ministry_matrix"]
    assert matrix["ministries"][:2] == ["PORTS", "ROADS"] and matrix["rows"][0] == {"party": "RED", "values": [81, 0] + [0] * (len(matrix["ministries"]) - 2)}
    assert data["party_topics"]["BLUE"][0]["term"] in ("bridge safety", "toll bridge") and data["overall_topics"][0]["count"] >= 80
    assert data["totals"]["combined"] == 165
    assert {frozenset((b["asker_a"], b["asker_b"])): b["joint_items"] for b in relations["cross_party_bridges_top"]} == bridges
    assert relations["stats"]["cross_party_pairs"] == len(bridges) and relations["pagerank_top"][0].keys() >= {"node", "pagerank"}


def test_counts_come_from_one_shuffle_of_the_items(spark, capsys):
    rows = [("A", "t", "P", "N", "M", "sub", True, "x", 4), ("A", None, "P", None, "M", None, False, None, 2), ("A", "t", "P", "N", "M", "sub", False, "y", 1)]
    items = spark.createDataFrame(rows, "chamber STRING, type STRING, party STRING, state STRING, ministry STRING, subject STRING, matched BOOLEAN, raw_name STRING, ques_no INT")
    counts = P.item_counts(items)
    get = lambda n: sorted((tuple(r) for r in counts[n].collect()), key=repr)
    assert get("cells") == sorted([("A", "t", "P", "N", "M", 2), ("A", None, "P", None, "M", 1)], key=repr)
    assert get("subjects") == sorted([("P", "sub", 2, 1), ("P", None, 1, 2)], key=repr)
    assert get("names") == sorted([("A", True, "x", 1), ("A", False, None, 1), ("A", False, "y", 1)], key=repr)
    columns = ["chamber", "type", "party", "state", "ministry", "subject", "matched", "raw_name"]
    items.groupingSets([[P.F.col(c) for c in own] for own in P.SETS.values()], *columns).agg(P.F.count(P.F.lit(1))).explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Expand" in plan
