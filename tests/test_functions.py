"""Column functions against fixed cases."""

import json

import pytest
from pyspark.sql import functions as F

from itemlens.functions import labels as L
from itemlens.functions import text as T
from itemlens.functions import values as V


def check(spark, fn, cases, cast="string"):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], f"i INT, x {cast}")
    got = {r["i"]: r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_labels(spark):
    """Alias outputs are fixed by the rule; the spellings around them are ours."""
    check(spark, L.canonical_group, [("\tss-ubt ", "SHS(UBT)"), ("ncpsp", "NCP(SP)"), ("ind", "IND."), ("Green List", "Green List"), ("", "Unknown"), (None, "Unknown")])
    check(spark, L.canonical_region, [("NCT of   Delhi ", "Delhi"), (" keralam", "Kerala"), (" New \t Island ", "New Island"), (" ", "Unknown"), (None, "Unknown")])
    check(spark, L.canonical_target, [
        ("Roads&Bridges", "ROADS AND BRIDGES"), ("Ports,Docks", "PORTS, DOCKS"), ("Communication", "COMMUNICATIONS"), (None, "Unknown")])
    check(spark, L.normalize_label, [
        ("Ministry of Ports", "PORTS"), ("DEPARTMENT OF docks", "DOCKS"), ("Ministry of Roads & Bridges - Department of Bridges", "ROADS AND BRIDGES"),
        ("Ships,Boats and Rafts", "SHIPS BOATS AND RAFTS"), ("Ministry ofPorts", "MINISTRY OFPORTS"), (" Tolls ", "TOLLS"), ("", ""), (None, "")])
    check(spark, L.normalize_region_title, [
        ("new island", "New Island"), ("  OLD ISLAND ", "Old Island"), ("mc'arthur bay", "Mc'Arthur Bay"), ("", "Unknown"), (None, "Unknown")])
    check(spark, L.normalize_type, [("Unstarred  ", "UNSTARRED"), (" ", "UNKNOWN"), (None, "UNKNOWN")])


def test_normalize_name(spark):
    """Honorifics go while they lead, and only as whole words before another."""
    check(spark, L.normalize_name, [
        ("Dr. Nora  QUILL", "nora quill"), ("Shri Smt. Ola Dam", "ola dam"), (" Ember Ash ", "ember ash"), ("Ola Dr. Dam", "ola dr. dam"),
        ("Drew Shrike", "drew shrike"), ("Prof. Er. Adv. Lark", "lark"), ("Justice", "justice")])


def test_html(spark):
    check(spark, T.strip_html, [
        ("<h2>Toll &amp; gates</h2>\n<ul><li>one&nbsp;</li></ul>", "Toll & gates one"), ("<hr><br>", None), ("", None), (None, None)])
    check(spark, lambda c: T.strip_html(c, False), [("<td>7\n\t8</td>", "7 8"), ("<hr>", ""), (None, "")])


def test_tokens(spark):
    check(spark, T.tokenize, [
        ("Toll gates, TOLL bridges of 1999; it is a toll", ["toll", "gates", "toll", "bridges", "toll"]), ("", []), (None, [])])
    check(spark, lambda c: T.bigrams(T.tokenize(c)), [("harbour crane repair", ["harbour crane", "crane repair"]), ("crane", []), (None, [])])


def test_named_terms(spark):
    check(spark, lambda c: F.array_sort(F.array_distinct(T.extract_named_terms(c))), [
        ("Funds of Harbour Light Yojana", ["Harbour Light Yojana"]), ("PM-CRANE and PM-AX", ["PM-CRANE"]), ("no names here", []), (None, [])])
    check(spark, T.extract_named_terms, [("Crane Yojana, then Crane Yojana", ["Crane Yojana"] * 2)])
    check(spark, T.collapse_suffix, [("Crane Yojana", "crane"), ("Crane mission", "crane"), ("Yojana", "yojana")])


def test_titles(spark):
    check(spark, T.significant_words, [("Scheme for the Cranes 4U and Docks", ["Cranes", "4U", "Docks"]), ("of and the", []), ("", [])])
    check(spark, T.derive_pattern, [
        ("Harbour Renewal (HARB) Scheme", r"\bHARB\b"), ("Docks (D-7.X)", r"\bD\-7\.X\b"), ("Cranes", "Cranes"),
        ("Dock Crane Repair", r"Dock\s+Crane\s+Repair"), ("Pier 2.0 (x1)", r"Pier\s+x1")])
    df = spark.createDataFrame([("Dock Repair Yard (AB)",), ("Dock Repair Yard (" + "A" * 16 + ")",)], "x string")
    assert all("\\bA" not in r[0] for r in df.select(T.derive_pattern(F.col("x"))).collect())  # acronyms of 2 and of 16 letters are none


def test_money_and_dates(spark):
    check(spark, T.extract_outlay, [
        ("costs Rs. 9,876.5 crore in all", 9876.5), ("RS 3 Crore", 3.0), ("Rs 3 million", None), ("Rs. , crore", None), ("", None), (None, None)])
    check(spark, lambda c: V.months_since(c, "2030-03-31"), [
        ("2030-03-01T12:00:00", round(30 / 30.44, 1)), ("2029-03-31 00:00:00", round(365 / 30.44, 1)), ("2030-03-31", 0.0), ("soon", None), (None, None)])
    check(spark, V.grade_order, [("A", 0), ("F", 7), ("none", 99), (None, 99)])
    check(spark, V.is_granted, [("granted in part", True), ("Refused", False), (None, False)])
    check(spark, lambda c: V.date_prefix(c, True), [("2030-03-31T23:59", "2030-03-31"), (None, "")])


def test_ratios(spark):
    df = spark.createDataFrame([(7, 2), (2, 3), (0, 4), (4, 0)], "n INT, d INT")
    assert [r[0] for r in df.select(V.safe_ratio(F.col("n"), F.col("d"))).collect()] == [3.5, 0.667, 0.0, None]
    df = spark.createDataFrame([(3.0, 12.0), (None, 12.0), (3.0, 0.0), (3.0, None)], "p DOUBLE, o DOUBLE")
    assert [r[0] for r in df.select(V.percent_paid(F.col("p"), F.col("o"))).collect()] == [25.0, 0.0, None, None]
    df = spark.createDataFrame([(2, 2), (0, 0)], "s INT, u INT")
    assert [r[0] for r in df.select(V.starred_share(F.col("s"), F.col("u"))).collect()] == [50.0, 0.0]


def test_company_and_activity(spark):
    check(spark, T.extract_company, [
        ("New pier by M/s Crane Works Ltd at the bay", "Crane Works Ltd"), ("Dredging by use of pumps by M/s. Deep Sea Ltd.", "Deep Sea Ltd"),
        ("Dock by Harbour Limited for ships", "Harbour Limited"), ("Harbour Limited builds a dock", None), ("Dock by abc", None), ("", None), (None, None)])
    check(spark, T.extract_activity, [
        (json.dumps([{"label": "Size", "value": "9"}, {"label": "Activity", "value": "7(e) Ports"}]), "7(e) Ports"),
        (json.dumps([{"label": "Size", "value": "9"}]), None), ("[broken", None), ("3", None), ("", None), (None, None)])


def test_lists_and_ids(spark):
    check(spark, V.split_askers, [("Quill; ;Dam ;", ["Quill", "Dam"]), ("", []), (None, [])])
    df = spark.createDataFrame([(["A", "B"],), ([],), (None,)], "m ARRAY<STRING>")
    rows = df.select(V.lead_asker(F.col("m")), V.join_askers(F.col("m"))).collect()
    assert [tuple(r) for r in rows] == [("A", "A; B"), (None, ""), (None, "")]
    got = spark.createDataFrame([("party:A:B",)], "x string").select(V.split_node_id(F.col("x")).alias("s")).first()["s"]
    assert (got["type"], got["label"]) == ("party", "A:B")


@pytest.mark.parametrize("value,want", [(1.5e7, 2.0), (2.4e7, 2.0), (0.0, 0.0)])
def test_in_crore(spark, value, want):
    assert spark.range(1).select(V.in_crore(F.lit(value))).first()[0] == want
