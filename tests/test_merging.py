from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import merging, structure
from kinweave.sources import gedcom


def test_survivors_and_remap(spark):
    pairs = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "y")], "a_id string, b_id string")
    rich = spark.createDataFrame([("a", 1), ("c", 4), ("x", 2), ("y", 2)], "id string, n int")
    m = merging.survivors(pairs, rich)
    assert {tuple(r) for r in m.collect()} == {("a", "c"), ("b", "c"), ("c", "c"), ("x", "x"), ("y", "x")}
    edges = spark.createDataFrame([("F1", "a", "child", 0), ("F1", "c", "child", 1), ("F1", "q", "child", 2), ("F1", "q", "child", 3), ("F2", "y", "wife", 0), ("F3", None, "wife", 0)], "fam_id string, person_id string, role string, ord int")
    got = {tuple(r) for r in merging.merge_edges(edges.filter("person_id is not null"), m).collect()}
    # c stays where a joins it; the repeat of q was there before
    assert got == {("F1", "c", "child", 1), ("F1", "q", "child", 2), ("F1", "q", "child", 3), ("F2", "x", "wife", 0)}
    assert merging.remap(edges, "person_id", m).filter("fam_id = 'F3'").first().person_id is None


def test_roles_and_privacy(spark):
    edges = spark.createDataFrame([("F1", 1, "husband"), ("F1", 2, "wife"), ("F2", 3, "husband"), ("F2", 4, "wife"), ("F3", 3, "wife")], "fam_id string, person_id long, role string")
    sexes = spark.createDataFrame([(1, "F"), (3, "F"), (4, "F")], "person_id long, sex string")
    got = {tuple(r) for r in merging.fill_spouse_role(edges, sexes).collect()}
    assert got == {("F1", 1, "wife"), ("F1", 2, "husband"), ("F2", 3, "husband"), ("F2", 4, "wife"), ("F3", 3, "wife")}
    assert {tuple(r) for r in merging.infer_sex(edges).collect()} == {(1, "M"), (2, "F"), (4, "F")}
    people = spark.createDataFrame([(1, "A", None, 1990, None, False, "x"), (2, "B", 1950, 1900, None, False, "y"), (3, "C", None, None, 1800, False, "z"), (4, "D", None, None, None, False, "w")], "id long, name string, death int, birth int, rel int, deceased boolean, mail string")
    judged = people.withColumn("why", merging.living_reason(F.lit(False), F.col("death"), F.col("birth"), F.col("rel"), 2024))
    assert [r.why for r in judged.orderBy("id").collect()] == ["birth", "deceased", "old", "unknown"]
    assert [(r.name, r.mail) for r in merging.redact_people(judged, "why", ["mail"]).orderBy("id").collect()] == [("Living", None), ("B", "y"), ("C", "z"), ("D", "w")]
    assert [r.deceased for r in merging.mark_deceased(people, "birth", "deceased", 2024).orderBy("id").collect()] == [False, True, False, False]


def test_structure(spark, tmp_path):
    (tmp_path / "a.ged").write_text("0 HEAD\n0 @I1@ INDI\n1 NAME A /B/\n1 FAMS @F9@\n1 ZZZZ x\n1 _OWN y\n2 QQQQ z\n3 DATE nonsense\n3 SOUR @S8@\n1 BIRT\n2 DATE 1 JAN 1900\n2 SOUR @S7@\n1 DEAT\n2 DATE __.__.____\njunk\n0 @I1@ INDI\n1 SOUR @S7@\n1 ZZZZ\n1 _OWN\n1 BIRT\n2 DATE 2 FEB 1900\n1 EVEN\n2 DATE some day\n0 TRLR\n")
    nodes = gedcom.read_nodes(spark, str(tmp_path)).cache()
    rows = structure.structure_issues(nodes, gedcom.read_warnings(spark, str(tmp_path))).collect()
    # the lost family link is the check of people's; what lies below a vendor tag is the vendor's own
    assert [(r.category, r.severity, r.sample, r.n) for r in rows] == [
        ("syntax", "error", "line 15", 1), ("danglingXref", "error", "@S7@", 2), ("duplicateXref", "error", "@I1@", 1), ("unknownTag", "warning", "ZZZZ", 2), ("badDate", "warning", "some day", 1), ("customTag", "info", "_OWN", 2),
    ]
    assert [(r.xref, r.family_links) for r in structure.dangling_pointers(nodes).orderBy("xref").collect()] == [("@F9@", True), ("@S7@", False)]
    assert [(r.style, r.n) for r in structure.date_style(nodes).collect()] == [("standard", 2)]
    assert structure.dangling_removed(nodes).filter("tag = 'FAMS'").count() == 0 and structure.dangling_removed(nodes).count() == nodes.count() - 4
    d = spark.createDataFrame([(1850, 2, 3, "about"), (1850, None, None, "exact"), (None, None, None, "unknown")], "y int, m int, d int, q string")
    cols = [F.col(c) for c in "ymdq"]
    assert [r[0] for r in d.select(structure.format_date(*cols)).collect()] == ["ABT 3 FEB 1850", "1850", None]
    assert [r[0] for r in d.select(structure.format_date(*cols, style="iso")).collect()] == ["ABT 1850-02-03", "1850", None]
