from __future__ import annotations

from kinweave.sources import csv_pairs, gazetteer, gedcom
from kinweave.streaming import ingest

TREE = """0 HEAD
1 GEDC
2 VERS 5.5.1
1 CHAR UTF-8
0 @I1@ INDI
1 NAME Janez /Novak/
1 SEX M
1 BIRT
2 DATE 12 JAN 1850
2 PLAC Žiri, Slovenia
1 NOTE first line
2 CONC  goes on
2 CONT second @@ line
1 FAMS @F1@
0 @I2@ INDI
1 NAME Ana //
1 FAMS @F1@
0 @I3@ INDI
1 NAME Old /Name/
1 FAMC @F1@
this is no line
0 @F1@ FAM
1 HUSB @I1@
1 WIFE @I2@
1 CHIL @I3@
1 MARR
2 DATE 1875
0 @I3@ INDI
1 NAME New /Name/
1 FAMC @F1@
0 TRLR
"""


def test_family_files(spark, tmp_path):
    (tmp_path / "a.ged").write_text(TREE)
    (tmp_path / "b.ged").write_bytes(TREE.replace("UTF-8", "ANSI").replace("\n", "\r").encode("windows-1250"))
    (tmp_path / "c.ged").write_bytes(b"\xef\xbb\xbf0 HEAD\r\n3 JUMP x\r\n0 TRLR")
    nodes = gedcom.read_nodes(spark, str(tmp_path)).cache()
    people = {(r.file_id, r.id): r for r in gedcom.individuals(nodes).collect()}
    assert len(people) == 6
    one = people["a.ged", "@I1@"]
    assert (one.name, one.given, one.surname, one.sex, one.spouse_of) == ("Janez Novak", "Janez", "Novak", "M", ["@F1@"])
    assert people["a.ged", "@I2@"].surname is None and people["b.ged", "@I3@"].given == "New"
    places = {r.file_id: r.place for r in gedcom.events(nodes).filter("tag = 'BIRT'").collect()}
    assert places == {"a.ged": "Žiri, Slovenia", "b.ged": "Žiri, Slovenia"}
    note = nodes.filter("file_id = 'a.ged' and tag = 'NOTE'").first()
    assert note.value == "first line goes on\nsecond @@ line"
    edges = gedcom.family_edges(nodes).filter("file_id = 'a.ged'")
    assert {(r.person_id, r.role) for r in edges.collect()} == {("@I1@", "husband"), ("@I2@", "wife"), ("@I3@", "child")}
    assert {(r.src, r.dst, r.edge) for r in gedcom.graph_edges(edges).collect()} >= {("@I3@", "@I1@", "parent"), ("@I1@", "@I2@", "spouse"), ("@I2@", "@I3@", "child")}
    assert {tuple(r) for r in gedcom.versions(nodes).collect()} == {("a.ged", "5.5.1"), ("b.ged", "5.5.1")}
    assert {(r.file_id, r.kind) for r in gedcom.read_warnings(spark, str(tmp_path)).collect()} == {("a.ged", "syntax"), ("b.ged", "syntax"), ("c.ged", "level")}
    written = {r.file_id: r.text for r in gedcom.write_files(nodes, gedcom.read_files(spark, str(tmp_path))).collect()}
    assert written["a.ged"] == TREE and written["b.ged"] == TREE.replace("UTF-8", "ANSI").replace("\n", "\r") and written["c.ged"] == "0 HEAD\r\n1 JUMP x\r\n0 TRLR"
    (tmp_path / "again").mkdir()
    (tmp_path / "again" / "a.ged").write_text(written["a.ged"])
    again = gedcom.read_nodes(spark, str(tmp_path / "again"))
    assert again.exceptAll(nodes).count() == 0


ROUND_TRIPS = [
    "0 HEAD\n1 NOTE mail a@b.example\n2 CONT @@home is text\n2 CONT @I1@\n2 CONT @#DJULIAN@ 1 JAN 1700\n0 TRLR",
    "0 HEAD\r\n1 NOTE one\r\n2 CONC two\r\n2 CONT\r\n2 CONT three\r\n2 CONC \r\n0 TRLR\r\n".replace("2 CONC \r\n", ""),
    "0 @N1@ NOTE\n1 CONT begins below\n1 CONC  and goes on\n0 TRLR\n",
    "0 HEAD\n1 _CUSTOM x\n2 COLR 1\n3 DATE whatever\n0 TRLR\n",
]


def test_files_come_back_byte_by_byte():
    import pandas as pd

    for text in ROUND_TRIPS:
        nodes, _ = gedcom.parse_lines(text)
        eol, final = gedcom.line_style(text)
        assert gedcom.format_lines(pd.DataFrame(nodes), eol, 253, final) == text
    # free text that lost its line codes belongs to the note above; long lines wrap at 253 bytes and come back whole
    nodes, warnings = gedcom.parse_lines("0 HEAD\n1 NOTE begin\nno line at all\n9 KIDS in the house\n1 DATE 1900\nlost line\n0 TRLR")
    assert nodes[1]["value"] == "begin\nno line at all\n9 KIDS in the house" and [w["kind"] for w in warnings] == ["syntax"] and nodes[3]["verbatim"] == "lost line"
    long = "0 HEAD\n1 NOTE " + "žaba in volk " * 60 + "end\n0 TRLR\n"
    wrapped = gedcom.format_lines(pd.DataFrame(gedcom.parse_lines(long)[0]))
    assert max(len(x.encode()) for x in wrapped.split("\n")) <= 253 and gedcom.parse_lines(wrapped)[0][1]["value"] == gedcom.parse_lines(long)[0][1]["value"]
    assert gedcom.format_lines(pd.DataFrame(gedcom.parse_lines(long)[0]), limit=0) == long


def test_bytes_of_many_kinds():
    head = b"0 HEAD\n1 CHAR ANSEL\n0 @I@ INDI\n1 NAME "
    assert "Ko\u010devar \u0141uk\u00e1sz" in gedcom.decode_bytes(head + b"Ko\xe9cevar \xa1uk\xe2asz\n")[0]
    torn = "0 HEAD\n1 CHAR UTF-8\n1 NOTE ko".encode() + "č".encode()[:1] + b"\n2 CONC " + "č".encode()[1:] + b"a\n"
    assert gedcom.decode_bytes(torn) == ("0 HEAD\n1 CHAR UTF-8\n1 NOTE koč\n2 CONC a\n", "utf-8")
    twice = "1 NOTE Kočevje šola".encode().decode("cp1252", "replace")
    assert gedcom.repair_mojibake("1 NOTE " + "Müller ž".encode().decode("cp1252")) == "1 NOTE Müller ž" and twice
    assert gedcom.repair_mojibake("Äpfel und Öl") == "Äpfel und Öl"
    assert gedcom.decode_bytes("0 HEAD\n".encode("utf-16-be"))[0] == "0 HEAD\n" and gedcom.decode_bytes("1 NAME Ž".encode("cp1250"))[1] == "windows-1250"


def test_csv_matches(spark, tmp_path):
    (tmp_path / "m.csv").write_text('Ime,Priimek,Datum rojstva,Kraj rojstva,Oče,Mati,Partnerji,Zaupanje\nAna,Novak (Nowak),1850,Bled,Jože Novak,,"Kos; Zupan",90\nAna,"Novak\nKos",3 JAN 1851,🗒 x,,,,\nJože,Kos,,,,,,80\nJosef,Kos,1900,,,,,\nfooter only\n')
    (tmp_path / "n.csv").write_text("\ufeffSurname,Name,Date of Birth,Parents\nNovak,Ana,ABT 1850,\"Jože Novak, Meta\"\nNovak,Anna,1850,\n")
    rows = csv_pairs.read_match_rows(spark, str(tmp_path / "*.csv")).cache()
    got = {(r.file[-5:], r.match_id, r.side, r.language, r.given, r.surname, r.birth_date, r.birth_place) for r in rows.collect()}
    assert got == {
        ("m.csv", 0, "main", "sl", "Ana", "Novak", "1850", "Bled"), ("m.csv", 0, "incoming", "sl", "Ana", "Novak\nKos", "3 JAN 1851", None), ("m.csv", 1, "main", "sl", "Jože", "Kos", None, None),
        ("m.csv", 1, "incoming", "sl", "Josef", "Kos", "1900", None), ("n.csv", 0, "main", "en", "Ana", "Novak", "ABT 1850", None), ("n.csv", 0, "incoming", "en", "Anna", "Novak", "1850", None),
    }
    people = {(r.side, r.person): r.n for r in csv_pairs.listed_people(rows).collect()}
    assert people["main", "ana|novak|1850"] == 2 and sum(n for (s, _), n in people.items() if s == "main") == 3
    rel = {(r.file[-5:], r.role, r.name) for r in csv_pairs.relatives_of(rows).collect()}
    assert rel == {("m.csv", "father", "Jože Novak"), ("m.csv", "partner", "Kos"), ("m.csv", "partner", "Zupan"), ("n.csv", "father", "Jože Novak"), ("n.csv", "mother", "Meta")}
    for language, names in csv_pairs.HEADERS.items():
        assert csv_pairs.detect_fields(list(names)) == (language, {f: i for i, f in enumerate(csv_pairs.FIELDS)})


def test_gazetteer(spark, tmp_path):
    line = "\t".join(["1", "Žiri", "Ziri", "Sairach,Ziri", "46.05", "14.1", "P", "PPL", "SI", "", "A1", "", "", "", "3600", "", "", "", ""])
    (tmp_path / "g.txt").write_text(line + "\nbad line\n")
    found = gazetteer.read_gazetteer(spark, str(tmp_path / "g.txt"))
    assert [(r.entry, r.name, r.alt, r.population) for r in found.collect()] == [(1, "Žiri", ["Sairach", "Ziri"], 3600)]
    assert {r.key for r in gazetteer.gazetteer_names(found).collect()} == {"žiri", "ziri", "sairach"}


def test_streams(spark, tmp_path):
    base = spark.range(20).selectExpr("id", "timestamp_seconds(id * 3600) as ts", "id % 3 as user_id", "'t' as event_type", "cast(id as double) as value")
    base.repartition(4).write.parquet(str(tmp_path / "in"))
    schema = "id long, ts timestamp, user_id long, event_type string, value double"
    ingest.ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "c1"), files_per_batch=1).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = ingest.user_windows(stream, "0 seconds", "10 hours").writeStream.format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c2")).outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("select n from w").collect()) == [10, 10]
    main = spark.createDataFrame([(0,), (1,)], "user_id long")
    ingest.rerank_each_batch(stream, main, lambda m, b: b.join(m, "user_id").select("id"), str(tmp_path / "r"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "r")).count() == 14
