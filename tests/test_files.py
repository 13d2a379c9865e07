"""Sheets, workbooks and versions in files."""

import random
import zipfile
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sheetspark.sinks import sheets as sinks
from sheetspark.sinks import versions as store
from sheetspark.sinks import workbooks as books
from sheetspark.sources import payloads, sheets, workbooks

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def workbook(path, named_sheets, shared):
    with zipfile.ZipFile(path, "w") as z:
        tags = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(named_sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{NS}" xmlns:r="{REL}"><sheets>{tags}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(named_sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        items = "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in shared)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{NS}">{items}</sst>')
        styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0&quot;days&quot;"/></numFmts>'
        cells = "".join(f'<xf numFmtId="{i}"/>' for i in (0, 22, 170, 171))
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{NS}">{styles}<cellXfs>{cells}</cellXfs></styleSheet>')
        for i, body in enumerate(named_sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{NS}"><sheetData>{body}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    body = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>note</t></is></c></row>'
        '<row r="3"><c r="A3"><v>1.5</v></c><c r="B3" t="b"><v>1</v></c><c r="C3" t="str"><v>#N/A</v></c></row>'
        '<row r="4"><c r="A4"><v>3.0</v></c><c r="B4" t="e"><v>#N/A</v></c><c r="C4" s="1"><v>45293.5</v></c></row>'
        '<row r="5"><c r="A5"><v>1E-3</v></c><c r="B5" s="2"><v>45293</v></c><c r="C5" s="3"><v>7</v></c></row>'
    )
    workbook(tmp_path / "one.xlsx", {"Data": body, "Empty": ""}, ["name"])
    workbook(tmp_path / "two.xlsx", {"Only": '<row><c><v>7</v></c></row>'}, [])
    listed = rows(workbooks.list_sheets(spark, str(tmp_path)), "sheet_name", "ordinal")
    assert listed == [("Data", 0), ("Empty", 1), ("Only", 0)]
    cells = workbooks.read_workbooks(spark, str(tmp_path))
    assert rows(cells, "sheet_name", "row_number", "cells") == [
        ("Data", 0, ["name", None, "note"]),
        ("Data", 2, ["1.5", "True", "#N/A"]),
        ("Data", 3, ["3", None, "2024-01-02 12:00:00"]),
        ("Data", 4, ["0.001", "2024-01-02 00:00:00", "7"]),
        ("Only", 0, ["7"]),
    ]
    assert rows(workbooks.headers(cells), "columns") == [(["7"],), (["name", "Unnamed: 1", "note"],)]
    table = workbooks.sheet_table(cells, ["name", "flag", "note"])
    assert rows(table.where("row_number = 2"), "name", "flag", "note") == [("1.5", "True", "#N/A")]


def test_a_part_of_a_workbook_is_read_by_itself(spark, tmp_path, monkeypatch):
    body = "".join(f'<row r="{i}"><c r="A{i}" t="s"><v>{i % 3}</v></c><c r="B{i}"><v>{i}</v></c></row>' for i in range(1, 400))
    for name in ("a b", "c%20d"):
        workbook(tmp_path / f"{name}.xlsx", {"One": body, "Two": body, "Three": '<row r="1"><c r="A1" t="s"><v>2</v></c></row>'}, ["x", "é", ""])
    plan = workbooks.plan_workbooks(spark, str(tmp_path))
    assert rows(plan, "sheet_name", "ordinal")[:2] == [("One", 0), ("One", 0)] and plan.where("size < 60 or part is null").count() == 0
    whole = workbooks.read_workbooks(spark, str(tmp_path))
    apart = workbooks.read_workbooks(spark, str(tmp_path), task_bytes=1)
    assert apart.rdd.getNumPartitions() == 6 and whole.rdd.getNumPartitions() == 1
    assert rows(whole) == rows(apart) and whole.count() == 2 * (399 + 399 + 1)
    assert rows(apart.where("row_number < 3 and sheet_name = 'Two'"), "cells")[::2] == [(["", "2"],), (["x", "3"],), (["é", "1"],)]
    third = workbooks.read_workbooks(spark, str(tmp_path), sheets=["Three", "none"])
    assert rows(third, "sheet_name", "cells") == [("Three", [""])] * 2
    assert workbooks.read_workbooks(spark, str(tmp_path), sheets=["none"]).count() == 0
    # A file system that tasks cannot open: Spark reads the books.
    monkeypatch.setattr(workbooks, "RANGED", set())
    assert rows(workbooks.read_workbooks(spark, str(tmp_path))) == rows(whole)
    assert rows(workbooks.plan_workbooks(spark, str(tmp_path))) == rows(plan)


def test_ranges_of_a_workbook(tmp_path):
    """Reading one small sheet of a large book takes its directory and its bytes only."""
    import io
    import random

    noise = "".join(f'<row><c t="str"><v>{random.Random(i).getrandbits(400):x}</v></c></row>' for i in range(60_000))
    workbook(tmp_path / "big.xlsx", {"Noise": noise, "Small": '<row r="1"><c r="A1"><v>7</v></c></row>'}, [])

    class Counted(io.FileIO):
        taken = 0

        def readinto(self, target):
            n = super().readinto(target)
            Counted.taken += n
            return n

    size = (tmp_path / "big.xlsx").stat().st_size
    with io.BufferedReader(Counted(tmp_path / "big.xlsx"), 1 << 16) as stream, zipfile.ZipFile(stream) as book:
        part = workbooks._sheet_parts(book)[1][1]
        assert list(workbooks._sheet_rows(book, part, workbooks._Book(book))) == [(0, ["7"])]
    assert Counted.taken < size / 10


def test_written_workbooks_come_back(spark, tmp_path):
    values = [
        ("b1", "s & <1>", 1, "text <&> \" '", 1.5, True, datetime(2024, 2, 29, 12, 30), date(1999, 12, 31), Decimal("12.340")),
        ("b1", "s & <1>", 2, " blanks  kept ", float("nan"), False, None, None, None),
        ("b1", "s2", 3, "\x01bell\nline", float("inf"), None, datetime(1900, 3, 1), None, None),
        ("b1", "s2", 2**60, "é漢𝒳", -2.0, None, None, None, None),
        ("b2", "s2", None, None, 1e300, None, None, None, None),
        (None, "s2", 9, "no book", 0.0, None, None, None, None),
    ]
    schema = "book string, sheet string, n long, t string, d double, b boolean, ts timestamp_ntz, day date, m decimal(10,3)"
    df = spark.createDataFrame(values, schema)
    written = books.write_workbooks(df, f"file:{tmp_path}/out", "book", "sheet", ["n"])
    assert rows(written, "book", "sheets") == [("b1", 2), ("b2", 1)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["b1.xlsx", "b2.xlsx"]
    cells = workbooks.read_workbooks(spark, f"{tmp_path}/out")
    named = workbooks.sheet_table(cells, df.columns)
    back = {(r.sheet_name, r.row_number): (r.n, r.t, r.d, r.b, r.ts, r.day, r.m) for r in named.collect() if "b1.xlsx" in r.path}
    assert back == {
        ("s & <1>", 1): ("1", "text <&> \" '", "1.5", "True", "2024-02-29 12:30:00", "1999-12-31 00:00:00", "12.340"),
        ("s & <1>", 2): ("2", " blanks  kept ", None, "False", None, None, None),
        ("s2", 1): ("3", "bell\nline", None, None, "1900-03-01 00:00:00", None, None),
        ("s2", 2): (str(2**60), "é漢𝒳", "-2", None, None, None, None),
    }
    assert rows(workbooks.headers(cells), "columns")[0] == (df.columns,)
    assert [books.column_letters(i) for i in (0, 25, 26, 701, 702, 16_383)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]


def test_mixed_encodings_and_headers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "utf.csv").write_bytes("name,city\nJosé,Zürich\n".encode())
    (tmp_path / "a" / "latin.csv").write_bytes("city,name\nMünchen,René\n".encode("latin-1"))
    (tmp_path / "b" / "other.csv").write_bytes(b"name,size\nx,1\n")
    (tmp_path / "b" / "skip.txt").write_bytes(b"name\nno\n")
    found = sheets.read_sheet_set(spark, str(tmp_path))
    assert rows(found, "name", "city", "size", "file_name", "sheet_name") == [
        ("José", "Zürich", None, "a", "utf.csv"),
        ("René", "München", None, "a", "latin.csv"),
        ("x", None, "1", "b", "other.csv"),
    ]
    assert rows(found, "sheet_size")[0] == (14,)
    only = sheets.read_sheets(spark, [str(tmp_path / "a" / "latin.csv")])
    assert rows(only, "name") == [("René",)]


def test_many_headers_by_position(spark, tmp_path):
    for i in range(12):
        names = [f"c{i}", "shared", '"a,b"', "", "Dup", "dup"]
        (tmp_path / f"s{i}.csv").write_text(",".join(names) + f'\n{i},s{i},"x,y",blank,d1,d2\nshort{i}\n')
    united = sheets.read_sheets(spark, str(tmp_path))
    assert {"c0", "c11", "shared", "a,b", "_c3", "Dup4", "dup5"} <= set(united.columns)
    assert rows(united, "c3", "shared", "`a,b`", "_c3", "Dup4", "dup5")[0] == ("3", "s3", "x,y", "blank", "d1", "d2")
    assert united.where("shared is null").count() == 12


def test_headers_that_differ_in_case_are_one_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name,x\n1,2\n")
    (tmp_path / "b.csv").write_text("y,name\n3,4\n")
    both = sheets.read_sheets(spark, str(tmp_path))
    assert both.columns[:3] == ["Name", "x", "y"] and rows(both, "Name", "x", "y") == [("1", "2", None), ("4", None, "3")]


CELLS = ['a "b" c', 'x, "y", z', "line1\nline2", 'ends with \\', " lead ", "tab\there", '"', "\r\n", "plain", None, 'back\\"quote']


def test_any_cell_survives_write_and_read(spark, tmp_path):
    df = spark.createDataFrame([(i, c, "end") for i, c in enumerate(CELLS)], "i int, `a b` string, z string")
    sinks.write_sheet(df.coalesce(1), str(tmp_path / "s"))
    back = sheets.read_sheet(spark, str(tmp_path / "s"))
    assert rows(back) == rows(df.withColumn("i", F.col("i").cast("string")))
    tagged = sheets.read_sheets(spark, str(tmp_path / "s"))
    assert rows(tagged, "i", "`a b`", "z") == rows(back)


def test_both_ways_agree_without_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CELLS) if c is None or not set(c) & set("\r\n")], "i int, c string")
    sinks.write_sheet(df, str(tmp_path / "s"))
    assert not sheets.has_quoted_breaks(spark, str(tmp_path / "s"))
    ways = [rows(sheets.read_sheet(spark, str(tmp_path / "s"), multi_line=m)) for m in (True, False, None)]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) == df.count()


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("seed", range(3))
def test_records_over_splits_equal_a_whole_read(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    alphabet = ['"', ",", "\n", "\r\n", "a", "é", " ", "漢", "b\nc", "x" * 30, "\n" * rng.randrange(1, 200)]
    end = ["\n", "\r\n"][seed % 2]
    expected = []
    for n in range(2):
        lines = ['"first\nname",b,"b"']
        for i in range(rng.choice([0, 60, 150])):
            cells = ["".join(rng.choices(alphabet, k=rng.randrange(6))) for _ in range(2)]
            lines.append(f"{n}-{i}," + ",".join('"' + c.replace('"', '""') + '"' for c in cells))
            expected.append((f"{n}-{i}", *[c or None for c in cells]))
            lines += [""] * (rng.random() < 0.1)
        (tmp_path / f"f{n}.csv").write_bytes((end.join(lines) + rng.choice(["", end])).encode())
    found = sheets.read_sheet(spark, str(tmp_path), ordered=True)
    whole = spark.read.options(**sheets.CSV_GRAMMAR, multiLine=True).csv(str(tmp_path))
    assert found.columns == [*whole.columns, "__source_order"] == ["first\nname", "b1", "b2", "__source_order"]
    data = found.drop("__source_order")
    if seed % 2 == 0:
        assert rows(data) == rows(whole)
    assert rows(data) == sorted(expected, key=repr)
    assert [tuple(r)[:3] for r in found.orderBy("__source_order").collect()] == expected
    assert rows(sheets.read_sheets(spark, str(tmp_path)).drop("__path", "__size", "__modified")) == rows(data)
    assert found.select("b1").rdd.getNumPartitions() > 4 or len(expected) < 60


def test_one_cell_over_many_splits_and_an_open_end(spark, tmp_path, small_splits):
    long = "line\n" * 300
    (tmp_path / "a.csv").write_text(f'x,y\n1,"{long}"\n2,"open\nend\nof file')
    got = rows(sheets.read_sheet(spark, str(tmp_path)))
    assert got == rows(spark.read.options(**sheets.CSV_GRAMMAR, multiLine=True).csv(str(tmp_path))) and got[0] == ("1", long)


def test_headers_are_decoded_as_their_files(spark, tmp_path):
    (tmp_path / "utf.csv").write_bytes("id,café\n1,é\n".encode())
    (tmp_path / "latin.csv").write_bytes("id,café\n2,ü\n".encode("latin-1"))
    (tmp_path / "latin_breaks.csv").write_bytes('id,"café"\r\n3,"ü\r\nñ"\r\n'.encode("latin-1"))
    (tmp_path / "latin_header.csv").write_bytes('id,"caf\né"\n4,"ü"\n'.encode("latin-1"))
    found = sheets.read_sheets(spark, str(tmp_path))
    assert set(found.columns) == {"id", "café", "caf\né", "__path", "__size", "__modified"}
    assert rows(found, "id", "café", "`caf\né`") == [("1", "é", None), ("2", "ü", None), ("3", "ü\r\nñ", None), ("4", None, "ü")]
    cells = sheets.read_sheet_cells(spark, str(tmp_path))
    assert rows(cells.select(F.map_keys("cells")))[:1] == [(["id", "caf\né"],)]
    alone = sheets.read_sheet(spark, str(tmp_path / "latin_breaks.csv"), encoding="ISO-8859-1")
    assert rows(alone) == [("3", "ü\r\nñ")] and alone.columns == ["id", "café"]


def test_lone_carriage_returns_beside_line_breaks(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes(b'a,b\n1,"x\ry"\n2,"p\nq"\n')
    whole = spark.read.options(**sheets.CSV_GRAMMAR, multiLine=True).csv(str(tmp_path / "m.csv"))
    assert rows(sheets.read_sheet(spark, str(tmp_path / "m.csv"))) == rows(whole)
    assert sheets.read_sheets(spark, str(tmp_path)).count() == whole.count()


def test_header_cell_with_line_break(spark, tmp_path):
    (tmp_path / "h.csv").write_text('"first\nname",b\n"1\n2",3\n')
    found = sheets.read_sheets(spark, str(tmp_path))
    assert found.columns[:2] == ["first\nname", "b"] and rows(found.select(F.col("`first\nname`"), "b")) == [("1\n2", "3")]


def test_catalog_and_locate(spark, tmp_path):
    for place in ("p1/kpi/f1/s.csv", "p1/concatenated/c1/s.csv", "p1/concatenated/c2/s.csv", "p1/media/f1/t.csv"):
        target = tmp_path / place
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("a\n1\n")
    catalog = sheets.sheet_files(spark, str(tmp_path))
    assert rows(catalog, "project", "file_type", "file_name", "sheet_name", "size")[0] == ("p1", "concatenated", "c1", "s.csv", 4)

    def located(*wanted):
        return [r["path"].split("/p1/")[1] for r in sheets.locate(catalog, *wanted).collect()]

    assert located("concatenated", "whatever", "s.csv") == ["concatenated/c1/s.csv"]
    assert located("kpi", "f1", "s.csv") == ["kpi/f1/s.csv"]
    assert located("kpi", "f2", "s.csv") == []
    wanted = spark.createDataFrame([("concatenated", "x", "s.csv"), ("kpi", "f2", "s.csv")], "file_type string, file_name string, sheet_name string")
    paths = {r["file_type"]: r["path"] for r in sheets.locate_all(catalog, wanted).collect()}
    assert paths["concatenated"].endswith("c1/s.csv") and paths["kpi"] is None


def test_typed_scan_and_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text("i,d,b,s,n\n1,1.5,True,NA,nan\n,2,FALSE,x,\n3,,true,N/A,NULL\n")
    df = sheets.read_sheet(spark, str(tmp_path / "in.csv"), infer=True)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "boolean", "string", "string"]
    assert rows(df) == [(1, 1.5, True, None, None), (3, None, True, None, None), (None, 2.0, False, "x", None)]
    sinks.write_sheet(df, str(tmp_path / "out"))
    assert rows(sheets.read_sheet(spark, str(tmp_path / "out"), infer=True)) == rows(df)
    again = sheets.read_sheet(spark, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        sinks.write_sheet(again, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        sinks.write_parquet(again, "file:" + str(tmp_path / "out"))
    sinks.write_parquet(again, str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 3


def test_payload_rows(spark):
    texts = ['{"columns":["b","a"],"data":[[1,"x"],[null,"y"]]}', '[{"a":"z"}]', "broken"]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    assert rows(payloads.from_records(df, "p", ["a", "b"])) == [("x", "1"), ("y", None), ("z", None)]
    assert rows(payloads.validate_payload(df, "p"), "is_valid") == [(False,), (False,), (True,)]
    shown = sinks.to_payload(spark.createDataFrame([(2, float("inf")), (1, 0.5)], "i int, d double"), ["i"], cap=5)
    assert [r["row"] for r in shown.collect()] == ['{"i":1,"d":0.5}', '{"i":2,"d":null}']
    assert shown.first()["is_complete_data"] and shown.first()["total_rows"] == 2


def test_versions(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.manifest(spark, root).count() == 0
    one = spark.createDataFrame([(1, None), (None, float("inf"))], "i int, d double")
    first = store.commit(one, root, "s", "uploaded")
    with pytest.raises(ValueError):
        store.restore(spark, root, "s", first)
    second = store.commit(one.withColumn("i", F.lit(5)), root, "s", "cleaned")
    other = store.replace_sheet(spark, root, "t", ["a", "b"], [[1, None], ["x", 2.5]])
    third = store.restore(spark, root, "s", first)
    assert rows(store.as_of(spark, root, third)) == rows(one)
    assert rows(store.as_of(spark, root, third, display=True)) == [("1", "value error"), ("value error", "value error")]
    assert rows(store.shown_after_restore(store.as_of(spark, root, third))) == [("1", "NA"), ("NA", "NA")]
    listed = store.manifest(spark, root, "s").orderBy("ordinal").collect()
    assert [(r["hash"], list(r["parents"]), r["operation"]) for r in listed] == [
        (first, [], "uploaded"),
        (second, [first], "cleaned"),
        (third, [second], "undo"),
    ]
    assert rows(store.as_of(spark, root, other)) == [("1", None), ("x", "2.5")]
    with pytest.raises(TypeError):
        store.replace_sheet(spark, root, "t", "a", [])
    with pytest.raises(ValueError):
        store.replace_sheet(spark, root, "t", ["a"], [[1, 2]])
    with pytest.raises(ValueError):
        store.restore(spark, root, "s", "unknown")
