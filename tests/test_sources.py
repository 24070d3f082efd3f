"""Sources and sinks: workbooks, reported failures, sinks that lose nothing."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quillrank.sources import readers, writers

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, rows, sheet="national", dimension=True, shared=True):
    """A workbook of two sheets; strings are shared or in the cells."""
    strings: list[str] = []

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, float | int):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if v == "#N/A":
            return f'<c r="{ref}" t="e"><v>#N/A</v></c>'
        text = v.replace("&", "&amp;").replace("<", "&lt;")
        if not shared:
            return f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'
        strings.append(f"<si><r><t>{text[:1]}</t></r><r><t>{text[1:]}</t></r><rPh><t>aloud</t></rPh></si>" if len(strings) % 2 else f"<si><t>{text}</t></si>")
        return f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'

    data = "".join(f'<row r="{i}">' + "".join(cell(f"{'ABCDEFG'[j]}{i}", v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    size = f'<dimension ref="A1:G{len(rows)}"/>' if dimension else ""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="notes" r:id="a"/><sheet name="{sheet}" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {NS}><sheetData><row r=\"1\"><c r=\"A1\" t=\"inlineStr\"><is><t>OCC_CODE</t></is></c></row></sheetData></worksheet>")
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {NS}>{size}<sheetData>{data}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(strings)}</sst>")


ROWS = [["OCC_CODE", "OCC_TITLE", None, "TOT_EMP"], ["11-1", "Chiefs & <heads>", "x", 1500], ["11-2", None, None, "1,234"], ["11-1", "again", None, 7], [None, None, None, None], ["11-3", "c", None, "**"], ["11-4", "d", None, "#N/A"], ["11-5", "e", None, 2.5e3]]


@pytest.mark.parametrize("dimension, shared", [(True, True), (False, False)])
def test_workbook(spark, tmp_path, dimension, shared):
    path = str(tmp_path / "national.xlsx")
    workbook(path, ROWS, dimension=dimension, shared=shared)
    for rows in ("50000", "2"):
        got = readers.workbook(spark, path, "TOT_EMP DOUBLE, OCC_CODE STRING, OCC_TITLE STRING, none LONG, _row LONG", sheet="national", rows=rows)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[-1]) == [(1500.0, "11-1", "Chiefs & <heads>", None, 2), (None, "11-2", None, None, 3), (7.0, "11-1", "again", None, 4), (None, "11-3", "c", None, 6), (None, "11-4", "d", None, 7), (2500.0, "11-5", "e", None, 8)]
    parts = readers.workbook(spark, path, "OCC_CODE STRING", sheet="national", rows="2").rdd.getNumPartitions()
    assert parts == (4 if dimension else 1)
    assert spark.read.format("xlsx").option("sheet", "national").load(path).columns == ["OCC_CODE", "OCC_TITLE", "TOT_EMP"]
    with pytest.raises(Exception, match="no sheet"):
        readers.workbook(spark, path, "a STRING", sheet="other").collect()


def test_folder_of_workbooks(spark, tmp_path):
    for i in range(3):
        workbook(str(tmp_path / f"w{i}.xlsx"), [["k"], [f"v{i}"]])
    (tmp_path / "other.txt").write_text("x")
    got = readers.workbook(spark, f"file://{tmp_path}", "k STRING, _file STRING", sheet="national").collect()
    assert sorted((r["k"], os.path.basename(r["_file"])) for r in got) == [(f"v{i}", f"w{i}.xlsx") for i in range(3)]


def test_employment_keeps_the_first_of_a_code(spark, tmp_path):
    rows = [["OCC_CODE", "TOT_EMP"], ["a", "**"], ["b", "1,200"], ["a", 5], ["b", 7], ["c", 3]]
    book, text = str(tmp_path / "e.xlsx"), tmp_path / "e.csv"
    with zipfile.ZipFile(book, "w"):
        pass
    workbook(book, rows, sheet="x")
    text.write_text("\n".join(",".join(f'"{v}"' for v in r) for r in rows))
    want = {"a": None, "b": 1200.0, "c": 3.0}
    assert {r["SOC_BASE"]: r["TOT_EMP"] for r in readers.employment(spark, str(text)).collect()} == want
    one = readers.workbook(spark, book, "OCC_CODE STRING, TOT_EMP STRING, _row LONG", sheet="x")
    assert one.count() == 5 and [f.name for f in one.schema.fields] == ["OCC_CODE", "TOT_EMP", "_row"]
    first = str(tmp_path / "first.xlsx")
    with zipfile.ZipFile(book) as z, zipfile.ZipFile(first, "w") as out:  # the sheet comes first
        for n in z.namelist():
            out.writestr(n, z.read(n).replace(b'<sheet name="notes" r:id="a"/>', b""))
    assert {r["SOC_BASE"]: r["TOT_EMP"] for r in readers.employment(spark, first).collect()} == want


def test_missing_and_unreadable_documents_are_reported(spark, tmp_path):
    (tmp_path / "a_metrics.json").write_text(json.dumps({"run": "a", "agg": {"rmse": 1.5}}, indent=1))
    (tmp_path / "b_metrics.json").write_text('{"run": "b", "agg": ')
    (tmp_path / "c_metrics.json").write_text("[1, 2")
    (tmp_path / "d_metrics.json").write_text("")
    schema = "run STRING, agg MAP<STRING, DOUBLE>"
    rows, report = readers.json_documents(spark, [f"{tmp_path}/*_metrics.json", f"{tmp_path}/none.json"], schema)
    assert [(r["run"], r["agg"], os.path.basename(r["path"])) for r in rows.collect()] == [("a", {"rmse": 1.5}, "a_metrics.json")]
    assert sorted((os.path.basename(r["path"]), r["problem"]) for r in report.collect()) == [("b_metrics.json", "unreadable"), ("c_metrics.json", "unreadable"), ("d_metrics.json", "unreadable"), ("none.json", "missing")]
    rows, report = readers.json_documents(spark, [f"{tmp_path}/none.json"], schema)
    assert rows.count() == 0 and rows.columns == ["run", "agg", "path"] and report.count() == 1
    default = spark.createDataFrame([("z", None)], schema)
    assert readers.json_document(spark, f"{tmp_path}/none.json", schema, default).first()["run"] == "z"
    assert readers.json_document(spark, f"{tmp_path}/a_metrics.json", schema, default).first()["run"] == "a"


def test_missing_and_unreadable_experiments_are_reported(spark, tmp_path):
    spark.range(3).toDF("n").write.parquet(f"{tmp_path}/good.parquet")
    spark.range(2).select(F.col("id").alias("n"), F.lit("x").alias("more")).write.parquet(f"{tmp_path}/wide.parquet")
    (tmp_path / "broken.parquet").write_text("no parquet at all, though it is long enough for a footer")
    rows, report = readers.experiments(spark, str(tmp_path), ["good", "wide", "broken", "none", "raw"], {"raw": spark.range(1).toDF("n")})
    assert {(r["experiment"], r["count"]) for r in rows.groupBy("experiment").count().collect()} == {("good", 3), ("wide", 2), ("raw", 1)}
    assert rows.filter("more = 'x'").count() == 2
    found = {r["experiment"]: r["problem"] for r in report.collect()}
    assert found.keys() == {"broken", "none", "raw"} and found["none"] == found["raw"] == "missing" and found["broken"].startswith("unreadable")
    assert readers.experiments(spark, str(tmp_path), ["none"])[0] is None


def test_a_second_experiment_leaves_the_first(spark, tmp_path):
    path = f"{tmp_path}/parsed"
    rows = lambda *r: spark.createDataFrame(r, "experiment STRING, v INT")
    writers.by_experiment(rows(("a", 1), ("b", 2)), path)
    writers.by_experiment(rows(("b", 3)), path)
    writers.by_experiment(rows(("c", 4)), path)
    assert sorted((r["experiment"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3), ("c", 4)]


@pytest.mark.parametrize("stop", range(6))
def test_a_stopped_swap_loses_nothing(spark, tmp_path, monkeypatch, stop):
    path = f"{tmp_path}/stage"
    writers.stage_table(spark.range(3), path)
    real, left = writers._fs, [stop]

    class Stopped(Exception):
        pass

    class Files:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name in ("rename", "create", "delete"):
                left[0] -= 1
                if left[0] < 0:
                    raise Stopped
            return getattr(self.fs, name)

    monkeypatch.setattr(writers, "_fs", lambda s, p: (Files(real(s, p)[0]), real(s, p)[1]))
    with pytest.raises(Stopped):
        writers.stage_table(readers.stage_table(spark, path).filter("id > 0"), path)
    monkeypatch.setattr(writers, "_fs", real)
    decided = stop >= 2  # the manifest was moved to its place
    assert readers.stage_table(spark, path).count() == (2 if decided else 3)
    writers.stage_table(readers.stage_table(spark, path).filter("id > 1"), path)
    assert [r["id"] for r in readers.stage_table(spark, path).collect()] == [2]
    assert not [n for n in os.listdir(tmp_path) if n.endswith(("_swap", "_old"))] or stop < 2
