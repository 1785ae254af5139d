"""Workbooks read from zipped XML."""

import io
import zipfile

import pytest

from signalloom.sources import workbooks as wb

ROWS = [["a <&> b", 1.5, None, True], [None, None, None, None], ["line\nend", 2, "Ünï 文字", False], [" kept ", None, "a <&> b", None]]


def test_round_trip(spark, tmp_path):
    (tmp_path / "one.xlsx").write_bytes(wb.workbook(["name (text)", "value", "Unnamed: 2", "value"], ROWS))
    df = wb.read_workbook(spark, [str(tmp_path / "gone.xlsx"), str(tmp_path / "one.xlsx")])
    assert df.columns == ["name", "value", "value_2"]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, [("a <&> b", "1.5", "true"), ("line\nend", "2", "false"), (" kept ", None, None)]))
    with pytest.raises(FileNotFoundError):
        wb.read_workbook(spark, [str(tmp_path / "gone.xlsx")])


def test_forms_of_cells(tmp_path):
    book = wb.workbook(["x"], [])
    out = io.BytesIO()
    sheet = f"""<worksheet xmlns="{wb.MAIN[1:-1]}"><sheetData><row r="3"><c r="B3" t="inlineStr"><is><t>in</t></is></c><c r="AB3" t="str"><f>A1</f><v>calc</v></c></row>
    <row><c t="s"><v>1</v></c><c t="e"><v>#N/A</v></c></row><row r="9"><c r="A9"/></row></sheetData></worksheet>"""
    strings = f"""<sst xmlns="{wb.MAIN[1:-1]}"><si><t>x</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh sb="0" eb="1"><t>hint</t></rPh></si></sst>"""
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(out, "w") as new:
        for n in old.namelist():
            new.writestr(n, {"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": strings}.get(n, old.read(n)))
    with zipfile.ZipFile(out) as z:
        assert wb.sheets(z) == [("Sheet1", "xl/worksheets/sheet1.xml")]
        rows = list(wb.rows_of(z, "xl/worksheets/sheet1.xml", wb.shared_strings(z)))
    assert rows == [(3, [None, "in", *[None] * 25, "calc"]), (4, ["two runs", "#N/A"])]
    assert wb.column_of("A1") == 0 and wb.column_of("Z9") == 25 and wb.column_of("AA1") == 26


def test_broken_files_and_limits(spark, tmp_path):
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "odd.xlsx").write_bytes(wb.workbook(["x"], [[1]])[:-30])
    found = wb.scan(spark, str(tmp_path)).collect()
    assert len(found) == 2 and all(r.error and r.row is None for r in found)
    with pytest.raises(ValueError, match="bad.xlsx"):
        wb.read_workbook(spark, [str(tmp_path / "bad.xlsx")])
    written = wb.write_workbooks(spark.range(25).coalesce(1), str(tmp_path / "out"), 10).collect()
    assert [r.n_rows for r in written] == [10, 10, 5]
    assert sorted(int(r.id) for r in wb.read_workbook(spark, [str(tmp_path / "out")]).collect()) == list(range(25))
