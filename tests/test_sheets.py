"""Wide sheets in three encodings, and dimensions that keep or break their rules."""

import pytest
from pyspark.sql.types import DateType, StringType, StructField, StructType

from threadloom.sources import sheets

SHEET = """Interest over time,,,,
"Category: all, worldwide",,,,

Ngày,Úc: (kids online),New Zealand,Week,"United Kingdom (x, y)",Ireland
2025-12-01,"1,200",<1,2025-12-07,50%,
2025-12-02,7,x,,8,9
,1,2,2025-12-21,3,4
2025-12-04,5
"""
WANT = {
    ("AU", "2025-12-01", 1200.0), ("NZ", "2025-12-01", 0.5), ("UK", "2025-12-07", 50.0), ("IE", "2025-12-07", None), ("AU", "2025-12-02", 7.0), ("NZ", "2025-12-02", None),
    ("UK", "2025-12-21", 3.0), ("IE", "2025-12-21", 4.0), ("AU", "2025-12-04", 5.0), ("NZ", "2025-12-04", None),
}


def test_wide_sheets_in_three_encodings(spark, tmp_path):
    for name in ("utf-8", "utf-8-sig", "utf-16"):
        (tmp_path / f"{name}.csv").write_bytes(SHEET.encode(name))
    got = sheets.wide_series(sheets.csv_cells(spark, str(tmp_path / "*.csv"))).collect()
    for name in ("utf-8", "utf-8-sig", "utf-16"):
        assert {(r.country, r.date, r.value) for r in got if r.source_file.endswith(f"/{name}.csv")} == WANT
    assert len(got) == 3 * len(WANT)


def test_files_that_do_not_fit_are_named(spark, tmp_path):
    (tmp_path / "bad.csv").write_bytes(b"Ng\xe0y,\xda\x63")
    with pytest.raises(Exception, match="cannot decode .*bad.csv"):
        sheets.csv_cells(spark, str(tmp_path / "bad.csv")).count()
    (tmp_path / "none.csv").write_text("date,uk,nz\n2025-01-01,1,2\n")
    with pytest.raises(Exception, match="no header row in .*none.csv"):
        sheets.wide_series(sheets.csv_cells(spark, str(tmp_path / "none.csv"))).count()


SCHEMA = StructType([StructField("window_id", StringType()), StructField("start", DateType()), StructField("end", DateType())])


@pytest.mark.parametrize(
    "rows, wrong",
    [
        ("a,2025-01-01,2025-02-01\nb,2025-02-01,2025-03-01\n", None),
        ("a,2025-01-01,2025-02-01\na,2025-02-01,2025-03-01\n", "window_id repeats: a"),
        (",2025-01-01,2025-02-01\n", "window_id is missing"),
        ("a,2025-02-01,2025-02-01\n", "start is not before end: a"),
        ("a,1 May,2025-02-01\n", "MALFORMED|PARSE|parse"),
    ],
)
def test_dimensions(spark, tmp_path, rows, wrong):
    (tmp_path / "d.csv").write_text("window_id,start,end\n" + rows)
    read = sheets.dimension(spark, str(tmp_path / "d.csv"), SCHEMA, "window_id", ("start", "end"))
    if wrong is None:
        assert [tuple(map(str, r)) for r in read.orderBy("window_id").collect()] == [("a", "2025-01-01", "2025-02-01"), ("b", "2025-02-01", "2025-03-01")]
    else:
        with pytest.raises(Exception, match=wrong):
            read.collect()


def test_a_dimension_of_other_columns_fails(spark, tmp_path):
    (tmp_path / "d.csv").write_text("id,start,end\na,2025-01-01,2025-02-01\n")
    with pytest.raises(Exception, match="(?i)header"):
        sheets.dimension(spark, str(tmp_path / "d.csv"), SCHEMA, "window_id").collect()
