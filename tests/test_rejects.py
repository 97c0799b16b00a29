"""Loads that keep rejects: reasons, files, counts, and one pass over the raw rows."""

from pyspark.sql import functions as F

from hearth.functions.numeric import to_int, to_num
from hearth.sources.rejects import MALFORMED, load_checked, read_csv_lines

LINES = ["01001,5.5,2020", "01002,n/a,2020", "01003,7,20x0", "01004,8", "01005,9,2021,extra", "01006,,2022", "01007,1d,y"]


def _rules():
    return {"no number": to_num("value").isNull() & F.col("value").isNotNull(), "no year": to_int("year").isNull()}


def test_rejects_carry_reasons_and_file(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.csv").write_text("\n".join(LINES[:4]) + "\n")
    (tmp_path / "raw" / "b.csv").write_text("\n".join(LINES[4:]) + "\n")
    raw = read_csv_lines(spark, str(tmp_path / "raw"), ["zip", "value", "year"])
    good, bad, counts = load_checked(raw, _rules(), str(tmp_path / "out"))
    assert sorted(map(tuple, good.collect())) == [("01001", "5.5", "2020"), ("01006", None, "2022")]
    got = {r.zip: (r._reasons, r._file[-5:], r._corrupt_record) for r in bad.collect()}
    assert got == {"01002": (["no number"], "a.csv", None), "01003": (["no year"], "a.csv", None),
                   "01004": ([MALFORMED], "a.csv", LINES[3]), "01005": ([MALFORMED], "b.csv", LINES[4]),
                   "01007": (["no number", "no year"], "b.csv", None)}
    assert counts == {"rows": 7, MALFORMED: 2, "no number": 2, "no year": 2}
    # the accepted side is read from its own folder, never from the raw file again
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_rejected" in plan and "csv" not in plan.lower().replace("a.csv", "")


def test_a_clean_and_an_empty_load(spark, tmp_path):
    clean = spark.createDataFrame([("1", "2", "2020")], "zip string, value string, year string")
    good, bad, counts = load_checked(clean, _rules(), str(tmp_path))
    assert good.count() == 1 and bad.count() == 0 and counts == {"rows": 1, "no number": 0, "no year": 0}
    good, bad, counts = load_checked(clean.where("false"), _rules(), str(tmp_path))
    assert good.count() == 0 and bad.count() == 0 and counts["rows"] == 0


def test_raw_files_of_the_warehouse(spark, tmp_path):
    from hearth.plans import etl
    from hearth.plans.warehouse import raw_rules
    from hearth.sources.io import read_raw_csv
    from hearth.sources.rejects import read_checked_csv
    path = tmp_path / "inc.csv"
    path.write_text("GEO_ID,S1901_C01_012E,S1901_C01_012M\nGeography,Estimate,Margin\n8600000US01001,50000,10\n8600000US01002,-,10\n"
                    "8600000US01003,,10\n8600000US01004,70000,10,extra\n8600000US01005,\"61,000\",**\n", encoding="utf-8")
    lines = read_checked_csv(spark, str(path))
    rules = raw_rules("census_income", lines.columns)
    good, bad, counts = load_checked(lines, rules, str(tmp_path / "out"))
    reason = "S1901_C01_012E is no number"
    assert counts["rows"] == 6 and counts[MALFORMED] == 1
    assert {r.GEO_ID[-5:]: r._reasons for r in bad.collect()}["01002"] == [reason]
    # what is rejected for its value gave no row before either; the longer line is rejected alone
    before = {tuple(r) for r in etl.census_income(read_raw_csv(spark, str(path))).collect()}
    assert before - {tuple(r) for r in etl.census_income(good).collect()} == {("01004", 70000.0, 10.0)}
    assert raw_rules("schools", ["LZIP"]) == raw_rules("crime", ["county"]) == raw_rules("amenities", ["a", "b"]) == {}
    assert list(raw_rules("aqi", ['"Median AQI"'])) == ["Median AQI is no number"]
    assert list(raw_rules("amenities", [f"c{i}" for i in range(22)])) == ["amenity_rank is no number"]
