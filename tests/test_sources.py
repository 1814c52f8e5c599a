"""Files in and out, and incremental runs."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from dosequant import schemas
from dosequant.operators import reject_report, squ_latest, squ_pairs
from dosequant.plans import computed_adqs
from dosequant.sources import (
    MonthlyFiles,
    monthly_layouts,
    monthly_rejects,
    read_adq_sheet,
    read_csv_table,
    read_csv_text,
    read_monthly,
    unreadable_cells,
    write_dated,
)
from dosequant.sources.monthly import month_of_file
from dosequant.streaming import accumulate_latest_squs, accumulate_squ_pairs, latest_squs


def test_csv_cells(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        ",name,bnf_code,vpid,form,form_indicator,form_size,form_units,unit_of_measure,"
        "numerator,numerator_unit_of_measure,denominator,denominator_unit_of_measure,"
        "ingredient_count\n"
        '0,"Co ""x"" 5mg, caps",A1,14610311000001101,Capsule,nan,1.0,N/A,NULL,5,mg,,NA,1\n'
    )
    found = read_csv_table(spark, str(tmp_path / "p.csv"), schemas.PRODUCTS)
    assert found.schema == schemas.PRODUCTS
    assert [tuple(r) for r in found.collect()] == [
        ("A1", 'Co "x" 5mg, caps', 14610311000001101, "Capsule", None, 1.0, None, None, 5.0,
         "mg", None, None, 1)
    ]


def test_adq_sheet_columns_go_by_position(spark, tmp_path):
    (tmp_path / "a.csv").write_text('BNF Code,Drug,ADQ Value,ADQ Unit\nA,x,"1,000",mg\nB,y,N/A,\n')
    found = read_adq_sheet(spark, str(tmp_path / "a.csv"), schemas.ADQ_SHEET)
    assert sorted(tuple(r) for r in found.collect()) == [
        ("A", "x", "1,000", "mg"), ("B", "y", None, None),
    ]


def test_monthly_files(spark, tmp_path):
    (tmp_path / "PCA_Jan_2018.csv").write_text(
        "Prescription Cost Analysis January 2018\n"
        "BNF Code,Name,Preparation Class,Standard Quantity Unit\n"
        "A,a,1,3\nB,b,4,1\nC,c,,6\nD,d,1,\nTotal\n"
    )
    (tmp_path / "PCA Sept 2017.csv").write_text(
        "\nStandard Quantity Unit,Preparation Class,More,BNF Code\n1.0,1.0,x,A\n0,2,x,E\n"
    )
    (tmp_path / "notes.csv").write_text("BNF Code,Preparation Class,Standard Quantity Unit\nZ,1,1\n")
    found = read_monthly(spark, str(tmp_path))
    jan, sept = date(2018, 1, 1), date(2017, 9, 1)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, [
        ("A", 3, 1, jan), ("B", 1, 4, jan), ("C", 6, None, jan), ("A", 1, 1, sept),
        ("E", 0, 2, sept),
    ]))
    assert found.columns == schemas.DISPENSING.names
    assert sorted(tuple(r) for r in squ_pairs(found).collect()) == [
        ("A", "ml"), ("A", "unit"), ("C", "g"), ("E", "individual"),
    ]


def test_csv_whole_numbers_as_written_by_other_tools(spark, tmp_path):
    names = ",".join(schemas.PRODUCTS.names)
    (tmp_path / "p.csv").write_text(
        names + "\nA,a,1.0,Capsule,Discrete,2.0,capsule,capsule,5d,mg,,,1.0\n"
        "B,b,2,Capsule,Discrete,x,capsule,capsule,5,mg,,,1.5\n"
    )
    found = read_csv_table(spark, str(tmp_path / "p.csv"), schemas.PRODUCTS)
    assert [(r.vpid, r.form_size, r.numerator, r.ingredient_count) for r in found.orderBy("vpid").collect()] == [
        (1, 2.0, None, 1), (2, None, 5.0, None),
    ]
    rejects = unreadable_cells(read_csv_text(spark, str(tmp_path / "p.csv")), schemas.PRODUCTS)
    assert {r.column: r.n for r in rejects.collect() if r.n} == {
        "form_size": 1, "numerator": 1, "ingredient_count": 1,
    }
    # one ingredient in the ADQ's own unit: the strength times the form size
    one = found.where("bnf_code = 'A'").selectExpr(
        "*", "'unit' AS squ", "'A' AS bnf_name", "1D AS dose_multiplier", "2D AS adq_value",
        "'g' AS adq_denominator",
    ).drop("numerator").selectExpr("*", "5D AS numerator").drop("numerator_unit_of_measure")
    one = one.selectExpr("*", "'g' AS numerator_unit_of_measure")
    assert computed_adqs(one).first().adq_per_quantity == 5.0


def test_csv_files_with_other_headings_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("bnf_code,squ\nA,ml\nB,g\n")
    (tmp_path / "b.csv").write_text("squ,bnf_code\nml,C\n")
    with pytest.raises(Exception, match="header"):
        read_csv_table(spark, str(tmp_path), schemas.SQUS).collect()


def test_csv_cells_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('bnf_code,squ\nA,"m\nl"\nB,g\n')
    found = read_csv_table(spark, str(tmp_path), schemas.SQUS, multi_line=True)
    assert sorted(tuple(r) for r in found.collect()) == [("A", "m\nl"), ("B", "g")]


@pytest.mark.parametrize("name, month", [
    ("PCA_Sept_2018.csv", (2018, 9)), ("PCA%20Jan%202018.csv", (2018, 1)), ("PCA_Sept18", (2018, 9)),
    ("PCA_2018_Sept", (2018, 9)), ("PCA_201809", (2018, 9)), ("PCA_2018-09.csv", (2018, 9)),
    ("PCA_Summary_2018", None), ("PCA_marketing_2018", None), ("PCA_December2017", (2017, 12)), ("PCA", None),
])
def test_month_of_file(spark, name, month):
    found = spark.range(1).select(month_of_file(F.lit(name))).first()[0]
    assert found == (date(*month, 1) if month else None)


def test_monthly_files_lose_nothing(spark, tmp_path):
    wide = ",".join(f"h{i}" for i in range(70))
    (tmp_path / "PCA_Jan_2018.csv").write_text(
        f"{wide}, BNF Code , Standard Quantity Unit,Preparation Class\n" + ",".join("x" * 70) + ",W,3,1\n"
    )
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "PCA_Jan_2018.csv").write_text(
        "Preparation Class,Standard Quantity Unit,BNF Code\n1,1.7,A\n1,3d,B\n1,x,C\n1,6,D\nz,1.0,E\n1,,F\n"
    )
    found = {}
    for folder in (tmp_path, tmp_path / "old"):
        for r in read_monthly(spark, str(folder)).collect():
            found[r.bnf_code] = (r.squ_code, r.preparation_class)
    assert found == {"W": (3, 1), "A": (None, 1), "B": (None, 1), "C": (None, 1), "D": (6, 1), "E": (1, None)}
    rejects = {r.reject: r.n for r in monthly_rejects(spark, str(tmp_path / "old")).collect()}
    assert rejects == {
        "squ_code_unreadable": 3, "squ_code_missing": 1, "preparation_class_unreadable": 1,
        "file_undated": 0, "file_without_headings": 0,
    }


def test_files_of_equal_name_in_two_folders(spark, tmp_path):
    for folder, text in (("a", "BNF Code,Standard Quantity Unit\nA,3\n"), ("b", "Standard Quantity Unit,BNF Code\n1,B\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "PCA_Jan_2018.csv").write_text(text)
    found = read_monthly(spark, str(tmp_path / "*"))
    assert sorted((r.bnf_code, r.squ_code) for r in found.collect()) == [("A", 3), ("B", 1)]


def test_monthly_file_without_headings(spark, tmp_path):
    (tmp_path / "PCA_Jan_2018.csv").write_text("BNF Code,Standard Quantity Unit\nA,3\n")
    (tmp_path / "PCA_2018.csv").write_text("BNF,Unit\nB,1\n")
    with pytest.raises(ValueError, match="PCA_2018.csv"):
        read_monthly(spark, str(tmp_path))
    found = read_monthly(spark, str(tmp_path), without_headings="skip")
    assert [r.bnf_code for r in found.collect()] == ["A"]
    rejects = {r.reject: r.n for r in monthly_rejects(spark, str(tmp_path)).collect()}
    assert rejects["file_without_headings"] == 1
    given = read_monthly(spark, str(tmp_path), layout={"bnf_code": 0, "squ_code": 1})
    assert sorted(r.bnf_code for r in given.where("squ_code IS NOT NULL").collect()) == ["A", "B"]
    assert sorted(r.bnf_code for r in squ_latest(given).collect()) == ["A", "B"]
    assert given._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_monthly_parquet(spark, tmp_path):
    sheet = spark.createDataFrame(
        [("A", 1, 1.0, "x"), ("B", None, 1.0, "x"), ("C", 6, None, "x")],
        "`BNF Code` string, `Standard Quantity Unit` int, `Preparation Class` double, other string",
    )
    sheet.coalesce(1).write.parquet(str(tmp_path / "PCA_Dec_2016"))
    part = next((tmp_path / "PCA_Dec_2016").glob("part-*.parquet"))
    (tmp_path / "months").mkdir()
    (tmp_path / "months" / "PCA_Dec_2016.parquet").write_bytes(part.read_bytes())
    found = read_monthly(spark, str(tmp_path / "months"), "parquet")
    month = date(2016, 12, 1)
    assert {tuple(r) for r in found.collect()} == {("A", 1, 1, month), ("C", 6, None, month)}


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_dated_output(spark, tmp_path, file_format):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("A", 'a "quoted", text'), ("B", None)], "k string, v string")
    write_dated(rows, path, date(2018, 8, 29), file_format)
    write_dated(rows.limit(1), path, date(2018, 8, 30), file_format)
    write_dated(rows.where("k = 'C'"), path, date(2018, 8, 30), file_format)
    if file_format == "parquet":
        assert spark.read.parquet(path + "/run_date=2018-08-30").count() == 0
    write_dated(rows, path, date(2018, 8, 30), file_format)
    back = spark.read.option("header", True).option("escape", '"').format(file_format).load(path)
    assert back.columns == ["k", "v", "run_date"]
    for day in ("2018-08-29", "2018-08-30"):
        found = back.where(back.run_date == day).select("k", "v").collect()
        assert sorted(map(tuple, found)) == [("A", 'a "quoted", text'), ("B", None)]


def test_pairs_are_appended_once(spark, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    months = [
        [("A", 1, 1, date(2018, 1, 1)), ("A", 1, 1, date(2018, 1, 1)), ("B", 3, 4, date(2018, 1, 1))],
        [("A", 1, 1, date(2018, 2, 1)), ("A", 3, 1, date(2018, 2, 1)), ("C", 6, None, date(2018, 2, 1))],
    ]
    for month in months:
        spark.createDataFrame(month, schemas.DISPENSING).write.mode("append").parquet(source)
        query = accumulate_squ_pairs(spark, source, output, str(tmp_path / "progress"))
        query.awaitTermination()
        assert query.exception() is None
    streamed = sorted(tuple(r) for r in spark.read.parquet(output).collect())
    whole = squ_pairs(spark.read.schema(schemas.DISPENSING).parquet(source))
    assert streamed == sorted(tuple(r) for r in whole.collect())
    assert streamed == [("A", "ml"), ("A", "unit"), ("C", "g")]


def test_two_sources_keep_their_own_progress(spark, tmp_path):
    for name, code in (("x", "A"), ("y", "B")):
        source = str(tmp_path / name / "in")
        rows = spark.createDataFrame([(code, 1, 1, date(2018, 1, 1))], schemas.DISPENSING)
        rows.write.parquet(source)
        output, progress = str(tmp_path / name / "out"), str(tmp_path / name / "progress")
        accumulate_squ_pairs(spark, source, output, progress).awaitTermination()
        assert [tuple(r) for r in spark.read.parquet(output).collect()] == [(code, "unit")]


BANNERS = {
    "names both headings": "Prescription Cost Analysis by BNF Code and Standard Quantity Unit\nBNF Code,Preparation Class,Standard Quantity Unit\n",
    "in quotes, with commas": '"by BNF Code, Standard Quantity Unit",2018,1\nBNF Code,Preparation Class,Standard Quantity Unit\n',
    "with cells like a row": "Z,1,3\n\nBNF Code,Preparation Class,Standard Quantity Unit\n",
    "quoted headings": 'banner\n"BNF Code", "Preparation Class" ,"Standard Quantity Unit"\n',
    "quotes in headings": '"BNF ""Code"", BNF Code, Standard Quantity Unit"\nBNF Code,Preparation Class,Standard Quantity Unit\n',
    "byte order mark": "\ufeffBNF Code,Preparation Class,Standard Quantity Unit\n",
    "many lines": "line,1,1\n" * 300 + "BNF Code,Preparation Class,Standard Quantity Unit\n",
}


@pytest.mark.parametrize("banner", BANNERS)
def test_headings_below_any_banner(spark, tmp_path, banner):
    """The first line with the headings as cells counts; a later one is no row."""
    later = "Standard Quantity Unit,Preparation Class,BNF Code\n"
    text = BANNERS[banner] + 'A,1,3\n"B",2,"1"\n' + later + "C,1,6\n"
    (tmp_path / "PCA_Jan_2018.csv").write_text(text)
    assert [*monthly_layouts(spark, str(tmp_path)).values()] == [{"bnf_code": 0, "preparation_class": 1, "squ_code": 2}]
    files = MonthlyFiles(spark, str(tmp_path))
    rows = files.dispensing().where("bnf_code <> 'Standard Quantity Unit'").collect()
    assert sorted((r.bnf_code, r.squ_code, r.preparation_class) for r in rows) == [("A", 3, 1), ("B", 1, 2), ("C", 6, 1)]


def test_headings_of_a_file_in_many_splits(spark, tmp_path, set_conf):
    """The order of lines holds across splits, and settings may change in between."""
    set_conf(spark__sql__files__maxPartitionBytes="2k", spark__sql__files__openCostInBytes="1")
    lines = ["banner"] + [f"X{i},1,3" for i in range(400)]  # above the headings: no rows
    lines += ["BNF Code,Preparation Class,Standard Quantity Unit"] + [f"A{i},1,3" for i in range(2000)]
    lines += ["Standard Quantity Unit,BNF Code,Preparation Class"] + [f"B{i},1,6" for i in range(500)]
    (tmp_path / "PCA_Jan_2018.csv").write_text("\n".join(lines) + "\n")
    files = MonthlyFiles(spark, str(tmp_path))
    expected = {f"A{i}" for i in range(2000)} | {f"B{i}" for i in range(500)}
    found = files.dispensing()
    assert found.rdd.getNumPartitions() > 3
    assert {r.bnf_code for r in found.where("squ_code IS NOT NULL").collect()} == expected
    set_conf(spark__sql__files__maxPartitionBytes="7k")
    assert {r.bnf_code for r in files.dispensing().where("squ_code IS NOT NULL").collect()} == expected


def test_rows_and_rejects_of_one_scan(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "PCA_Jan_2018.csv").write_text(
        "Prescription Cost Analysis\nBNF Code,Standard Quantity Unit,Preparation Class\n"
        + "A,3,1\nA,3,1\nA,x,1\nA,x,1\nB,,1\nC,1,y\nD,9,1\n"
    )
    (tmp_path / "in" / "PCA_notes.csv").write_text("BNF Code,Standard Quantity Unit\nE,6\n")
    files = MonthlyFiles(spark, str(tmp_path / "in"))
    counted = files.counted()
    assert counted._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    counted.write.parquet(str(tmp_path / "cells"))
    kept = spark.read.parquet(str(tmp_path / "cells"))
    whole = {r.reject: r.n for r in files.rejects().collect()}
    assert whole == {r.reject: r.n for r in files.rejects(kept).collect()} == {
        "squ_code_unreadable": 2, "squ_code_missing": 1, "preparation_class_unreadable": 1, "file_undated": 1, "file_without_headings": 0,
    }
    report = lambda rows: {r.reject: r.n for r in reject_report(spark.createDataFrame([], schemas.ADQ_SHEET), rows).collect()}
    assert report(files.dispensing()) == report(files.dispensing(kept)) == {
        "adq_value_unreadable": 0, "adq_value_zero": 0, "squ_code_unknown": 1, "squ_code_unreadable": 2, "month_missing": 1,
    }
    assert sorted(map(tuple, squ_latest(files.dispensing(kept)).collect())) == [("A", "ml"), ("C", "unit"), ("E", "g")]


def test_latest_squs_month_by_month(spark, tmp_path):
    """A late month changes nothing, the larger code wins a tie, a rerun repeats itself."""
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: accumulate_latest_squs(spark, source, output, str(tmp_path / "progress")).awaitTermination()
    day = lambda m: date(2018, m, 1)
    steps = [
        ([("A", 1, 1, day(3)), ("B", 3, 1, day(3)), ("B", 1, 4, day(4))], [("A", "unit"), ("B", "ml")]),
        ([("A", 3, 1, day(1)), ("C", 6, None, None)], [("A", "unit"), ("B", "ml"), ("C", "g")]),  # late
        ([("A", 0, 1, day(3)), ("B", 6, 1, day(3))], [("A", "unit"), ("B", "g"), ("C", "g")]),  # tie
        ([("A", 3, 1, day(5)), ("C", 1, 1, day(1))], [("A", "ml"), ("B", "g"), ("C", "unit")]),
    ]
    seen = []
    for rows, expected in steps:
        spark.createDataFrame(rows, schemas.DISPENSING).write.mode("append").parquet(source)
        run()
        found = sorted(map(tuple, latest_squs(spark, output).collect()))
        assert found == expected
        seen += rows
        whole = squ_latest(spark.createDataFrame(seen, schemas.DISPENSING))
        assert found == sorted(map(tuple, whole.collect()))
    run()  # nothing new
    assert sorted(map(tuple, latest_squs(spark, output).collect())) == found
    # a batch that failed before its version was complete is not read
    spark.createDataFrame([("A", "x")], schemas.SQUS).write.parquet(f"{output}/versions/99")
    assert sorted(map(tuple, latest_squs(spark, output).collect())) == found
