"""A whole run on the smallest test tables, against the separate queries."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from dosequant import schemas
from dosequant.checks.registry import QUERIES, Inputs
from dosequant.operators import squ_pairs
from dosequant.plans import Release
from dosequant.sources import CsvTable, MonthlyFiles

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(str(tuple(row)) for row in df.select(*sorted(df.columns)).collect())


def test_release(spark, tmp_path):
    inputs = Inputs(spark, SMALL)
    names = ("lookup_form", "lookup_indicator", "lookup_unit")
    dictionary = {name: inputs.relation(name) for name in names}
    dictionary |= {
        name: inputs.relation(f"dmd_{name}") for name in ("product", "vmp", "vpi", "dform")
    }
    release = Release(spark, str(tmp_path), date(2018, 8, 30))
    summary = release.run(
        dictionary,
        inputs.relation("dispensing"),
        inputs.relation("prescribing"),
        inputs.relation("adq_sheet"),
    )
    for name, query in {
        "products": "product_details",
        "squs": "squ_latest",
        "provided_adqs": "representative_presentation",
        "computed_adqs": "computed_adqs",
        "presentations": "adq_by_presentation",
        "comparison": "usage_comparison",
        "delta": "usage_delta",
        "high": "high_usage",
        "practice_usage": "practice_usage",
        "rejects": "reject_report",
    }.items():
        assert rows(release.read(name)) == rows(QUERIES[query](spark, SMALL)), name
    figures = QUERIES["qa_summary"](spark, SMALL)
    assert rows(summary.drop("n_ibuprofen")) == rows(figures.drop("n_ibuprofen"))


def small_run(spark):
    """The arguments of a run over a handful of rows."""
    make = spark.createDataFrame
    dictionary = dict(
        product=make([("A", "a", 1)], schemas.DMD_PRODUCT),
        vmp=make([(1, 1, 1.0, 1, 2)], schemas.DMD_VMP),
        vpi=make([(1, 5.0, 3, None, None)], schemas.DMD_VPI),
        dform=make([(1, 1)], schemas.DMD_DFORM),
        lookup_form=make([(1, "Capsule")], schemas.DMD_LOOKUP),
        lookup_indicator=make([(1, "Discrete")], schemas.DMD_LOOKUP),
        lookup_unit=make([(1, "capsule"), (2, "capsule"), (3, "mg")], schemas.DMD_LOOKUP),
    )
    day = date(2018, 1, 1)
    return dict(
        dictionary=dictionary,
        dispensing=make([("A", 1, 1, day), ("A", 3, 1, date(2017, 1, 1))], schemas.DISPENSING),
        prescribing=make([("P", "A", "a", 1, 2, 3.0)], schemas.PRESCRIBING),
        adq_sheet=make([("A", "a 5mg", "10", "mg")], schemas.ADQ_SHEET),
    )


def test_csv_and_choice_of_squs(spark, tmp_path):
    release = Release(spark, str(tmp_path), date(2018, 8, 30), csv=True)
    release.run(**small_run(spark), squs=squ_pairs)
    assert sorted(r.squ for r in release.read("squs").collect()) == ["ml", "unit"]
    text = spark.read.option("header", True).csv(release.path("squs", "csv"))
    assert sorted(tuple(r) for r in text.collect()) == [("A", "ml"), ("A", "unit")]
    release.run(**small_run(spark))
    assert [r.squ for r in release.read("squs").collect()] == ["unit"]


def test_a_run_that_fails_publishes_nothing(spark, tmp_path):
    release = Release(spark, str(tmp_path), date(2018, 8, 30))
    release.run(**small_run(spark))
    before = {name: rows(release.read(name)) for name in ("products", "squs", "qa_summary")}
    changed = small_run(spark)
    changed["dispensing"] = changed["dispensing"].where("squ_code = 3")
    changed["prescribing"] = changed["prescribing"].withColumn("Quantity", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        release.run(**changed)
    assert {name: rows(release.read(name)) for name in before} == before


def test_rejects_of_a_whole_run(spark, tmp_path):
    """Inputs given as files report what their cells do not tell, and give the same tables."""
    arguments = small_run(spark)
    plain = Release(spark, str(tmp_path / "plain"), date(2018, 8, 30))
    plain.run(**arguments)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "PCA_Jan_2018.csv").write_text(
        "by BNF Code and Standard Quantity Unit\nBNF Code,Standard Quantity Unit,Preparation Class\nA,1,1\nA,1,1\nB,,1\nB,x,1\nC,7,q\n"
    )
    (tmp_path / "in" / "PCA_2018.csv").write_text("nothing\n")
    (tmp_path / "vmp.csv").write_text("vpid,df_indcd,udfs,udfs_uomcd,unit_dose_uomcd\n1,1,1.0,1,2\n2,x,1.0,1.5,2\n")
    (tmp_path / "adqs.csv").write_text("Code,Name,Value,Unit\nA,a 5mg,10,mg\nB,b,0,mg\n")
    (tmp_path / "prescribing.csv").write_text(
        "Practice_Code,BNF_Code,BNF_Description,Items,Quantity,ADQ_Usage\nP,A,a,1,2,3.0\nP,B,b,one,2,3.0\n"
    )
    arguments["dispensing"] = MonthlyFiles(spark, str(tmp_path / "in"), without_headings="skip")
    arguments["dictionary"]["vmp"] = CsvTable(spark, str(tmp_path / "vmp.csv"), schemas.DMD_VMP)
    arguments["adq_sheet"] = CsvTable(spark, str(tmp_path / "adqs.csv"), schemas.ADQ_SHEET, by_position=True)
    arguments["prescribing"] = CsvTable(spark, str(tmp_path / "prescribing.csv"), schemas.PRESCRIBING)
    release = Release(spark, str(tmp_path / "files"), date(2018, 8, 30))
    release.run(**arguments)
    for name in ("products", "squs", "computed_adqs"):
        of_a = lambda r: rows(r.read(name).where("bnf_code = 'A'"))  # noqa: B023, E731
        assert of_a(release) == of_a(plain), name
    found = {r.reject: r.n for r in release.read("rejects").collect() if r.n}
    assert found == {
        "adq_value_zero": 1, "squ_code_unknown": 1, "squ_code_unreadable": 1, "squ_code_missing": 1,
        "preparation_class_unreadable": 1, "file_without_headings": 1,
        "vmp.df_indcd_unreadable": 1, "vmp.udfs_uomcd_unreadable": 1, "prescribing.Items_unreadable": 1,
    }
    assert release.read("rejects").count() == release.read("rejects").select("reject").distinct().count()
