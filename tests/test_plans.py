"""What Spark makes of the operators: shuffles, pushed filters, hot keys."""

import re

import pytest
from pyspark.sql import functions as F

from dosequant import schemas
from dosequant.checks.registry import QUERIES
from dosequant.operators import (
    practice_usage,
    product_details,
    representative_presentation,
    squ_latest,
    squ_pairs,
)
from dosequant.operators.skew import join_apart
from dosequant.plans import adq_by_presentation, adq_inputs, computed_adqs

SMALL = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def finished(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(spark, name):
    plan = planned(QUERIES[name](spark, SMALL))
    for operator in ("EvalPython", "InPandas", "CartesianProduct", "NestedLoopJoin"):
        assert operator not in plan


def test_usage_is_shuffled_by_code_and_by_practice_only(spark):
    """The figures are written first, so the reduced rows need no shuffle for the join."""
    plan = planned(QUERIES["practice_usage"](spark, SMALL))
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan


def test_only_first_rows_are_shuffled(spark):
    plan = planned(QUERIES["representative_presentation"](spark, SMALL))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_monthly_rows_are_combined_before_the_shuffle(spark):
    for name in ("squ_pairs", "squ_latest"):
        plan = planned(QUERIES[name](spark, SMALL))
        assert "Sort" not in plan
        assert plan.count("HashAggregate") == 2
        assert plan.count("Exchange") == 1


def test_columns_and_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "prescribing")
    spark.createDataFrame([("P", "A", "a", 1, 1, 1.0)], schemas.PRESCRIBING).write.parquet(path)
    figures = spark.createDataFrame([("A", 1.0)], "bnf_code string, adq_per_quantity double")
    plan = planned(practice_usage(spark.read.parquet(path), figures))
    assert "ReadSchema: struct<Practice_Code:string,BNF_Code:string,Items:bigint,Quantity:bigint>" in plan
    # the first shuffle above the scan carries sums, not rows of the table
    below = plan.partition("FileScan")[0].rpartition("Exchange hashpartitioning(Practice_Code")[2]
    assert "partial_sum" in below and "Exchange" not in below
    plan = planned(representative_presentation(spark.read.parquet(path)))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(ADQ_Usage,0.0\)", plan)
    dispensing = str(tmp_path / "dispensing")
    spark.createDataFrame([("A", 1, 1, None)], schemas.DISPENSING).write.parquet(dispensing)
    plan = planned(squ_pairs(spark.read.parquet(dispensing)))
    assert re.search(r"PushedFilters: \[[^\]]*IsNotNull\(bnf_code\)", plan)
    assert re.search(r"PushedFilters: \[[^\]]*In\(squ_code, \[0,1,3,6\]\)", plan)


def hot_and_cold(spark, rows):
    return spark.range(rows).selectExpr(
        f"CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('c', id % 997) END AS bnf_code", "id"
    )


SKEWED = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20KB",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "20KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
}


def test_hot_key_is_split_between_grouped_sides(spark, set_conf):
    """Both neighbours of the join are grouped by the joined key."""
    set_conf(**SKEWED)
    many = hot_and_cold(spark, 60_000).repartition(8)
    one = many.groupBy("bnf_code").agg(F.max("id").alias("top"))
    figures = [F.count("*").alias("n"), F.sum(F.hash("id", "top")).alias("rows")]
    joined = join_apart(many, one, "bnf_code").groupBy("bnf_code").agg(*figures)
    assert "SortMergeJoin(skew=true)" in finished(joined)
    plain = many.join(one, "bnf_code").groupBy("bnf_code").agg(*figures)
    assert "skew=true" not in finished(plain)
    assert sorted(joined.collect()) == sorted(plain.collect())


def test_missing_keys_never_meet(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, l int")
    right = spark.createDataFrame([("a", 3), (None, 4)], "k string, r int")
    assert [tuple(r) for r in join_apart(left, right, "k").collect()] == [("a", 1, 3)]
    kept = join_apart(left, right, "k", how="left").collect()
    assert sorted(map(str, map(tuple, kept))) == ["('a', 1, 3)", "(None, 2, None)"]


def test_hot_prescribing_code_is_summed_before_any_shuffle(spark, set_conf):
    """No join on the rows of a hot code is left to split: a row per practice goes in."""
    set_conf(**SKEWED)
    rows = hot_and_cold(spark, 60_000).repartition(8).selectExpr(
        "concat('P', id % 50) AS Practice_Code", "bnf_code AS BNF_Code", "1L AS Items",
        "id AS Quantity",
    )
    figures = rows.groupBy(F.col("BNF_Code").alias("bnf_code")).agg(
        F.lit(0.5).alias("adq_per_quantity")
    )
    usage = practice_usage(rows, figures)
    plan = finished(usage)
    written = re.findall(r"Exchange hashpartitioning\(Practice_Code[^\n]*\n[^\n]*", plan)
    assert written and "partial_sum" in written[-1]
    assert sum(r.adq_usage for r in usage.collect()) == 59_999 * 30_000 / 2


def test_hot_product_code_is_split(spark, set_conf):
    set_conf(**SKEWED)
    products = hot_and_cold(spark, 30_000).repartition(8).selectExpr(
        "bnf_code", "concat('n', id) AS name", "id AS vpid", "'Capsule' AS form",
        "'Discrete' AS form_indicator", "1D AS form_size", "'capsule' AS form_units",
        "'capsule' AS unit_of_measure", "cast(id AS double) AS numerator",
        "'mg' AS numerator_unit_of_measure", "1D AS denominator",
        "'ml' AS denominator_unit_of_measure", "1L AS ingredient_count",
    )
    codes = hot_and_cold(spark, 3_000).select("bnf_code").distinct()
    squs = codes.withColumn("squ", F.lit("unit"))
    sheet = codes.selectExpr("bnf_code", "'Thing 5mg'", "'1,000'", "'mg'")
    computed = computed_adqs(adq_inputs(products, squs, sheet))
    collapsed = adq_by_presentation(computed)
    assert "SortMergeJoin(skew=true)" in finished(collapsed)
    found = {r.bnf_code: r.name for r in collapsed.collect()}
    assert found["hot"] == "n0" and len(found) == codes.count()

def test_hot_dictionary_keys_are_split(spark, set_conf):
    """One medicinal product has a third of all strengths, another of all products."""
    set_conf(**SKEWED)
    product = spark.range(30_000).selectExpr(
        "concat('c', id) AS bnf_code", "sha1(cast(id AS string)) AS name",
        "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 997 END AS vpid",
    ).where("vpid <> 2").repartition(8)
    vpi = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 2 ELSE id % 499 + 10 END AS vpid",
        "id / 7 AS strnt_nmrtr_val", "id % 2 AS strnt_nmrtr_uomcd",
        "cast(id AS double) AS strnt_dnmtr_val", "1L AS strnt_dnmtr_uomcd",
    ).unionByName(
        spark.range(5).selectExpr(
            "1L AS vpid", "id / 3 AS strnt_nmrtr_val", "0L AS strnt_nmrtr_uomcd",
            "1D AS strnt_dnmtr_val", "1L AS strnt_dnmtr_uomcd",
        )
    )
    product = product.unionByName(
        spark.range(3).selectExpr("concat('h', id) AS bnf_code", "'hot' AS name", "2L AS vpid")
    )
    vmp = spark.range(997).selectExpr(
        "id AS vpid", "1 AS df_indcd", "1D AS udfs", "0L AS udfs_uomcd", "1L AS unit_dose_uomcd"
    )
    dform = spark.range(997).selectExpr("id AS vpid", "id % 2 AS formcd")

    def lookup(*texts):
        return spark.createDataFrame(list(enumerate(texts)), schemas.DMD_LOOKUP)

    details = product_details(
        product, vmp, vpi, dform, lookup("Capsule", "Cream"), lookup("a", "Discrete"),
        lookup("mg", "ml"),
    )
    plan = finished(details)
    assert plan.count("SortMergeJoin(skew=true)") >= 2
    for name, df in {"product": product, "vmp": vmp, "vpi": vpi, "dform": dform}.items():
        df.createOrReplaceTempView(f"hot_{name}")
    expected = spark.sql("""
        SELECT count(*) AS n, sum(hash(bnf_code, name, p.vpid, strnt_nmrtr_val, strnt_dnmtr_val, c.n))
        FROM hot_product p JOIN hot_vmp USING (vpid) JOIN hot_dform USING (vpid)
        LEFT JOIN hot_vpi i ON i.vpid = p.vpid
        LEFT JOIN (SELECT vpid, count(*) AS n FROM hot_vpi GROUP BY vpid) c ON c.vpid = p.vpid""")
    found = details.agg(
        F.count("*"),
        F.sum(F.hash("bnf_code", "name", "vpid", "numerator", "denominator", "ingredient_count")),
    )
    assert tuple(found.first()) == tuple(expected.first())


def test_all_queries_agree_without_broadcasts(spark, set_conf):
    names = ("product_details", "adq_by_presentation", "practice_usage", "qa_summary")
    before = {n: sorted(map(str, QUERIES[n](spark, SMALL).collect())) for n in names}
    set_conf(**SKEWED)
    for name in names:
        assert sorted(map(str, QUERIES[name](spark, SMALL).collect())) == before[name]


def test_latest_unit_of_many_months(spark):
    """Against a plain window over the same rows."""
    rows = spark.range(20_000).selectExpr(
        "concat('c', id % 50) AS bnf_code",
        "element_at(array(0, 1, 3, 6), cast(hash(id) % 2 + 3 AS int)) AS squ_code",
        "1 AS preparation_class",
        "add_months(date'1969-01-01', cast(pmod(hash(id, 1), 100) AS int)) AS month",
    )
    rows.createOrReplaceTempView("months")
    expected = spark.sql("""
        SELECT bnf_code, element_at(map(0, 'individual', 1, 'unit', 3, 'ml', 6, 'g'), squ_code)
        FROM (SELECT *, row_number() OVER (PARTITION BY bnf_code
                                           ORDER BY month DESC, squ_code DESC) AS rn FROM months)
        WHERE rn = 1""")
    assert sorted(map(tuple, squ_latest(rows).collect())) == sorted(map(tuple, expected.collect()))
