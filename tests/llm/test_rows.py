"""Rows whose hashes clash, and a third of all rows alike."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from dosequant.llm import rows, suffix_dedup, window_dedup
from dosequant.llm.storage import written
from tests.llm.test_dedup import corpus, prose, slow_bytes


@pytest.fixture(params=["all", "some"])
def clashing_hashes(request, monkeypatch):
    """The first hash is the same for all rows, or for every fifth or so."""
    whole = rows._hashes

    def few(columns):
        first, second = whole(columns)
        return (F.lit(7).cast("long") if request.param == "all" else first % 5), second

    monkeypatch.setattr(rows, "_hashes", few)


def plain_cut(found):
    return sorted(
        (str(r.doc_id), r.n_bytes, sum(x["to"] - x["from"] for x in r.removed), len(r.removed), bytes(r.kept_bytes)) for r in found
    )


def test_cuts_with_clashing_hashes(spark, documents, clashing_hashes):
    texts = corpus()
    assert plain_cut(suffix_dedup.remove_repeated_bytes(documents(*texts)).collect()) == slow_bytes(texts)
    texts = [(1, prose(1, 40)), (2, prose(1, 40) + " end"), (3, prose(2, 40)), (4, "a b")]
    found = {r.doc_id: r.n_removed for r in window_dedup.remove_repeated_windows(documents(*texts)).collect()}
    assert found == {1: 0, 2: 40, 3: 0, 4: 0}


def test_no_document_is_dropped_for_a_clash(spark, documents, clashing_hashes, tmp_path):
    stage = dict(corpus_pipeline.STAGES)
    texts = [(i, prose(100 + i, 30)) for i in range(40)] + [(50, prose(100, 30)), (51, prose(101, 30))]
    once = written(stage["simhash_near_dedup"](spark, documents(*texts), ""), "t")
    assert sorted(r.doc_id for r in once.collect()) == list(range(40))
    spark.createDataFrame([(1, prose(103, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = stage["benchmark_decontamination"](spark, once, str(tmp_path))
    assert sorted(r.doc_id for r in clean.collect()) == [i for i in range(40) if i != 3]


def test_a_third_of_all_rows_alike_without_an_id(spark, documents, set_conf, tmp_path):
    set_conf(spark__sql__autoBroadcastJoinThreshold="-1")
    same = prose(1, 80)
    texts = [(None, same)] * 300 + [(i, prose(100 + i, 30)) for i in range(600)]
    df = documents(*texts).repartition(6)
    found = suffix_dedup.remove_repeated_bytes(df).groupBy("n_bytes", F.length("kept_bytes").alias("left")).count()
    size = len(same.encode())
    assert {(r.n_bytes, r.left): r["count"] for r in found.collect()}[size, 0] == 300
    found = window_dedup.remove_repeated_windows(df).where("doc_id IS NULL").groupBy("n_words", "n_removed").count()
    assert [tuple(r) for r in found.collect()] == [(80, 0, 300)]
    spark.createDataFrame([(1, "x y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    once = written(dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, df, ""), "t")
    assert once.count() == 601
    assert dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, once, str(tmp_path)).count() == 601
