"""The pipeline, stage by stage, against brute force."""

import os

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from dosequant.llm import queries, unigram
from dosequant.llm.storage import written
from tests.llm.test_dedup import slow_bytes, slow_fingerprint, slow_groups, slow_shared

SMALL = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages(spark):
    read = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
    docs = read("documents").withColumn("_row", F.lit(1)).withColumn("score", F.lit("s"))
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    labels = {r.doc_id: r.quality for r in read("labels").collect()}

    kept = written(stage["quality_classifier"](spark, docs, SMALL), "t")
    assert kept.columns == columns
    ids = {i for i, _ in pairs(kept)}
    right = [(i in ids) == (q == 1) for i, q in labels.items()]
    assert sum(right) >= 0.95 * len(right)

    rows = pairs(kept)
    groups = slow_groups([slow_fingerprint(t) for _, t in rows])
    least = {}
    for (i, _), g in zip(rows, groups):
        least[g] = min(i, least.get(g, i))
    once = written(stage["simhash_near_dedup"](spark, kept, SMALL), "t")
    assert once.columns == columns
    assert pairs(once) == [r for r in rows if r[0] in least.values()]

    cut = written(stage["suffix_array_dedup"](spark, once, SMALL), "t")
    assert cut.columns == columns
    expected = {r[0]: r for r in slow_bytes(pairs(once))}
    text = {i: expected[str(i)][4].decode("utf-8", "ignore") for i, _ in pairs(once)}
    gone = {i for i in text if expected[str(i)][2] and not text[i].strip()}
    assert pairs(cut) == sorted((i, t) for i, t in text.items() if i not in gone)
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    clean = written(stage["benchmark_decontamination"](spark, cut, SMALL), "t")
    assert clean.columns == columns
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    hit = {int(r[0]) for r in slow_shared(pairs(cut), items) if r[2]}
    assert pairs(clean) == [r for r in pairs(cut) if r[0] not in hit]

    coded = stage["sentencepiece"](spark, clean, SMALL)
    assert coded.columns == [*columns, "n_ids", "ids"]
    assert pairs(coded) == pairs(clean)
    assert pairs(corpus_pipeline.run(spark, SMALL)) == pairs(coded)


def test_odd_documents(spark, tmp_path):
    long = " ".join(f"the word{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (None, "the cat sat on the mat"), (None, "the cat sat on the mat"), (3, long), (3, long), (4, "the end")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "nothing like the others at all in any of the other texts")], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "3", "4", "None", "None"]
    empty = tmp_path / "empty"
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.where("false").write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).collect() == []


def test_no_text_vanishes_for_its_id(spark, documents):
    text = [" ".join(f"t{k}word{i}" for i in range(60)) for k in range(4)]
    rows = [(None, text[0]), (None, text[0]), (7, text[1]), (3, text[1]), (7, text[2]), (8, text[3]), (8, text[3])]
    rows += [(None, text[3]), (None, "short"), (None, "short"), (None, None)]
    stage = dict(corpus_pipeline.STAGES)
    once = written(stage["simhash_near_dedup"](spark, documents(*rows), ""), "t")
    cut = stage["suffix_array_dedup"](spark, once, "").collect()
    expected = [(None, text[0]), (3, text[1]), (7, text[2]), (8, text[3]), (None, "short"), (None, "short"), (None, "")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in cut))) == sorted(map(str, expected))


@pytest.mark.skipif(not os.path.exists(unigram.MODEL), reason="no vocabulary file")
def test_queries_give_a_row_per_document(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("op1_simhash", "op6_rule_ensemble", "op7_unigram", "op8_suffix_dedup", "op10_toxicity"):
        assert queries.QUERIES[name](spark, SMALL).count() == n, name
    assert queries.QUERIES["op7_unigram"](spark, SMALL).where("NOT same_text").count() == 0
