"""From raw documents to token ids: five stages, each one operator of dosequant.llm.

Every stage takes the documents that its predecessor kept, whole, and returns rows
with the same columns; the last one adds token ids. Further columns of the documents
go along, whatever their names. Rows without an id are merged with near copies only
if a later stage would cut the repeated bytes from all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dosequant.llm import (
    labelled,
    rule_ensemble,
    simhash,
    suffix_dedup,
    unigram,
    winnowing,
)
from dosequant.llm.rows import row_id
from dosequant.llm.storage import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _packed(docs: DataFrame) -> DataFrame:
    """The rows as one column beside id and text, apart from names used on the way."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_document"))


def _with_text(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The packed rows with another text and its length in n_chars, if they have it."""
    replaced = {"text": F.col(text)}
    if "n_chars" in columns:
        replaced["n_chars"] = F.length(text).cast("long")
    return docs.select(*[replaced.get(c, F.col(f"_document.`{c}`")).alias(c) for c in columns])


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble takes for good. Null and empty texts are scored
    as texts without words; rows without an id or repeated are scored each. Of an empty
    table, or without labels, all rows stay."""
    training = labelled.training_rows(docs, _table(spark, sf_dir, "labels"), "quality")
    scored = rule_ensemble.score_quality(_packed(docs), rule_ensemble.fit(training))
    # a filter on the number stays above the statistics, each of which it would
    # otherwise compute again for every rule
    numbered = scored.withColumn("_number", F.monotonically_increasing_id())
    return numbered.where("predicted = 1 AND _number >= 0").select("_document.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the row with the least id, once.

    Rows are told apart by id and text. Rows without an id come after the others, by
    the hash of their text; those too short to lose bytes in the next stage all stay.
    """
    short = F.coalesce(F.octet_length("text") < suffix_dedup.SIZE, F.lit(True))
    rank = F.when(F.col("doc_id").isNotNull(), 0).when(~short, 1).otherwise(2)
    row = row_id(docs, ["doc_id", "text"])
    named = docs.select(F.struct(rank.alias("rank"), "doc_id", row.alias("row")).alias("_id"), "text")
    groups = simhash.near_duplicates(named, doc_id="_id")
    least = groups.where("_id.rank < 2 AND _id.row = component_id.row").select(F.col("_id.row").alias("_row")).distinct()
    packed = _packed(docs).withColumn("_rank", rank).withColumn("_row", row)
    # of rows alike in id and text each task passes on one
    kept = packed.where("_rank < 2").join(least, "_row", "left_semi").dropDuplicates(["_row"])
    nameless = packed.where("_rank = 2")
    return kept.select("_document.*").unionByName(nameless.select("_document.*"))


def cut_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur twice; documents that consist of
    such strings only go. A character cut in two goes as a whole."""
    cut = suffix_dedup.remove_repeated_bytes(_packed(docs), as_text=True)
    whole = (F.size("removed") == 0) | (F.trim("kept_text") != "")
    return _with_text(cut.where(whole), "kept_text", docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark. Null and empty texts share
    none and stay, as do all with an empty benchmark; repeated rows are judged alike."""
    keyed = _packed(docs).withColumn("_key", row_id(docs, ["doc_id", "text"]))
    shared = winnowing.shared_passages(
        keyed.select("_key", "text"), _table(spark, sf_dir, "benchmark"), doc_id="_key"
    )
    shared = shared.where("n_hit > 0").select("_key").distinct()
    return keyed.join(shared, "_key", "left_anti").select("_document.*")


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and the text decoded from them. A null
    text becomes an empty one, without ids; columns `ids` and `n_ids` give way."""
    packed = _packed(docs).select("text", "_document")
    coded = unigram.with_ids(packed, unigram.Vocabulary.load(), decoded="_decoded")
    columns = [c for c in docs.columns if c not in ("ids", "n_ids")]
    texts = {"text": F.col("_decoded")}
    return coded.select(
        *[texts.get(c, F.col(f"_document.`{c}`")).alias(c) for c in columns],
        F.size("ids").cast("long").alias("n_ids"),
        "ids",
    )


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("suffix_array_dedup", cut_repeated_bytes),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("sentencepiece", to_token_ids),
]

#: SQL cannot express the learned classifier and the segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on the written rows of the one before."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
