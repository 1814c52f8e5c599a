"""One query per operator over the test tables, and the same in SQL where it can say it."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dosequant.llm import (
    bottom_k,
    collocations,
    html_text,
    labelled,
    link_trust,
    merkle,
    quality_rules,
    rule_ensemble,
    simhash,
    suffix_dedup,
    toxicity,
    unigram,
    window_dedup,
    winnowing,
)

#: The rules of the URL filter.
URL_RULES = (
    link_trust.Rule("block", "net", "/"),
    link_trust.Rule("allow", "example.net", "/en/"),
    link_trust.Rule("block", "example.com", "/de/"),
    link_trust.Rule("allow", "org", "/fr/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = window_dedup.remove_repeated_windows(documents)
    return cut.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_text(pages)


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = winnowing.shared_passages(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return shared.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = labelled.training_rows(documents, table(spark, sf_dir, "labels"), "quality")
    scored = rule_ensemble.score_quality(documents, rule_ensemble.fit(training))
    held_out = labelled.is_held_out(F.col("doc_id")).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted")


def op7_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = unigram.with_ids(
        documents.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)),
        unigram.Vocabulary.load(), decoded="decoded",
    )
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        "ids",
        (F.sha2(F.col("decoded").cast("binary"), 256) == F.col("_sha")).alias("same_text"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffix_dedup.remove_repeated_bytes(documents)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return cut.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge_quality(documents)
    base = [
        F.col(f"figures.{name}").alias(name)
        for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ]
    return judged.select("doc_id", *base, "base_failed", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = labelled.training_rows(documents, table(spark, sf_dir, "labels"), "toxic")
    scored = toxicity.score_toxicity(documents, toxicity.fit(training))
    held_out = labelled.is_held_out(F.col("doc_id")).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted", "n_hits")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = merkle.leaf_hash(*[lowered if c == "text" else F.col(c) for c in merkle.LEAF_COLUMNS])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    documents = documents.withColumn("_tampered", F.when(chosen, tampered))
    found = merkle.manifest(documents, carry=("_tampered",))
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("_tampered", "leaf"), F.col("witness")))
    return found.select(
        "doc_id", "leaf", "subroot", "root",
        merkle.proof_hash(F.col("witness")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_link_trust": op2_link_trust,
    "op3_window_dedup": op3_window_dedup,
    "op4_html_text": op4_html_text,
    "op5_winnowing": op5_winnowing,
    "op6_rule_ensemble": op6_rule_ensemble,
    "op7_unigram": op7_unigram,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_merkle": op12_merkle,
    "op13_bottom_k": op13_bottom_k,
}

_STOP = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))

_WORDS5 = r"""list_filter(regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""



def _collocations_sql() -> str:
    """All phrases counted, all cuts, and every part of every longer phrase."""
    counted = " UNION ALL ".join(
        f"SELECT lang, {m} AS m, array_to_string(list_slice(w, i, i + {m - 1}), ' ') AS p "
        f"FROM (SELECT lang, w, unnest(range(1, len(w) - {m - 2})) AS i FROM pieces)"
        for m in range(1, 6)
    )
    return rf"""
WITH split AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents
), pieces AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM split),
f AS (SELECT lang, m, p, count(*) AS f FROM ({counted}) GROUP BY lang, m, p),
total AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, p, string_split(p, ' ') AS w, f AS a FROM f WHERE m > 1 AND f >= 100),
parts AS (
  SELECT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS p, max(a) AS longer
  FROM (SELECT lang, w, a, m, k, unnest(range(1, m - k + 2)) AS i
        FROM (SELECT lang, w, a, m, unnest(range(2, m)) AS k FROM c))
  GROUP BY ALL
), left_over AS (
  SELECT c.* FROM c LEFT JOIN parts USING (lang, p) WHERE longer IS NULL OR 100 * longer < 100 * a
), cuts AS (
  SELECT lang, p, a, k, array_to_string(list_slice(w, 1, k), ' ') AS head,
    array_to_string(list_slice(w, k + 1, m), ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM left_over)
), scored AS (
  SELECT cuts.lang, cuts.p, a, k, h.f AS l, t.f AS r, n,
    (1000::HUGEINT * a::HUGEINT * n::HUGEINT) // (h.f::HUGEINT * t.f::HUGEINT) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.p = head JOIN f t ON t.lang = cuts.lang AND t.p = rest
    JOIN total ON total.lang = cuts.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM lowest
)
SELECT lang, rank, p AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


def _merkle_sql(leaf_levels: int = 6, group_levels: int = 4) -> str:
    """All levels written out: up to 16 ** 6 rows in a group and 16 ** 4 groups."""
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = " || ".join(value(c) for c in merkle.LEAF_COLUMNS)
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tampered = " || ".join(value(lowered if c == "text" else c) for c in merkle.LEAF_COLUMNS)
    # cyclic redundancy check of the decimal digits, bit by bit
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {digits}), lambda c, b: {byte}), 4294967295)"
    steps = [
        f"""docs AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '-') AS g, sha256({leaf}) AS leaf,
    CASE WHEN {crc} % 5 = 0 THEN sha256({tampered}) END AS tampered FROM documents
)""",
        """l0 AS (
  SELECT g AS tree, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos,
    leaf AS d, id FROM docs
)""",
    ]

    def climb(name: str, levels: int) -> None:
        for i in range(levels):
            steps.append(
                f"""{name}r{i} AS (
  SELECT tree, pos // 16 AS run, string_agg(d, '' ORDER BY pos) AS t, count(*) AS many,
    sum(count(*)) OVER (PARTITION BY tree) AS n FROM {name}{i} GROUP BY tree, pos // 16
)"""
            )
            steps.append(
                f"{name}{i + 1} AS (SELECT tree, run AS pos, CASE WHEN n = 1 THEN t ELSE sha256(t) END AS d FROM {name}r{i})"
            )

    climb("l", leaf_levels)
    steps.append(
        f"s0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree <> '-', tree) - 1 AS pos, d, tree AS g FROM l{leaf_levels})"
    )
    climb("s", group_levels)
    joins, sides = [], []
    for name, levels, at in (("l", leaf_levels, "l0.pos"), ("s", group_levels, "s0.pos")):
        tree = "l0.tree" if name == "l" else "''"
        for i in range(levels):
            run = f"{name}r{i}"
            joins.append(f"JOIN {run} ON {run}.tree = {tree} AND {run}.run = {at} // {16 ** (i + 1)}")
            place = f"64 * (({at} // {16 ** i}) % 16)"
            sides.append((f"substr({run}.t, 1, {place})", f"substr({run}.t, {place} + 65)", f"{run}.n > 1"))
    proof = " || ".join(f"CASE WHEN {some} THEN {left} || {right} ELSE '' END" for left, right, some in sides)
    steps.append(
        f"""paths AS (
  SELECT docs.doc_id, docs.leaf, s0.d AS subroot, s{group_levels}.d AS root, sha256({proof}) AS proof_sha256,
    coalesce(tampered, leaf) AS f0,
    {", ".join(f"CASE WHEN {some} THEN {left} END AS a{i}, CASE WHEN {some} THEN {right} END AS b{i}" for i, (left, right, some) in enumerate(sides))}
  FROM docs JOIN l0 USING (id) JOIN s0 ON s0.g = docs.g JOIN s{group_levels} ON true
  {" ".join(joins)}
)"""
    )
    for i in range(len(sides)):
        steps.append(
            f"p{i + 1} AS (SELECT * EXCLUDE (f0), CASE WHEN a{i} IS NULL THEN f0 ELSE sha256(a{i} || f0 || b{i}) END AS f0 "
            f"FROM {'paths' if i == 0 else f'p{i}'})"
        )
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT doc_id, leaf, subroot, root, proof_sha256, f0 AS folded_root, "
        f"f0 = root AS verified FROM p{len(sides)}"
    )


ORACLES: dict[str, str] = {
    "op3_window_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest(range(0, 13)) AS k)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d)
  ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op5_winnowing": f"""
WITH d AS (SELECT doc_id, {_WORDS5} AS w FROM documents),
b AS (SELECT item_id, {_WORDS5} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n,
          unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw))
), hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit
  FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op11_collocations": _collocations_sql(),
    "op12_merkle": _merkle_sql(),
    "op9_quality_rules": rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), grams AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), often AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM often, (SELECT unnest([0, 1, 2]) AS k)
  GROUP BY doc_id
), f AS (
  SELECT doc_id, len(ws) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines,
    length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS marks,
    length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS uppers,
    len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS stops
  FROM w LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
  AND word_chars >= 1.5 * n_words AND word_chars <= 20 * n_words
  AND n_symbols <= 0.08 * word_chars AND marks <= 0.5 * n_words
  AND uppers <= 0.4 * word_chars AND stops >= 0.01 * n_words
  AND n_dup_lines <= 0.6 * n_lines AS kept
FROM f
""",
}
