"""The library's input relations, derived from the TPC-H-like test tables.

Each text is plain SQL that Spark and DuckDB read alike, so that a query and its
check start from the same rows. Every row of the test tables is used: rows that
must find no partner get a key without one instead of being filtered out.
Table names stand in braces and are filled with DataFrames or view names.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

RELATIONS = {
    "dmd_product": """
        SELECT CASE WHEN p_partkey % 50 = 0 THEN NULL
                    ELSE concat('B', cast(p_partkey AS string)) END AS bnf_code,
               p_name AS name,
               p_partkey AS vpid
        FROM {part}""",
    "dmd_vmp": """
        SELECT CASE WHEN p_partkey % 20 = 19 THEN -p_partkey ELSE p_partkey END AS vpid,
               cast(floor(p_partkey / 2) AS bigint) % 4 AS df_indcd,
               CASE WHEN p_partkey % 7 = 0 THEN NULL
                    ELSE cast(p_size AS double) / 2 END AS udfs,
               p_partkey % 9 AS udfs_uomcd,
               cast(floor(p_partkey / 3) AS bigint) % 11 AS unit_dose_uomcd
        FROM {part}""",
    "dmd_vpi": """
        SELECT DISTINCT
               CASE WHEN l_quantity <= 3 THEN l_partkey ELSE -l_partkey END AS vpid,
               l_linenumber AS ingredient,
               cast(l_linenumber AS double) * cast(1.5 AS double) AS strnt_nmrtr_val,
               (l_partkey + l_linenumber) % 11 AS strnt_nmrtr_uomcd,
               cast(1 AS double) AS strnt_dnmtr_val,
               (l_partkey * 3 + l_linenumber) % 9 AS strnt_dnmtr_uomcd
        FROM {lineitem}""",
    "dmd_dform": """
        SELECT p_partkey AS vpid,
               CASE WHEN p_partkey % 13 = 12 THEN 99 ELSE p_partkey % 5 END AS formcd
        FROM {part}
        UNION ALL
        SELECT CASE WHEN p_partkey % 17 = 0 THEN p_partkey ELSE -p_partkey END,
               (p_partkey + 1) % 5
        FROM {part}""",
    "lookup_form": """
        SELECT * FROM (VALUES (0, 'Capsule'), (1, 'Cream'), (2, 'Oral suspension'),
                              (3, 'Not applicable'), (4, 'Granules')) AS t(cd, label)""",
    "lookup_indicator": """
        SELECT * FROM (VALUES (0, 'Not applicable'), (1, 'Discrete'),
                              (2, 'Continuous')) AS t(cd, label)""",
    "lookup_unit": """
        SELECT * FROM (VALUES (0, 'mg'), (1, 'microgram'), (2, 'gram'), (3, 'ml'),
                              (4, 'litre'), (5, 'unit'), (6, 'unit dose'), (7, 'hour'),
                              (8, 'capsule')) AS t(cd, label)""",
    "adq_sheet": """
        SELECT concat('B', cast(p_partkey AS string)) AS bnf_code,
               CASE p_partkey % 4
                 WHEN 0 THEN concat(p_name, '_', p_type, ' ', cast(p_size AS string),
                                    'mcg(', cast(p_size + 1 AS string), 'D)')
                 WHEN 1 THEN concat(p_name, '_', p_type, ' ', cast(p_size AS string),
                                    'mcg', cast(p_size + 2 AS string), 'D')
                 WHEN 2 THEN concat(p_name, '_', p_type, ' 1g/D ',
                                    cast(p_size AS string), 'g')
                 ELSE concat(p_name, '_', p_type, ' ', cast(p_size AS string), 'mg')
               END AS bnf_name,
               CASE WHEN p_partkey % 8 = 0 THEN NULL
                    WHEN p_partkey % 97 = 1 THEN 'see note'
                    WHEN p_partkey % 101 = 1 THEN '0'
                    WHEN p_partkey % 3 = 0
                    THEN concat('1,0', lpad(cast(p_size AS string), 2, '0'))
                    ELSE cast(p_size AS string) END AS adq_value,
               CASE p_partkey % 10
                 WHEN 0 THEN 'mg' WHEN 1 THEN 'mcg' WHEN 2 THEN 'Gramme'
                 WHEN 3 THEN 'ml' WHEN 4 THEN 'litre' WHEN 5 THEN 'puffs'
                 WHEN 6 THEN 'dose' WHEN 7 THEN 'unit dose' WHEN 8 THEN 'TE'
                 ELSE CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE ' ' END
               END AS adq_denominator
        FROM {part}""",
    "unit_samples": """
        SELECT p_partkey AS id,
               CASE WHEN p_partkey % 3 = 0 THEN concat('1,0', lpad(cast(p_size AS string), 2, '0'))
                    ELSE cast(p_retailprice AS string) END AS number,
               CASE p_partkey % 17
                 WHEN 0 THEN 'mega u' WHEN 1 THEN 'u' WHEN 2 THEN 'mcg'
                 WHEN 3 THEN 'microgram' WHEN 4 THEN ' MG ' WHEN 5 THEN 'Gramme'
                 WHEN 6 THEN 'gram' WHEN 7 THEN 'TE' WHEN 8 THEN 'puffs'
                 WHEN 9 THEN 'microlitre' WHEN 10 THEN 'Litre' WHEN 11 THEN 'ml'
                 WHEN 12 THEN 'unit' WHEN 13 THEN 'mmol' WHEN 14 THEN 'hour'
                 WHEN 15 THEN ' ' ELSE NULL END AS unit
        FROM {part}""",
    "dispensing": """
        SELECT CASE WHEN l_partkey % 11 IN (3, 4, 5, 6)
                    THEN concat('Z', cast(l_partkey AS string))
                    ELSE concat('B', cast(l_partkey AS string)) END AS bnf_code,
               CASE WHEN l_suppkey % 53 = 1 THEN 9
                    WHEN l_suppkey % 59 = 2 THEN NULL
                    ELSE CASE l_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1
                                            WHEN 2 THEN 3 ELSE 6 END END AS squ_code,
               CASE WHEN l_linenumber = 7 AND l_suppkey % 5 = 0 THEN NULL
                    ELSE l_linenumber END AS preparation_class,
               CASE WHEN l_suppkey % 61 = 3 THEN NULL
                    ELSE make_date(year(l_shipdate), month(l_shipdate), 1) END AS month
        FROM {lineitem}""",
    "prescribing": """
        SELECT cast(l_suppkey AS string) AS Practice_Code,
               concat('B', cast(l_partkey AS string)) AS BNF_Code,
               concat('Presentation ', cast(l_partkey AS string)) AS BNF_Description,
               cast(l_linenumber AS bigint) AS Items,
               l_quantity AS Quantity,
               l_extendedprice * l_discount AS ADQ_Usage
        FROM {lineitem}""",
}

TABLES = ("part", "lineitem")


def relation(spark: SparkSession, table: Callable[[str], DataFrame], name: str) -> DataFrame:
    """A relation of `RELATIONS`; `table` gives the test tables by name."""
    text = RELATIONS[name]
    tables = {t: table(t) for t in TABLES if "{" + t + "}" in text}
    df = spark.sql(text, **tables)
    return df.withColumnRenamed("label", "desc") if name.startswith("lookup") else df


def relation_sql(name: str) -> str:
    """The same relation as SQL over views named like the tables."""
    return RELATIONS[name].format(**{table: table for table in TABLES})
