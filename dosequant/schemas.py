"""Declared schemas of every relation the library reads."""

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _schema(**columns):
    return StructType([StructField(name, kind) for name, kind in columns.items()])


_s, _d, _l, _i = StringType(), DoubleType(), LongType(), IntegerType()

PRODUCTS = _schema(
    bnf_code=_s, name=_s, vpid=_l, form=_s, form_indicator=_s, form_size=_d,
    form_units=_s, unit_of_measure=_s, numerator=_d, numerator_unit_of_measure=_s,
    denominator=_d, denominator_unit_of_measure=_s, ingredient_count=_l,
)

# adq_value stays text: the sheet holds numbers such as "10,000" and "N/A".
ADQ_SHEET = _schema(bnf_code=_s, bnf_name=_s, adq_value=_s, adq_denominator=_s)

SQUS = _schema(bnf_code=_s, squ=_s)

DISPENSING = _schema(
    bnf_code=_s, squ_code=_i, preparation_class=_i, month=DateType()
)

PRESCRIBING = _schema(
    Practice_Code=_s, BNF_Code=_s, BNF_Description=_s, Items=_l, Quantity=_l,
    ADQ_Usage=_d,
)

DMD_PRODUCT = _schema(bnf_code=_s, name=_s, vpid=_l)
DMD_VMP = _schema(
    vpid=_l, df_indcd=_i, udfs=_d, udfs_uomcd=_l, unit_dose_uomcd=_l
)
DMD_VPI = _schema(
    vpid=_l, strnt_nmrtr_val=_d, strnt_nmrtr_uomcd=_l, strnt_dnmtr_val=_d,
    strnt_dnmtr_uomcd=_l,
)
DMD_DFORM = _schema(vpid=_l, formcd=_l)
DMD_LOOKUP = _schema(cd=_l, desc=_s)
