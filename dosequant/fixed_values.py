"""Fixed values.

Everything here must equal the published rules for results to agree: word
lists, code tables, patterns and formats. No logic lives in this file.
"""

# Forms that are solid but measured continuously, so their quantity is in grammes.
SOLID_FORMS = (
    "Wash",
    "Granules",
    "Paste",
    "Rectal ointment",
    "Stick",
    "Cream",
    "Oromucosal gel",
    "Oral gel",
    "Powder",
    "Nasal ointment",
    "Poultice",
    "Eye gel",
    "Vaginal gel",
    "Eye ointment",
    "Powder for solution for iontophoresis",
    "Effervescent powder",
    "Impregnated dressing",
    "Effervescent granules",
    "Gastro-resistant granules",
    "Gel",
    "Ointment",
    "Foam",
)

# Unit spellings -> (unit used here, divisors, multiplier). Two divisors mean two
# divisions in a row, so that doubles agree bit for bit.
UNIT_RULES = {
    ("mega u", "u"): ("unit dose", (1000.0,), None),
    ("mcg", "microgram"): ("g", (1000.0, 1000.0), None),
    ("mg",): ("g", (1000.0,), None),
    ("gramme", "gram"): ("g", (), None),
    ("te",): ("unit dose", (), 1000.0),
    ("puffs",): ("dose", (), None),
    ("microlitre",): ("ml", (1000.0,), None),
    ("litre",): ("ml", (), 1000.0),
}

# Units an ADQ may be given in once normalised; used to keep the strength
# pattern a constant for every usual unit.
ADQ_UNITS = ("g", "ml", "unit", "unit dose", "dose")

# Standard quantity unit codes of the dispensing files.
SQU_LABELS = {0: "individual", 1: "unit", 3: "ml", 6: "g"}

# Preparation class of appliances, which have no quantity unit.
APPLIANCE_CLASS = 4

# How link texts of the monthly files begin, and what their address contains.
MONTH_PREFIXES = (
    "Jan", "Feb", "Mar", "Apr", "May", "Jun",
    "Jul", "Aug", "Sept", "Oct", "Nov", "Dec",
)
SHEET_EXTENSION = "xls"

# Doses per pack in a presentation name: "…50mcg(60D)", "…mcg120D", "1g/D 14g".
DOSE_PATTERN = r"^.*(?:(?:\b|mg|mcg|ml)(\d+) ?D\b|\d.{1,5}/D (\d+))"

# Liquid ibuprofen presentations whose ADQ unit is published wrongly.
IBUPROFEN_LIQUID_PATTERN = "1001010J0....BH"

# Published usage above this is reported as improbably high.
HIGH_USAGE = 500

# Columns kept for the one-row-per-presentation table.
PRESENTATION_COLUMNS = (
    "bnf_code",
    "name",
    "form_size",
    "unit_of_measure",
    "adq_value",
    "adq_denominator",
    "quantity_denominator",
    "adq_per_quantity",
)

# Cell texts a CSV reader takes as missing (the default list of pandas.read_csv).
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Date stamp of output names.
RUN_DATE_FORMAT = "yyyy_MM_dd"
