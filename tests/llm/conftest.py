import pytest

from dosequant.llm import sketch

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents of (id, text) pairs."""

    def make(*rows):
        return spark.createDataFrame(
            [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCUMENTS
        )

    return make


@pytest.fixture
def clashing():
    """Add columns that are named like those the operators make."""
    names = (
        "row", "key", "route", "score", "predicted", "figures", "windows", "spans", "fp", "ids", "host",
        "n_words", "_row", "_document", "_text", "_words", "text_2", "removed", "kept_text", "weight", "at",
    )

    def add(df):
        for name in names:
            df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return add


@pytest.fixture(autouse=True)
def small_sketch(monkeypatch):
    """Less to merge: the texts of the tests hit few cells."""
    monkeypatch.setattr(sketch, "CELL_BITS", 18)
