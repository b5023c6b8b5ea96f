import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    """Documents with NULLs, empty and blank texts, repeated rows, ties, a very long text and clashing columns."""
    long_text = " ".join(f"word{i % 977} longer{i % 13}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "plain words stand here and go on"), (4, "plain words stand here and go on"),
            (5, "plain  words stand here and go on"), (None, "plain words stand here and go on"), (None, None),
            (6, long_text), (7, "x"), (8, "Ünïcode 漢字 🙂 text"), (9, long_text + " end")]
    table = spark.createDataFrame([(i, t, None, "src", None) for i, t in rows], DOCS)
    clash = {"kept": 1, "score": 2.0, "_row": 3, "__id": 4, "_text": "t", "text_hash": 5, "ids": 6, "label": 7}
    from pyspark.sql import functions as F

    return table.withColumns({k: F.lit(v) for k, v in clash.items()})


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)
