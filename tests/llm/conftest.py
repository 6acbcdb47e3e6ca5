import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts or (doc_id, text) pairs, with columns that clash with the operators' own."""

    def documents(texts, extra=False):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        frame = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            clashing = "node root bucket digest key part rank length piece score toxic base spans run first stop block kind ids".split()
            frame = frame.withColumns({c: F.lit("clash") for c in clashing})
        return frame

    return documents


@pytest.fixture(scope="session")
def corpus():
    """Texts of the smallest tables."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    return list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))


#: Null, empty, blank, tiny, repeated, odd and very long texts.
EDGES = [None, "", " \n\t ", "a", "a", "One two three. Four five six! Seven", "x" * 70_000, "word " * 30_000, "É\x1cß　日本 \U0001f600", "ABC abc", "abc ABC", "x<|endoftext|>y <|StartOfText|> <|startoftext|>", "a\u0558b \ua7cb \U0002cea4c", "start" + " " * 1_000_000 + "end"]
