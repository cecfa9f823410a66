import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from ``(doc_id, text)`` pairs, with the other columns and some that clash with names used inside."""

    def make(rows, extra=False):
        full = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows]
        frame = spark.createDataFrame(full, DOCS)
        if extra:
            clash = "key version id n w words place kept score spans label ids bucket component n_lines n_dropped _dirty_id _removed_id"
            frame = frame.selectExpr("*", *[f"'x' AS {c}" for c in clash.split()])
        return frame

    return make
