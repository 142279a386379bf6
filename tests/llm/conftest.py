import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents of (doc_id, text[, source]) rows, with an extra column whose name an operator uses itself."""

    def build(rows, extra="extra"):
        full = [(r[0], r[1], None if r[0] is None else "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "kept") for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, `{extra}` string")

    return build
