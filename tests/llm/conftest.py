import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts or from (doc_id, text[, lang[, source]])."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if isinstance(r, str) or r is None else tuple(r)
            d, t, lang, source = (*r, "en", "s")[:4] if len(r) == 2 else (*r, "s")[:4] if len(r) == 3 else r
            full.append((d, t, lang, source, None if t is None else len(t)))
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    return [(0, "a b c d e f g h"), (1, None), (2, ""), (None, "null id text here now"), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (4, "word " * 30_000), (5, "é ü\n\n \t x."), (5, "other text of the same id")]
