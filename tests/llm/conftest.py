import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or from (doc_id, text) pairs, with extra columns whose names clash with inner ones."""

    def build(rows):
        rows = [(i, t) if t is None or isinstance(t, str) else t for i, t in enumerate(rows)]
        full = [(d, t, "en", "s", len(t or ""), "x", 7, "k", 1, "y", "n", 2) for d, t in rows]
        return spark.createDataFrame(full, DOCS + ", fp string, p int, _k string, gone int, spans string, n_removed string, `group` int").repartition(3)

    return build


#: Nulls, empties, blanks, repeats, one very long text, odd white space.
EDGES = [
    (5, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one"), (4, "one"), (None, "two words"), (6, "a\x0bb\x0cc d\x85e \x1cf"),
    (7, "lorem ipsum dolor " * 3000), (8, "Ünï çødé ß 中文 🎉 <|endoftext|> ### </turn> \\"), (4, "another text with the same id"),
]
