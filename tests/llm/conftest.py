import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves, as extra columns.
CLASHING = "body string, sig string, keys string, sketch string, a int, b int, t int, key int, host string, score double, rule string, kind string, row int, item_id int, count int, n int, group_id long, kept int, tokens string"


def rows_of(texts):
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    def build(texts, ids=None, extra=False):
        rows = rows_of(texts)
        if ids is not None:
            rows = [(i, *r[1:]) for i, r in zip(ids, rows)]
        schema = COLUMNS
        if extra:
            names = CLASHING.split(", ")
            rows = [r + (None,) * len(names) for r in rows]
            schema += ", " + CLASHING
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def messy(make):
    """Null ids and texts, empty, blank, wordless and very long texts, repeated rows, odd characters and clashing columns."""
    long = "lorem ipsum dolor sit amet consectetur " * 30_000
    texts = ["plain words here", None, "", "   \n\t", "!!! ??? ...", "plain words here", long, "éß\U0001f600 你好 ​\x00nul", "plain words here", "x" * 300_000, "1 2 3 4 5 6 7 8 9", "@", "word\n\n\nword"]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, None, 9, 10, 11, 0]
    return make(texts, ids, extra=True)


@pytest.fixture(scope="session")
def none(make, spark):
    return spark.createDataFrame([], COLUMNS)
