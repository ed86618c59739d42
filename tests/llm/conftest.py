import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, fp long, h long, n_words string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) pairs, with extra columns whose names the operators use themselves."""
    def make(pairs, parts=3):
        rows = [(i, t, "en", "src0", None if t is None else len(t), 7, 7, 7, 7, "x") for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return make


#: nulls, empty and blank texts, ties and repeated rows, marks outside of the basic plane, and a long text
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (5, "a"), (None, "no id"), (None, None), (6, "\U0001F600 é'll  x"),
       (7, "word " * 30000), (8, "x" * 50000)]
