import pytest

CLASH = "d long, t string, row int, _size int, sid int, `spans` string"


@pytest.fixture()
def documents(spark):
    """A frame of (doc_id, text) rows, with columns whose names operators use themselves."""

    def make(rows, source=None, parts=3):
        data = [(i, x, "en", (source or (lambda k: f"s{k % 3}"))(n), None if x is None else len(x), 1, "t", 2, 3, 4, "x") for n, (i, x) in enumerate(rows)]
        return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(parts)

    return make
