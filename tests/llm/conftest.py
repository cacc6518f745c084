import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) with a column that clashes with inner names."""

    def make(rows):
        full = [(r[0], r[1], *(list(r[2:]) + [None] * 2)[:2], len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS).selectExpr("*", "doc_id AS n", "text AS a", "1 AS score")

    return make


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
