import pytest

#: Extra columns with names that the operators use inside.
EXTRA = {"rep": 1, "key": "k", "size": 2.5, "uid": 9, "u": 0, "shard": "x", "target": 1, "score": 0.5, "component": 3, "digest": "d", "l": 1, "node": 2}


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=False):
        """rows: (doc_id, text) or (doc_id, text, source)."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        df = spark.createDataFrame(full, schema)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({k: F.lit(v) for k, v in EXTRA.items()})
        return df

    return make


#: Nulls, empty and blank texts, ties, repeated rows, non-ASCII and a very long text.
HARD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "Hello World"),
    (5, "hello world"),
    (5, "hello world"),
    (6, "ÉCOLE été"),
    (7, "école été"),
    (8, "word " * 50_000),
    (None, "orphan text"),
    (None, None),
    (9, "x" * 200_000),
]


@pytest.fixture
def hard():
    return HARD
