import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * (seed + 3) + i) % len(WORDS)] + str((seed * i) % 17) for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and wordless texts, a very long one, ties and repeated rows."""
    base = prose(1, 60)
    return [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " one more", "en", "b", 1), (4, None, "en", "a", 0), (5, "", "fr", "b", 0), (6, " \t\n", None, None, 3),
        (None, prose(2, 40), None, None, None), (7, "Short Text", "en", None, 1), (8, "short text", "de", "c", 1), (9, prose(5, 6000), "fr", "c", 1), (10, "é\x1cß 漢字 mot", "fr", "c", 1), (11, "  12 34", None, "a", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows, with further columns whose names clash with those the operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("size", "taken", "score", "_key", "_row", "row", "spans", "pii_spans", "_letters", "key", "kinds", "set_id", "target")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
