import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rk string, hash string, size string, score string, prints string, name string, cluster string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with extra columns of names that the operators use themselves."""
    def make(rows):
        return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), *["x"] * 7) for i, t, s in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    base = " ".join(words)
    long = " ".join(f"{words[i % 20]}{i % 977}" for i in range(30_000))
    return [
        (1, base, "a"), (2, base, "a"), (2, base, "a"), (3, None, None), (4, "", "b"), (5, " \t\n", "b"), (6, "one two", None), (7, "one two", "c"),
        (None, base, "a"), (8, long, "a"), (9, long + " end", "c"), (10, "Ünï " + base.upper() + " 𝒳", "c"), (11, base + " extra", "é"),
    ]
