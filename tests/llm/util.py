"""Small tables for the operators' edge cases."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and long texts, ties and repeated rows."""
    rng = random.Random(7)
    long = words(rng, 6000)
    rows = [
        (1, "One fish, two fish. Red fish, blue fish.", "en", "a", 10),
        (2, "ONE FISH, two fish. Red fish, blue fish.", "en", "a", 10),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \t\r\n ", "en", "b", 5),
        (6, long, "fr", "b", len(long)),
        (7, long, "fr", None, len(long)),
        (7, long, "fr", None, len(long)),
        (8, "12345 67890 !!", None, "c", 14),
        (None, "a row without an id", "en", "c", 19),
        (9, "É accents aren't folded: é É", "fr", "a", 20),
        (10, "é accents aren't folded: é É", "fr", "a", 20),
        (11, "nul\u0000byte and 💡 and no-break space", "en", "a", 20),
    ]
    return rows + [(100 + i, words(rng, rng.randint(0, 60)), "en", rng.choice("abc"), 0) for i in range(60)]


def table(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, DOCS)
