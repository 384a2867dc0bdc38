import random

import pytest


@pytest.fixture
def docs(spark):
    """Rows that every operator on documents must take: nulls, empty and long texts, repeated rows,
    copies, and extra columns whose names an operator might use itself."""
    rng = random.Random(7)
    words = ["the", "of", "house", "Grün", "été", "niño", "x1", "and,", "end."]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))
    base = text(120)
    rows = [(i, text(rng.randrange(1, 80)), "en", i) for i in range(40)]
    rows += [(100, base, "en", 1), (101, base, "en", 2), (102, base + " tail one", None, 3), (103, " ".join(base.split()[4:]), "en", 4)]
    rows += [(200, None, "en", 1), (201, "", None, 1), (202, "   \n\t ", "en", None), (203, "123 !!", "en", 1), (204, "one", "en", 1), (205, "a b c d", "fr", 1)]
    rows += [(None, base, "en", 1), (None, None, None, None), (300, text(30_000), "de", 1), (301, "x" * 50_000, "en", 1)]
    rows += [(400, "again and again " * 9, "en", 1), (400, "again and again " * 9, "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens long").selectExpr("*", "'s' AS source", "1L AS start", "2 AS part", "3L AS id", "4.0D AS score", "'p' AS path", "length(text) AS n_chars")
