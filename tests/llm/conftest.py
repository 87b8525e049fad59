"""Small document tables with everything that may go wrong in them."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, syllables="ba ko ri den tal mer so vi un eau lich est ar".split()):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    base, other = prose(1, 120), prose(2, 300)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base, "en", "a", 1), (2, base, None, None, None), (3, " ".join(near), "en", "a", 1), (4, None, "fr", "b", None), (5, "", "fr", "b", 0), (6, "... !!! ---", "fr", "b", 9),
        (7, other, "fr", "b", 1), (8, other[:400] + " " + prose(3, 50), "fr", "b", 1), (9, "Élan çà et là été", "fr", "b", 1), (10, "two words", "en", "a", 9), (11, prose(4, 30_000), "en", "a", 1),
        (12, "日本語 のテキスト です", "en", "a", 1), (13, base.upper(), "en", "a", 1), (14, "ab " * 400, "en", "a", 1), (15, "two words", "en", "a", 9), (16, "x" * 5000, "en", "a", 1), (None, base, "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Nulls in every column, empty and long texts, copies, and columns that operators use inside."""
    frame = spark.createDataFrame(odd_rows, SCHEMA)
    for name in ("ids", "score", "spans", "_spans", "rep", "k1", "bands", "lang_pred", "item_id", "gram", "row", "class_id"):
        frame = frame.selectExpr("*", f"'kept' AS `{name}`")
    return frame
