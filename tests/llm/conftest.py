import pytest


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long_text = " ".join(f"w{i}" for i in range(30_000))
    base = " ".join(f"tok{i}" for i in range(120))
    near = base.replace("tok50", "other")
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, near, "fr", None), (4, None, None, None), (None, "alone and lost here", "en", "b"),
        (5, "", "en", "b"), (6, "  \n \t ", "de", "b"), (7, long_text, "en", "c"), (8, "one two", "en", "c"), (9, "one two", "en", "c"),
        (10, f"{base}\nreport 17 was sent to the main office today\nsecond line of ten", "en", "d"),
        (11, "short text first\nreport 99 was sent to the main office today", "en", "d"), (12, "żółć ñandú Ünïcode 日本 token", "pl", "d"),
    ]
    extra = [(*r, "x", 0, 1.0) for r in rows]
    return spark.createDataFrame(extra, "doc_id bigint, text string, lang string, source string, n_lines string, n_hit int, copies double").repartition(3)


@pytest.fixture(scope="session")
def empty(hard):
    return hard.limit(0)
