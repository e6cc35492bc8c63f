import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, fp string, `key` string, best string, toxic int, quality int, title string"
LONG = " ".join(f"word{i % 977}a{i % 31} the of" for i in range(40_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, ties, names that operators use."""
    extra = (7, 8, "x", "y", "z", 1, 0, "t")
    rows = [
        (1, "The cat sat on the mat. It was good.", "en", "src0", 36, *extra),
        (1, "The cat sat on the mat. It was good.", "en", "src0", 36, *extra),
        (2, "the cat sat on the mat. it was good.", None, None, None, *extra),
        (3, None, None, None, None, *[None] * 8),
        (4, "", "de", "src1", 0, *extra),
        (5, " \n\t ", "de", "src1", 4, *extra),
        (6, LONG, "en", "src0", len(LONG), *extra),
        (6, LONG + " tail", "en", "src0", len(LONG), *extra),
        (None, "A text without id, which is an idiot of a case.", "en", "src2", 10, *extra),
        (7, "Ünï ©ödé 日本語 text 🎉 done | a | b\r\nline", "xx", "src3", 5, *extra),
        (8, "word", "en", "src0", 4, *extra),
        (9, "AT&T%%% *** !!!", "en", "src0", 4, *extra),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
