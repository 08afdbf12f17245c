import pytest

#: Nulls in every column, an empty and a very long text, repeated rows, and columns whose names clash.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, spans string, node string, license string, shard int, ids string, _key long"
PROSE = "The quick survey of river towns found that old mills were turned into homes, schools and small museums by the people who had worked in them."


@pytest.fixture(scope="session")
def odd(spark):
    long = " ".join(f"word{i} and the" for i in range(20_000))
    rows = [
        (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, PROSE + " Twice told.", "en", None), (3, None, "en", "a"), (4, "", None, "a"), (None, "La rivière et le moulin de la ville", "fr", "b"),
        (5, "1234 %%%", "fr", "b"), (6, long, "en", "b"), (7, "\n\n \t", None, None), (8, "日本語 текст 🎉 ok", None, "c"), (9, "x", "de", "c"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 0.5, "k", "s", "n", "l", 7, "i", 9) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
