import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, rep string, bucket string, score string, held string"
PROSE = " ".join(f"word{k} and some other{k % 17} thing{k % 29}" for k in range(60))
OTHER = " ".join(f"quite another{k} sentence with item{k % 13} here{k % 31}" for k in range(60))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a long one, exact and near copies, repeated rows, clashing extra columns."""
    near = PROSE.replace("word30", "changed30")
    texts = [None, "", " \t\n", "one", "1234 !!", PROSE, PROSE, near, OTHER, f"{OTHER} {PROSE}", "long " * 60_000, "ß é 日本 ퟿", "a b c"]
    data = [(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, len(t or "")) for k, t in enumerate(texts)]
    data += [data[5], (None, PROSE, None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, "x", "k", "r", "b", "s", "h") for r in data], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
