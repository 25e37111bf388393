import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "extra string, doc_id long, text string, lang string, source string, n_chars long, part int, id string, h long, rep long, features string"


def lower(text):
    return (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = "".join(f"Word{i % 97} und{i % 89}, " for i in range(20_000))
    line = "This one line of plain text stands in several documents and is long enough. "
    texts = [None, "", " \n\t ", "a", "two words", "one two three four five", line, line, line + "x", "tail " + line, long, long + "end", "x" * 30_000, "é" * 60, "ß ü é 1 2 3", "!!! ??? ...", line * 40, "  two   spaces  "]
    rows = [(None if i % 2 else "e", i, t, None if i % 3 == 0 else "en" if i % 2 else "de", None if i % 4 == 0 else "s", len(t or ""), 1, "c", 2, 3, "f") for i, t in enumerate(texts)]
    return [*rows, rows[8], rows[8], ("e", None, line, "en", "s", 3, 1, "c", 2, 3, "f")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real(spark):
    """doc_id -> text of the smallest table."""
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
