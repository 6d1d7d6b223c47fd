import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names the operators use inside
    *(T.StructField(name, T.StringType()) for name in (
        "node", "key", "keys", "component", "shard", "digest", "row", "score", "n_words", "kept",
        "ids", "band", "part", "predicted", "cell")),
])


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text[, lang]) rows, with extra columns of clashing names."""
    def build(rows):
        full = [(*r, *([None] * (3 - len(r))), "s", 1, *(["x"] * 15)) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)
    return build


@pytest.fixture
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows."""
    long_text = " ".join(f"word{i % 5000}x" for i in range(60_000))
    same = "one two three four five six seven eight nine ten eleven twelve"
    return [
        (1, None, None), (2, "", "en"), (3, "   \n\t ", "en"), (4, same, "en"), (5, same, None),
        (5, same, None), (6, same.upper(), "en"), (None, "a text without an id " * 3, "en"),
        (None, None, None), (7, long_text, "en"), (8, "short", "en"), (9, "Ünïcode ﷽ 漢字 \U0001F600 ́x", "xx"),
        (10, "tail\n\n", "en"), (11, " odd space\x1cchars <|endoftext|> here", "en"),
        (7, long_text + " end", "de"),
    ]
