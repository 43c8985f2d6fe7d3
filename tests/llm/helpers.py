"""Small inputs for the tests of the llm operators."""

from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns that clash with names the operators use inside.
CLASH = ("id", "fp", "train", "row", "item", "key", "score", "count", "host", "tree", "word", "lengths", "members", "u", "v")

LONG = "one two three four five six seven eight nine ten " * 2000
ODD_TEXTS = [None, "", "   \n\t ", "a", "A a a", "naïve café", "the end.", "the end.", LONG, "x" * 5000, "\x00\x01 b", "日本語 テキスト", "🙂 🙂"]


def documents(spark, texts, langs=None, ids=None):
    rows = [(i if ids is None else ids[i], t, (langs or ["en"] * len(texts))[i], "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    for c in CLASH:
        df = df.selectExpr("*", f"'clash' AS `{c}`")
    return df


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows."""
    ids = [*range(len(ODD_TEXTS) - 2), None, None]
    df = documents(spark, ODD_TEXTS, [None if i % 3 == 0 else "en" for i in range(len(ODD_TEXTS))], ids)
    return df.union(df.limit(3))


def empty_documents(spark):
    return documents(spark, [])
