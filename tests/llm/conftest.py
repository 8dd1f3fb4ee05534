import pytest
from pyspark.sql import types as T

#: Columns of documents, and others whose names the operators use inside.
EXTRA = ["size", "key", "n", "line_doc", "line_keep", "line_all", "mix_size", "mix_key", "mix_times", "near_key", "n_lines", "component_id", "bin_id"]
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in EXTRA])


def words(seed: int, n: int) -> str:
    out, x = [], seed
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append("w" + str((x >> 33) % 5000))
    return " ".join(out)


def document(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text)) + ("x",) * len(EXTRA)


@pytest.fixture(scope="session")
def rows():
    base = words(1, 300)
    changed = base.split()
    changed[10] = "other"
    long = "\n".join(words(s, 40) for s in range(2, 900))
    out = [document(1, base), document(2, " ".join(changed), source="b"), document(3, base.upper(), source=None), document(3, base.upper(), source=None),
           document(None, base, lang=None), document(None, None, None, None), document(4, None), document(5, ""), document(6, "  \n\t "),
           document(7, "12345 !?"), document(8, long, source="c"), document(9, long + " more"), document(10, "one\nTwo \n two\nTWO"), document(11, "Été", "fr"),
           document(12, "two words"), document(13, "Two\x0bWORDS"), document(14, words(77, 60) + "\n" + base[:900] + "\n" + words(78, 50))]
    return out + [document(100 + i, f"Shared Line \n{words(1000 + i, 20)}", source="b") for i in range(12)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
