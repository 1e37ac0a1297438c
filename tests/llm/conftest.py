import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *("en", "src0")[len(r) - 2 :])[:4] if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in full], SCHEMA)


#: Nulls in every column, empty and blank texts, a long text, repeated rows, and letters outside ASCII.
AWKWARD = [
    (1, None, None, None), (2, "", "en", None), (3, " \t\n", None, "s"), (4, "The of and the in to " * 5000, "en", "s"), (5, "Überall ist die Straße naß", "de", "s"),
    (5, "Überall ist die Straße naß", "de", "s"), (None, "no id here", "en", "s"), (None, None, None, None), (6, "日本語 \U0001f600 text", "en", "t"), (7, "\x00\x1c odd", "en", "t"),
]


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: docs(spark, rows)


@pytest.fixture(scope="session")
def awkward(spark):
    return docs(spark, AWKWARD)


@pytest.fixture(scope="session")
def empty(spark):
    return docs(spark, [])


@pytest.fixture(scope="session")
def clashing(spark):
    """Documents with columns named like results and helpers of the operators."""
    extra = {c: i for i, c in enumerate(["shard", "slot", "size", "u", "target", "fp", "root", "component", "g", "bin", "n", "kept", "score", "spans", "_row", "held_out", "x0", "rank"])}
    return spark.createDataFrame([Row(doc_id=i, text=f"some words of text {i}", lang="en", source="s", n_chars=20, **extra) for i in range(3)])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
