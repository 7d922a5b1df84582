import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use for columns of their own.
        T.StructField("ids", T.StringType()),
        T.StructField("near", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("score", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def shared_dir(tmp_path_factory):
    return tmp_path_factory.mktemp("shared")


@pytest.fixture(scope="session")
def make_docs(spark):
    from posevidence.llm.common import importable

    importable(spark)

    def make(rows):
        full = []
        for row in rows:
            d, text, *rest = row
            lang, source = (rest + ["en", "web"])[:2] if rest else ("en", "web")
            full.append((d, text, lang, source, len(text or ""), "x", "x", "x", "x"))
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def words():
    """Pseudo-random words from a small alphabet, always the same."""
    import random

    def draw(seed, n):
        r = random.Random(seed)
        return ["".join(r.choice("abcdeghilmnorstu") for _ in range(r.randint(2, 7))) for _ in range(n)]

    return draw


@pytest.fixture(scope="session")
def hard_rows(words):
    """Nulls, empty and blank texts, a very long one, copies and repeated rows."""
    base = words(1, 180)
    long = words(2, 9000)
    return [
        (3, " ".join(base)),
        (1, None),
        (2, ""),
        (4, " \n\t "),
        (5, " ".join(base)),
        (6, " ".join(base[:-4] + words(3, 4))),
        (7, " ".join(words(4, 60) + base[20:120] + words(5, 30))),
        (8, " ".join(long)),
        (9, "Äpfel *** über\x0bden\r\nZaun %% " + " ".join(words(6, 90))),
        (10, "a"),
        (11, "x" * 700),
        (12, "na na " * 90),
        (13, " ".join(base).upper()),
        (None, " ".join(base)),
        (14, " ".join(long[4000:4200]), None, None),
        (15, "😀" * 80 + " ende"),
        (16, "😀" * 80 + " ende"),
        (7, " ".join(words(4, 60) + base[20:120] + words(5, 30))),
    ]
