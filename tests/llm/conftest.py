import random

import pytest
from pyspark.sql import types as T

#: Columns of documents, and others whose names operators use inside.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("key", "piece", "i", "cell", "shard", "rank", "ids", "spans", "score", "digest", "words", "component_id"))])


@pytest.fixture(scope="session")
def edge_rows():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    shared = prose(70)
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    texts = [
        (0, "plain text, it's 2 o'clock\n\n  and   more\t\x1c\x85 tail  "), (1, ""), (2, None), (3, prose(300) + " " + shared + "\n" + prose(40)), (4, prose(200) + " " + shared), (5, base), (6, " ".join(near)), (7, base),
        (8, "née Äpfel 東京 🙂🙂 don't we'll x's 's 'd've <|endoftext|> y <|endoftext|>"), (9, "a " * 700), (10, "z" * 5000 + " end"), (11, "one two three"), (None, prose(30)), (12, prose(9000)), (12, None), (13, "x" * 300 + shared), (14, "one two three"),
    ]
    texts += [(15, texts[12][1])] * 2 + [(16, texts[13][1])] * 2
    return texts


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame([(i, t, "en", "src0" if (i or 0) % 3 else None, 1, *["clash"] * 12) for i, t in edge_rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
