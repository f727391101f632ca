import os
import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns whose names operators use."""
    rng = random.Random(5)
    words = ["the", "of", "and", "lyer", "thation", "er", "wheon", "Éan", "ß", "日本", "a.b@mail.example.com", "10.0.0.1", "+1 (377) 555-0271", "4111111111111111"]
    long = " ".join(rng.choice(words) + str(n % 97) for n in range(6000))
    texts = [None, "", " \n\t ", "Hello  World", "hello world", "Hello World ", "été", "été", long, long, long[:-9] + "x", "x" * 5000, "!!! ???"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(25)]
    rows = [(n, t, rng.choice(["en", "fr", None]), rng.choice(["s", None]), None if t is None else len(t), 0.5) for n, t in enumerate(texts)]
    rows += [rows[8], rows[8], rows[0]]  # whole rows again
    return spark.createDataFrame(rows, DOCS).repartition(3), rows


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def corpus(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, {r["doc_id"]: r["text"] for r in df.collect()}
