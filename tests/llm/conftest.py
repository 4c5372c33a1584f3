import random

import pytest
from pyspark.sql import functions as F

from llm_schema import SCHEMA


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): ugly and repetitive documents, ids unique."""
    r = random.Random(5)
    vocab = ["the", "of", "and", "Thrée", "ßtrom", "中文字", "é", "x", "GNU", "don't", "1234", "a,b", "###", "$$", "|"]
    vocab += ["w%03d" % i for i in range(400)]
    sent = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared = [sent(14) for _ in range(6)]
    rows = []
    for i in range(160):
        lines = [sent(r.randrange(1, 40)) for _ in range(r.randrange(1, 6))]
        if r.random() < 0.4:
            lines.insert(r.randrange(len(lines) + 1), r.choice(["", "  ", "\t"]) + r.choice(shared).swapcase() + r.choice(["", " \r"]))
        rows.append([i, "\n".join(lines), r.choice(["en", "de", None]), r.choice(["src0", "src0", "src0", "src1", "src2", "src10", None])])
    texts = [x[1] for x in rows]
    extra = [None, "", " ", "\n\n", "word", "a b c d", texts[3], texts[3], texts[7], "long " * 6000, "z" * 9000,
             "<|endoftext|> a<|endoftext|><|endoftext|>", "  two  spaces  and　wide ", "퟿￿\U0001f600 emoji‍", shared[0], "### $$$ %%% " * 30]
    for k, t in enumerate(extra):
        rows.append([200 + k, t, "en", "src0"])
    for k in range(12):  # near copies of one document, a word changed in each
        w = (texts[11] + " " + texts[12] + " " + texts[13]).split(" ")
        w[(7 * k) % len(w)] = "changed%d" % k
        rows.append([300 + k, " ".join(w), "en", "src1"])
    r.shuffle(rows)
    return [tuple(x) for x in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(*x, len(x[1] or "")) for x in corpus], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Null ids, rows that repeat an id, and extra columns with clashing names."""
    rows = [(None, "one two three", "en", "a"), (None, None, None, None), (1, "same text here " * 9, "en", "a"),
            (1, "same text here " * 9, "en", "a"), (1, "another text", "en", "b"), (2, "", None, "b")]
    df = spark.createDataFrame([(*x, 0) for x in rows], SCHEMA)
    for name in ("id", "ids", "h1", "size", "copies", "drop", "fp", "sig", "text_2", "digest", "decoded", "m", "_lines", "kept", "part", "surrogate"):
        df = df.withColumn(name, F.lit("x"))
    return df


def by_id(df, *cols):
    return {r[0]: tuple(r)[1:] for r in df.select(*cols).collect()}
