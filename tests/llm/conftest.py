import random

import pytest
from pyspark.sql import types as T

WORDS = "the of and river stone house cloud mountain paper light green walking über straße niño façade don't 42 7th x".split()

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    # names that operators use themselves
    + [T.StructField(c, T.LongType()) for c in ("row", "key", "chunk", "slot", "fp", "a", "b", "words", "bucket", "id", "at", "of_doc", "gone", "gone_id", "greatest", "row_", "kind", "peer")]
)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) * (rng.random() < 0.6) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) with nulls, empty and very long texts, odd characters, copies, near copies and a shared passage."""
    rng = random.Random(5)
    shared = prose(rng, 70)
    rows = [(k, prose(rng, rng.choice([1, 3, 30, 120, 300]))) for k in range(60)]
    rows += [(100 + k, prose(rng, 80) + "\n" + shared + "\n" + prose(rng, 60)) for k in range(6)]
    base = prose(rng, 200)
    rows += [(200 + k, base) for k in range(40)]
    for k in range(10):
        w = base.split(" ")
        w[20 * k] = "changed"
        rows.append((300 + k, " ".join(w)))
    rows += [(400, None), (401, ""), (402, "   \n\t "), (403, "a"), (404, "   x\x1cy"), (405, "A" * 5000), (406, "Ünḯcode <|endoftext|> 漢字 \U0001f600 'tis"), (407, prose(rng, 9000)), (None, "no id at all"), (None, None), (5, "id five again"), (6, rows[6][1])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t) + (1,) * 18 for i, t in texts], DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
