import random

import pytest
from support import CLASHING, prose

@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source, n_chars): plain prose, exact and near copies, odd and missing values."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(25, 160)) for _ in range(60)]
    rows = list(texts)
    for k in range(12):
        rows.append(texts[0])
        changed = texts[1 + k % 3].split(" ")
        changed[rng.randrange(len(changed))] = f"x{k}"
        rows.append(" ".join(changed))
    rows += [None, "", " \n\t ", "one two", "One TWO", "a\x0bb\x0cc\r\nd", "é ü x y", "word " * 3, prose(rng, 9000)]
    rows += ["<|endoftext|> [INST] &amp; </s>", "x" * 5000, "a  b   c \n d", "ab cd ef gh ij " * 20]
    lang = ["en", "de", None]
    return [
        (i, t, lang[i % 3], None if i % 11 == 0 else f"s{min(i % 7, 3)}", None if t is None else len(t)) for i, t in enumerate(rows)
    ] + [(5, texts[5], "de", "s3", 1), (None, texts[7], None, None, None), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def crowded(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("other").alias(c) for c in CLASHING])
