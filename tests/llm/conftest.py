import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = " ".join(f"word{i % 997}x{i}" for i in range(20_000))
ODD = [
    (1, None, "en", "a", 0),
    (2, "", None, None, None),
    (3, " \n\t ", "en", "a", 3),
    (4, "only four words here", "en", "a", 20),
    (5, "only four words here", "en", "b", 20),
    (5, "only four words here", "en", "b", 20),
    (None, "a row without an id but with some words", "de", "a", 1),
    (None, "a row without an id but with some words", "de", "a", 1),
    (6, LONG, "en", "a", len(LONG)),
    (7, LONG.replace("word3x3 ", "other "), "en", "a", len(LONG)),
    (8, "12345 !!! ???", None, "a", 1),
    (9, "mail me at x.y@example.org or +1 (555) 123-4567 ünïcode 漢字 🙂", "en", "a", 1),
    (10, "Licensed under the Apache License, Version 2.0.", "en", "a", 1),
]
#: Names that the operators use for columns of their own.
CLASHES = (
    "tag digest keep_id group_size kept node signature root rows first piece start slot bin offset bins bound free "
    "grp features label calibrate margin score held_out term terms spans entity strength _id _tag _t _marks label_ "
    "count n_words items hits pick lang_pred toxic"
).split()


def plain_words(text, pattern):
    return re.findall(pattern, (text or "").translate(LOWER))


def spaced(text):
    return plain_words(text, r"[^\x20\x09-\x0D]+")


def alnum(text):
    return plain_words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(spark, docs_of):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    from pyspark.sql import functions as F

    docs = docs_of(ODD)
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def empty(spark, docs_of):
    return docs_of([])


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}
