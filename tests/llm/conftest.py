from __future__ import annotations

import pytest

#: Names that the operators use inside; a table may have columns so called.
CLASHES = ["words", "copy", "fp", "h", "label", "keep", "ids", "start", "g", "value", "left", "n_tokens", "i", "doc", "shard", "size", "root", "cuts", "part"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = ("lorem ipsum dolor sit amet " * 4000).strip()


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and blank texts, a very long one, copies, repeated rows, repeated and null ids, odd characters."""
    plain = "The quick brown fox jumps over the lazy dog and then runs back to its den before the rain begins to fall"
    rows = [
        (1, plain, "en", "a", 100),
        (1, plain, "en", "a", 100),
        (2, plain, None, None, None),
        (3, plain.replace("lazy", "sleepy"), "en", "b", 100),
        (4, None, "en", "b", None),
        (5, "", None, "b", 0),
        (6, " \t\n ", "de", "a", 4),
        (7, LONG, "en", "c", len(LONG)),
        (8, "x" * 120_000, "en", "c", 120_000),
        (9, "Ünïcödé 漢字漢字 \U0001f600 mixed CASE\x0bwords\x1chere é́", "fr", "c", 30),
        (None, plain, "en", "a", 100),
        (None, None, None, None, None),
        (10, "two words", "en", "a", 9),
        (10, "other text", "en", "a", 10),
        (11, "<|endoftext|> within <|endoftext|>", "en", "a", 30),
        (-12, "mail me at joe@x.org or +1 (555) 123-4567, card 4111 1111 1111 1111, host 10.0.0.1", "en", "a", 80),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def clashing(messy):
    from pyspark.sql import functions as F

    return messy.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
