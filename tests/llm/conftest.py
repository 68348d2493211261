from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, id long, node long, epoch int, shard int, tokens long, _source string, found long, row binary"


def prose(seed: int, n: int) -> str:
    """``n`` words that no other seed has in this order."""
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 997}x{(seed + i) % 13}" for i in range(n))


def document(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None, True, 0.5, 3, 4, 5, 6, 7, "x", 8, b"y")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    rows = [
        document(1, prose(1, 120)), document(1, prose(1, 120)), document(2, None), document(3, ""), document(4, " \n\t "), document(None, prose(2, 60)), document(None, None), document(5, "one two"), document(6, "One  TWO", None),
        document(7, prose(3, 30_000), "long"), document(8, "\x85   é́ <|endoftext|> don't", "b"), document(9, prose(1, 120), "b"), document(10, "x" * 300_000, "b"), document(10, "another text of the same id", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
