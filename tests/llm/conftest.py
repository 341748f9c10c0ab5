import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words, the same in each run."""
    rng = random.Random(7)
    syllables = "an ba co du er fi go ha in jo ka lu mo ne or pa re su ti un".split()
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(400)]
    return [" ".join(rng.choices(words, k=rng.randint(30, 120))) for _ in range(120)]


@pytest.fixture
def odd_docs(spark, prose):
    """Nulls in any column, empty and long texts, repeated rows, and columns of clashing names."""
    rows = [
        (1, prose[0], "en", "a", 1, 9),
        (1, prose[0], "en", "a", 1, 9),  # repeated
        (2, None, None, None, None, None),
        (3, "", "en", None, 0, 1),
        (4, " ".join(prose) * 20, "en", "b", 5, 2),  # long
        (None, prose[1], "en", "a", 1, 3),
        (5, "  \n\t ", "de", "b", 5, 4),
        (6, prose[2], None, "b", 5, 5),
    ]
    return spark.createDataFrame(rows, DOCS + ", score long").withColumnsRenamed({"score": "kept"})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
