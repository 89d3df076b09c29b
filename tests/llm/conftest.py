import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, _row int, node long, shard string"


def invented(draw: random.Random, low: int, high: int) -> str:
    return " ".join("".join(draw.choices("abdeghiklmnorstuü", k=draw.randint(2, 8))) for _ in range(draw.randint(low, high)))


def odd_documents() -> list[tuple]:
    """Ordinary texts beside nulls, blanks, a very long text, exact and near copies, repeated rows, ties."""
    draw = random.Random(3)
    texts = [invented(draw, 30, 120) for _ in range(40)]
    texts += [None, None, "", "", "  \t\n", "One", "two words", "Ünïcode ÉÉ  text\x0bwith\x0codd space", invented(draw, 30_000, 30_000)]
    texts += [texts[0]] * 25 + [texts[1].upper()] + [texts[2] + " tail"] + [texts[3].replace(" ", "  ")]
    rows = []
    for i, text in enumerate(texts):
        source = None if i % 9 == 4 else "hot" if i % 3 == 0 else f"s{i % 5}"
        lang = None if i % 7 == 2 else ("en", "de")[i % 2]
        rows.append((i, text, lang, source, None if text is None else len(text), 1, "x", 7, 5, "y"))
    rows += [rows[5], rows[5], rows[41], (None, texts[7], "en", "s1", 3, 1, "x", 7, 5, "y"), (6, "another text under a used id", "en", "s2", 28, 1, "x", 7, 5, "y")]
    return rows


@pytest.fixture(scope="session")
def odd_rows():
    return odd_documents()


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
