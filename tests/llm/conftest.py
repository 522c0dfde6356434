import random

import pytest

SF = "/root/testdata/sf0.01"


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and column names that operators use themselves."""
    rng = random.Random(5)
    base, other = prose(rng, 300), prose(rng, 120)
    near = base[:100] + ["changed"] + base[101:]
    texts = [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, " ".join(other)), (4, " ".join(other)), (5, None), (6, ""), (7, " \t\n "),
        (8, "ab " * 400), (9, " ".join(prose(rng, 60_000))), (10, "Ä\u0000ß " + " ".join(base[:80]) + "\n" + " ".join(prose(rng, 50))), (11, "x"), (12, "X"), (13, "1234 5678 !!"),
        (None, " ".join(other)), (None, None), (14, "  only   blanks \x1c here \x85"), (15, "A b C d " * 60 + " ".join(other[:90])),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `row` string, g long, k1 long, spans string, score double, c string, `a.b` int, _mix int, label int, v string"
    rows = [(d, t, None if i % 5 == 0 else ("en", "fr")[i % 2], None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), "r", 1, 2, "s", 0.5, "c", 1, 2, 3, "v") for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(hard_docs):
    return hard_docs.limit(0)


@pytest.fixture(scope="session")
def sample_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
