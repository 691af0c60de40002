import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n, words=None):
    words = words or ["".join(rng.choice(["ba", "do", "ki", "lu", "me", "sor", "tan"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents: prose, exact copies, near copies, and the odd cases."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(60, 300)) for _ in range(60)]
    near = []
    for k in range(8):
        ws = texts[k].split()
        ws[len(ws) // 2] = "changed"
        near.append(" ".join(ws))
    texts += [texts[0]] * 5 + near + ["", None, " \t\n", "one", "two words", "x" * 5000, prose(rng, 30_000), "É è ß 漢字 <|endoftext|> don't 😀"]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "no id at all " * 30, None, None, 0)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
