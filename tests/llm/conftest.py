import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, blanks, a long text, exact and near copies and a hot source."""
    r = random.Random(3)
    vocabulary = [a + b for a in ("ba", "ko", "mi", "tu", "re", "sa") for b in ("l", "n", "rim", "dos", "pex", "va", "zu")]
    rows = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(1, 60))]
        rows.append((i, " ".join(words), "en", "hot" if i % 3 else f"s{i % 7}", 0))
    base = [r.choice(vocabulary) for _ in range(120)]
    for i in range(60, 90):
        near = list(base)
        for _ in range(r.randint(0, 7)):
            near[r.randrange(len(near))] = r.choice(vocabulary)
        rows.append((i, " ".join(near), "en", "hot", 0))
    rows += [(i, rows[5][1].upper(), "en", None, 0) for i in (100, 101, 102)]
    rows += [(110, None, None, None, None), (111, "", "en", "s1", 0), (112, " \t\n", "en", "s1", 0), (113, "one", "en", "s2", 3), (114, "one", "de", "s2", 3)]
    rows += [(115, " ".join(r.choice(vocabulary) for _ in range(9000)), "en", "hot", 0), (116, "naïve été déjà ä", "fr", "s2", 0)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
