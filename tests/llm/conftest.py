import random

import pytest

SF = "/root/testdata/sf0.001"
CLASH = "tag string, n long, size long, score double, row_key string, pieces string, of string, label int, word_ int, may_ boolean, rep long, copies int, mix_at string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang, source): nulls, empty and very long texts, ties, repeated rows, near copies."""
    rng = random.Random(5)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, None, "en", "b"), (2, "", "en", "b"), (3, " \t\n ", "en", None), (4, "one", "en", "a"), (5, "one", "de", "a"), (6, "One  two", "en", "a"), (7, "One two", "en", "c"),
        (None, "one two", "en", "c"), (8, base, "en", "a"), (9, " ".join(near), "en", "a"), (10, base.replace(" ", "\n"), None, "b"), (11, base.upper(), "en", None),
        (12, words(rng, 20_000), "en", "c"), (12, "same id, other text", "en", "c"), (13, "twice the same row", "en", "a"), (13, "twice the same row", "en", "a"),
        (14, "x" * 100_000, "en", "b"), (15, "é ü 日本語 \U0001f600 ▁ \u00a0", "fr", "b"),
    ]
    for i in range(16, 60):
        rows.append((i, words(rng, rng.randint(1, 60)), "en", rng.choice(["a", "b", "c", None])))
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows, tmp_path_factory):
    """The rows as a stored table with extra columns of clashing names."""
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    names = [c.split()[0] for c in CLASH.split(", ")]
    df = spark.createDataFrame([(*r, len(r[1] or ""), *[None] * len(names)) for r in edge_rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
