import pytest

#: Odd documents: nulls anywhere, empty and very long texts, repeated rows, extra and clashing columns.
ODD = [
    (1, None, "en", "s", "x"), (2, "", None, None, "x"), (3, "   \n ", "en", "s", None), (4, "word", "en", "s", "x"),
    (5, "one two three four five six", "en", "s", "x"), (5, "one two three four five six", "en", "s", "x"),
    (6, "One  Two three four five six", "de", "t", "x"), (None, "no id at all here, is there", "en", "s", "x"),
    (7, "long " * 30_000, "en", "s", "x"), (8, "y" * 50_000, "en", "s", "x"), (9, "Ünï cödé 数据 👍 <|endoftext|>", "en", "s", "x"),
]
COLUMNS = "doc_id bigint, text string, lang string, source string, n bigint, id string, size int, score double, shard string, node int, label int, part int, uid int, root int, curve int, _tie int"


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, la, s, 1, x, 2, 0.5, "z", 3, 9, 1, 1, 1, 1, 1) for i, t, la, s, x in ODD]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/labels.parquet")
