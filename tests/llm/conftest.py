import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, fp string, rep string, kind string, content string"
LONG = " ".join(f"word{k % 97} tail{k}" for k in range(30_000))
BASE = " ".join(f"alpha{k} beta{k % 7}" for k in range(300))


def rows():
    """Null ids and texts, empty and very long texts, copies, near copies, repeated rows, columns with clashing names."""
    out = [
        (1, "The quick brown fox jumps over the lazy dog", "en"),
        (2, "The  quick\tbrown fox jumps over the lazy\ndog", "en"),
        (3, None, "en"),
        (4, "", None),
        (5, " \n\t ", "en"),
        (6, LONG, "en"),
        (7, LONG, "en"),
        (8, BASE, "en"),
        (9, BASE + " gamma", "en"),
        (9, BASE + " gamma", "en"),
        (None, "The quick brown fox jumps over the lazy dog", "fr"),
        (None, None, None),
        (10, "Größe und Maß 12345 ½ <|endoftext|> Released under the MIT License. end", "de"),
        (11, "12345 !!! ---", "de"),
    ]
    return [(i, t, lang, "s", len(t or ""), "u", "f", "r", "k", "c") for i, t, lang in out]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
