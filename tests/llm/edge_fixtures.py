import pytest

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"

LONG = ("alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000) + "end"
BODY = "The quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak near the quiet river bank and nobody says a word about it "

#: (doc_id, text, lang, source, n_chars) with nulls in every column, empty,
#: blank and very long texts, ties and repeated rows.
ROWS = [
    (1, BODY * 3, "en", "a", 1), (2, None, "en", "a", 0), (3, "", "en", None, 0), (4, " \t\n ", None, "a", None),
    (5, LONG, "en", "a", 1), (6, BODY * 3, "en", "b", 1), (6, BODY * 3, "en", "b", 1), (7, BODY.replace(" ", "\n ") * 3, "en", "b", 1),
    (None, BODY * 3, "en", "c", 1), (None, None, None, None, None), (8, "short text", "de", "c", 1),
    (9, BODY + " ".join(f"item{i}" for i in range(60)), "en", "c", 1), (10, "<|endoftext|> it's İstanbul, ǅ Σ naïve é  x y 123", "tr", "c", 1),
]
CLASH = ["row", "kept", "digest", "_words", "_m", "set", "score", "node", "comp", "_row_of_scan", "stratum", "key", "label"]


@pytest.fixture(scope="session")
def edge_docs(spark, tmp_path_factory):
    """The rows above with extra columns whose names clash with the operators' own."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASH)
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    spark.createDataFrame([r + ("x",) * len(CLASH) for r in ROWS], schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark, edge_docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    edge_docs.limit(0).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def edge_labels(spark):
    rows = [(1, 1, 0), (5, 0, 0), (6, 1, 0), (8, 0, 1), (8, 0, 1), (None, 1, 1), (9, None, None), (10, 1, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
