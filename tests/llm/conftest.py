import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977}x{k % 31}" for k in range(60_000))
REPEATS = " ".join(["one two three four five six seven eight nine ten"] * 4)
PERSONAL = (
    "mail a.b+c@x-y.example.com, or @ or q@host or a@b@c.de. IPs 1.2.3.4 and 300.1.1.1 and 1.2.3.4.5.6.7.8 and 010.20.30.40 "
    "cards 4111 1111 1111 1111, 4111-1111-1111-1112 and 0000000000000000000000 phones +1 (988) 555-2485, +1-2, +49 30 1234567 8. "
    "ñé 😀 z@z.zz +123456789012345678"
)
#: Nulls in every column, empty and blank texts, repeated rows and ids, ties, and a long text.
EDGE_DOCS = [
    (1, None, None, None, None),
    (2, "", "en", "", 0),
    (3, " \n\t \x0b", "en", "a", 5),
    (4, "Hello World", "en", "a", 11),
    (5, "hello   world", "en", None, 13),
    (6, "hello", "en", "b", 5),
    (7, LONG, "en", "b", len(LONG)),
    (8, LONG.replace("word5x5", "word5y5"), "en", "c", 9),
    (9, LONG, None, "c", None),
    (10, REPEATS, "en", "é", 1),
    (10, REPEATS, "en", "é", 1),
    (11, PERSONAL, "en", "z", 1),
    (12, PERSONAL + " \\ </s> <|endoftext|>  two", "en", "z", 1),
    (13, "a" * 20_000, "en", "a", 1),
    (14, "line one is here.\nline one is here.\n\nline | two | is | a | bar\nAll rights reserved.", "en", "a", 1),
    (-3, "negative ids are ids", "en", "a", 20),
]


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    """Tables with edge cases and with columns that operators use as names of their own."""
    from pyspark.sql import functions as F

    at = str(tmp_path_factory.mktemp("edge"))
    clash = {c: F.lit("clash") for c in ("fp", "key", "size", "part", "h", "id", "word", "score", "words", "copies", "target", "u", "v", "host")}
    docs = spark.createDataFrame(EDGE_DOCS, DOC_SCHEMA).withColumns(clash)
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    for name in ("pages", "benchmark", "labels", "conversations"):
        table = spark.read.parquet(f"{SMALL}/{name}.parquet")
        nulls = spark.createDataFrame([tuple([None] * len(table.columns))], table.schema)
        table.unionByName(nulls).unionByName(table.limit(2)).withColumns(clash).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    return at
