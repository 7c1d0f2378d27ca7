"""Awkward tables for every corpus operator."""

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h string, n int, k double, _t string, _f int, c0 string, b boolean, x int, p string"
LONG = " ".join(f"word{i % 977} is{i % 13}" for i in range(60_000))
ROWS = [
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, " \t\r\n ", "en", "a", 5),
    (4, "one", "en", "b", 3),
    (5, "the same text here\nand a second line\nand a third", "en", "b", 50),
    (5, "the same text here\nand a second line\nand a third", "en", "b", 50),
    (6, "the same text here\nand a second line\nand a third", "en", "a", 50),
    (None, "a row without an id but with words", "en", "c", 34),
    (8, LONG, "en", "a", len(LONG)),
    (9, LONG + " end", "en", None, len(LONG) + 4),
    (10, "é ü 🙂🙂 naïve\x1c text here", "fr", "c", 20),
]


def frame(spark, rows=ROWS):
    extra = (0, "h", 0, 0.0, "t", 0, "c", True, 0, "p")
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA)


def documents(spark, folder=SF):
    return spark.read.parquet(f"{folder}/documents.parquet")
