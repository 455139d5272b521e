import pytest

LONG = "wort " * 60_000 + "ende."


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns whose names operators use."""
    rows = [
        (None, None, None, None, None),
        (None, "Text ohne Nummer, aber lang genug.", None, "a", 3),
        (1, "", "de", "a", 0),
        (2, None, "de", None, None),
        (3, LONG, "en", "a", len(LONG)),
        (4, "the same line here\nand another line here", "en", "b", 1),
        (4, "the same line here\nand another line here", "en", "b", 1),
        (5, "the same line here\nand another line here", "en", "b", 1),
        (6, "the same line here\nsomething else entirely different", "en", "b", 1),
        (7, "  \t \n \r\n", "fr", "c", 5),
        (8, "Ünïcödé \U0001f600 <|endoftext|> mail a.b@c.de, +49 (30) 123456-7, 4111 1111 1111 1111 at 10.0.0.255\x00", "fr", "", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    clashing = {c: F.lit(k) for k, c in enumerate(("id", "score", "size", "rank", "n", "h", "g", "doc", "fp", "key", "label", "copies", "length", "start", "n_lines", "predicted", "found"))}
    others = {
        "a.b": F.lit("dot"), "s": F.struct(F.lit(1).alias("x"), F.array(F.lit("y")).alias("z")), "m": F.create_map(F.lit("k"), F.lit(None).cast("double")),
        "t": F.lit("2024-01-01 00:00:00").cast("timestamp"), "u": F.lit("2024-01-01").cast("timestamp_ntz"), "d": F.lit("1.25").cast("decimal(10,2)"), "raw": F.lit(b"\x00\xff"), "day": F.lit("2024-01-01").cast("date"),
    }
    return df.withColumns(clashing | others)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
