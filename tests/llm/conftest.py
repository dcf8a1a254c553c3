import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, fp string, id string, size string, n_lines string, h string, row string, score string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with extra columns whose names clash."""

    def build(rows, parts=3):
        full = [(*r, *(None,) * (4 - len(r)), None, *("extra",) * 8) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build


ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (5, "one two three four"), (6, "one two three four"), (6, "one two three four"), (None, "one two three four"), (None, None), (7, "\t a \x0b b\r\n"),
    (8, "Ünïcode  déjà   vu ▁ ▁▁ <s> <|endoftext|> İstanbul ΑΣ \x1c x\x00y"), (9, "日本語のテキスト" * 50), (10, "wörd " * 3000), (11, "x" * 5000), (12, "A" * 41 + "\n" + "a" * 41 + " \n" + "b" * 39), (13, "  lead"), (14, "trail  "), (15, "12345 678,90 !?! #tag"),
]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)
