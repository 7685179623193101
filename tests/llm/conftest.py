import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length string, part string, ids string"
PROSE = [
    "The quick brown fox jumps over the lazy dog near the old river bank. It's late.\nWe'll see  two  spaces.\n\nA new line",
    "Der schnelle braune Fuchs springt über den faulen Hund. ÄÖÜ ß ΑΣ ΟΔΟΣ",
    "tabs\tand\r\nreturns   nbsp em \x1c fs \x85 nel <|endoftext|> é 🙂👍🏽 12345 'S it's  ",
    "", " ", "\n", "word", "two words", "a b c d", "Ⅷ ① ½ 漢字かな交じり文 שלום नमस्ते",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, very long and repeated texts, a null id, repeated rows, and columns whose names operators use inside."""
    rows = [(i, t) for i, t in enumerate(PROSE)]
    rows += [(50, None), (51, "lorem ipsum dolor " * 40_000), (52, "x" * 300_000), (None, "no id here"), (7, "two words"), (60, PROSE[0]), (61, PROSE[0] + " end")]
    return spark.createDataFrame([(i, t, "en", "h", None, "a", "b", "c") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
