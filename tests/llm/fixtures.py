"""Small tables with what production tables hold too: nulls, empty and long texts, copies, repeated rows, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix purple jelly beans into very old boxes"


def prose(n: int, seed: int = 0) -> str:
    words = PROSE.split()
    return " ".join(words[(i * i + seed * 7 + i * seed) % len(words)] + str((i * 31 + seed) % 97) for i in range(n))


def documents():
    """(doc_id, text, lang, source, n_chars)"""
    texts = [
        (1, prose(80, 1), "en", "a"),
        (2, prose(80, 1), "en", "a"),
        (3, prose(80, 1).upper(), "en", "b"),
        (4, prose(80, 2), "en", "b"),
        (5, "", "en", "a"),
        (6, None, None, None),
        (7, "one", "de", "c"),
        (8, "one two", "de", "c"),
        (9, "one  two", "de", "a"),
        (10, "é" * 3 + " ß " + prose(60, 3), "de", None),
        (11, prose(30_000, 4), "en", "a"),
        (12, " \t\n\x0b\x0c\r ", "en", "c"),
        (13, "x y z\n" * 40, "en", "a"),
        (None, prose(70, 5), "en", "b"),
        (None, None, "en", "b"),
        (14, prose(80, 1), "en", "a"),
        (14, prose(80, 1), "en", "a"),
        (15, "  a b 　c", "fr", "a"),
    ]
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in texts]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
