import re

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


LONG = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua"

#: nulls in every column, empty and very long texts, repeated rows, equal texts, clashing names
EDGE = [
    (1, LONG, "en", 1, "x", 0), (2, LONG, "en", None, "x", 0), (2, LONG, "en", None, "x", 0), (3, None, None, None, None, None), (4, "", "de", 0, "", 0), (None, LONG, None, None, None, None),
    (None, None, None, None, None, None), (5, "   \n\n  ", "fr", 6, "y", 1), (6, "é" * 200, "fr", 200, "y", 1), (7, (LONG + "\n") * 2000, "en", 5, "z", 2), (8, "one two", "en", 7, "z", 2), (9, "!!! ???", "en", 7, "z", 2),
]
EDGE_SCHEMA = "doc_id long, text string, lang string, n_chars long, block string, n_words int"


def edge(spark):
    return spark.createDataFrame(EDGE, EDGE_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
