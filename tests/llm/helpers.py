"""Small tables and plain-Python references for the corpus operators."""

import hashlib
import random
import re

SPACE = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, source string"


def words(text):
    return re.findall(SPACE, text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def awkward_rows():
    """Nulls, empty, blank, very long, repeated rows, ties, letters outside ASCII."""
    long = " ".join(f"w{i % 977}" for i in range(6000)) + "\n" + "same line\n" * 40
    rows = [(0, None, "a"), (1, "", "a"), (2, " \n\t ", None), (None, "no id but text\nsame line", "b"),
            (None, None, None), (3, long, "b"), (4, long, "b"), (5, "É É\x0b Ñandú ÀB", "c"), (5, "É É\x0b Ñandú ÀB", "c"),
            (6, "one", "c"), (7, "one", "a"), (8, "a b c d e f g h " * 12, None), (9, "\n\n", "c")]
    return rows


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(3)


def sentence(rng, n, vocabulary=400):
    return [f"x{rng.randrange(vocabulary)}" for _ in range(n)]


def rng(seed=1):
    return random.Random(seed)
