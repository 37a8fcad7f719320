"""Small documents with every odd case, and word helpers of the brute-force versions."""

import re

import pytest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASHING = ["row", "kept", "label", "size", "first", "task", "doc", "start", "n", "salt", "draw", "words", "set_key", "score"]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lowered(text))


def with_clashes(df):
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null fields, empty and long texts, repeated rows, repeated ids, ties."""
    import random
    draw = random.Random(5)
    syllables = ["ka", "lo", "mi", "ren", "sta", "tu", "vel", "or", "ni", "dé"]
    sentence = lambda n: " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 3))) for _ in range(n))
    base = [sentence(60) for _ in range(6)]
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", None) for i, t in enumerate(base)]
    rows += [(10, base[0], "fr", "s0", 1), (10, base[0], "fr", "s0", 1), (11, base[1].upper().replace("É", "é"), None, None, 2)]
    changed = base[2].split()
    changed[30] = "changed"
    rows += [(12, " ".join(changed), "fr", "s1", 3), (13, None, "en", "s1", None), (14, "", None, None, 0), (15, " \t\n!? ", "en", "s2", 5)]
    rows += [(None, base[3] + " extra", "en", "s2", 6), (None, sentence(3), "fr", None, 7), (16, sentence(2), "en", "s0", 8)]
    rows += [(17, sentence(30_000), "en", "s0", 9), (18, "x" * 300_000, "fr", "s1", 10), (19, base[4] + " " + base[5], "en", "s2", 11), (19, base[5], "en", "s2", 12)]
    return spark.createDataFrame(rows, SCHEMA)
