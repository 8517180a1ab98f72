"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing columns, no rows."""

import hashlib
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=None):
    rows = awkward() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).repartition(3)


def prose(seed, n):
    r = random.Random(seed)
    parts = ["the", "of", "an", "er", "ing", "tion", "ha", "st", "re", "ble", "é", "ß", "ñ"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


def awkward():
    long_text = prose(1, 9000)
    return [
        (1, prose(2, 120), "a"),
        (2, None, "a"),
        (3, "", None),
        (4, "one", "b"),
        (5, prose(2, 120), "b"),
        (5, prose(2, 120), "b"),
        (6, long_text, "c"),
        (7, long_text[:-40] + " changed at the end", "c"),
        (8, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\nCC-BY cc by", "a"),
        (9, "x" * 5000, "a"),
        (None, prose(3, 50), "a"),
        (10, "  \t\n ", "b"),
        (11, "tab\x00nul\x1fend\u2028line\u00a0sep <|endoftext|> <|im_end|><\\|im_start|>", "b"),
    ]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
