"""A small corpus with the awkward cases, and brute-force word splitting."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, label int, row_hash long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def spaced(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def texts():
    rng = random.Random(5)
    vocabulary = ["The", "of", "and", "größe", "été", "wind", "River", "stone", "a", "42", "x-y", "ñandú", "lake,", "tree."]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = make(60)
    out = [None, "", " \n\t ", "one", "Two words", base, base, base.replace("stone", "rock", 1), base + " tail", make(5000), "日本語 テキスト 😀", "\x00\x1f", "ſ K"]
    out += [make(rng.randint(1, 80)) for _ in range(25)]
    return out


def documents(spark, more=()):
    """Rows with null and repeated ids, whole rows twice, and extra columns that clash with inner names."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "h", 1, 7) for i, t in enumerate([*texts(), *more])]
    rows += [rows[5], rows[5], (None, "null id words", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]
