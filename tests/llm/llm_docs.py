"""Small tables with the awkward cases: nulls, empty and long texts, repeats, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, size long, `class` long, kept boolean"


def awkward(n=40, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 12, 60]))) + rng.choice(["", ".", "\nSame line here 12."])
             for _ in range(n)]
    texts += [None, "", " \n\t ", "One", "one", "ONE two", "é É ß İ Σ", "x" * 20000, texts[0], texts[0].upper(), texts[1]]
    rows = [(i, t, "en", rng.choice(["a", "b", None, "é", "Z"]), None if t is None else len(t), "w", 1, 2, True)
            for i, t in enumerate(texts)]
    rows += [(None, "null id", "en", "a", 7, "w", 1, 2, True), (None, None, None, None, None, None, None, None, None)]
    return rows + rows[3:5]  # rows repeated whole


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
