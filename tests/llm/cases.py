"""Small awkward inputs that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


WORDS = "the of and river stone light carry winter slow grain house over under thing".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def awkward(seed=1):
    """Nulls anywhere, empty and long texts, repeated rows and ids, copies and near copies."""
    rng = random.Random(seed)
    base = [sentence(rng, 120) for _ in range(12)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(t)) for i, t in enumerate(base)]
    rows += [(20 + i, base[0], "en", "a", 1) for i in range(5)]  # copies
    rows += [(30, base[1].replace("river", "RIVER"), "en", "a", 1), (31, base[2] + " tail", "en", None, None)]
    rows += [(40, None, None, None, None), (41, "", "en", "a", 0), (42, " \n\t ", "en", "a", 4), (43, "Ünïcödé   ßtraße 漢字 🙂", "de", "b", 5)]
    rows += [(None, base[3], "en", "a", 1), (None, None, None, None, None), (50, base[4], "en", "a", 1), (50, base[4], "en", "a", 1), (50, base[5], "en", "a", 1)]
    rows += [(60, " ".join(base * 150), "en", "b", 1), (61, "x" * 300_000, "en", "b", 1), (62, "same words here " * 200, "en", "b", 1)]
    return rows


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # names that an operator may use inside
        for name in ("id", "fp", "share", "bucket", "n_words", "score", "held_out", "row", "grp", "component_id", "kept", "tokens", "rate", "_id", "domain", "label"):
            df = df.withColumn(name, df["lang"])
    return df
