"""Small tables with the awkward rows that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, n long, key string"
LONG = " ".join(f"w{i % 97} x{i}" for i in range(30_000))
GOOD = " ".join(f"plain{i} word{i * 7}" for i in range(60))


def rows(texts, first=0):
    return [(first + i, t, "en", f"s{i % 3}", None if t is None else len(t), "clash", 0.5, 7, None) for i, t in enumerate(texts)]


AWKWARD = [None, "", "   \n\t ", "one", "one two three four", GOOD, GOOD, GOOD + " more", LONG, "ünï cödé 日本語 🎉 " * 20, "a" * 5000, "\x00\x01 odd \x0b controls"]


def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with clashing names."""
    table = rows(AWKWARD)
    table += [(3, "one", "en", "s0", 3, "clash", 0.5, 7, None)] * 2  # repeated rows
    table += [(None, GOOD, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(table, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
