"""Documents with the cases that every operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, kept boolean, u long, id long"


def make(rows):
    return [(i, t, "en", "s", len(t or ""), 0.5, "x", True, 1, 2) for i, t in rows]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def texts(seed=5):
    rng = random.Random(seed)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = words(rng, 40, 10_000)
    out = [
        None, "", " \t\n", "one", "one two three", "one two three", base, base, " ".join(near), base + " tail",
        "été Ünïcode 中文 text😀 " * 8, "x" * 3000, "a b " * 400, words(rng, 30) + " " + passage + " " + words(rng, 30), words(rng, 50) + " " + passage,
        "UPPER lower UPPER lower", "line one\nline one\n\nline two\nline one", "#$%& " * 40, "<|endoftext|> and 'll don't  two  blanks\n\n\nlines ",
        words(rng, 9000), passage,
    ]
    out += [words(rng, rng.randrange(1, 9), 6) for _ in range(60)]
    return list(enumerate(out, 1))


def frame(spark, rows=None):
    rows = make(texts() if rows is None else rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)
