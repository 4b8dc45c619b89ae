"""Documents with the hard cases: nulls, empty texts, a long text, ties, copies, other letters, extra columns of clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, size long, keep_id long"


def rows(n: int = 60, seed: int = 5) -> list[tuple]:
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)] + ["Été", "ÀB", "straße", "the", "of", "#tag", "a|b", "naïve"]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 120))) for _ in range(n)]
    for i in range(0, n, 3):
        texts[i] = texts[0] if i % 2 else texts[i].upper().replace("É", "é")
    texts[3] = texts[0].upper()
    texts += [None, None, "", " \t\n", "x", "ÉÉ", "éé", "same line\nsame line\nsame line\nother", "a b c a b c a b c", " ".join(["long"] * 30000), "Released under the MIT License.\nmit license mit license", "Licensed under the Apache License, Version 2.0."]
    out = [(i, t, "en" if i % 2 else None, ["src1", "src2", None, "é"][i % 4], len(t or ""), "h", 1, 9) for i, t in enumerate(texts)]
    return out + [out[5]]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
