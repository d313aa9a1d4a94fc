"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, cell string, word string, kept string, row string"


def awkward_docs(spark, seed=7, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "Thanks", "naïve", "straße", "ÉCLAIR", "日本", "x", "over-load", "3.14", "don't", "É!!", "a|b", "###", "Ⅷ", "áb"]
    texts = [None, "", " \n\t ", "one", "\n\n", "x " * 3000, "the of the of the of " * 40, "tail space   wide", "🎉 emoji 👩‍👩‍👧 join", "<|endoftext|> mid<|endoftext|>dle"]
    for _ in range(n):
        texts.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "\n", "\r\n", "\t", "  "]) for _ in range(rng.randint(1, 160))))
    rows = [(i, t, None, "s", 0, "h", "c", "w", "k", "r") for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, "no id here", None, None, None, "h", "c", "w", "k", "r"), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), [(r[0], r[1]) for r in rows]


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
