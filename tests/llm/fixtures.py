"""Documents with what breaks operators: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

import random

LONG = " ".join(f"word{i % 977} tail{i % 13}." for i in range(60_000))
EDGES = [
    (0, "the quick brown fox jumps over the lazy dog"), (1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, "the quick brown fox jumps over the lazy dog"),
    (6, "The Quick  brown fox\njumps over the lazy dog"), (7, "a  b   c \n d"), (8, "日本語のテスト 😀 été ß"), (9, "it's 'so <|endoftext|> <|startoftext|>"), (None, "no id here at all"),
    (10, "12345 !!! ???"), (11, "x\x1cy \x85 z q"), (11, "repeated id with another text"), (12, " leading and trailing "),
]


def edge_docs(spark):
    rows = [(i, t, "en", "s", 5, 7.0, "n") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, node string").withColumnsRenamed({"n_chars": "id"})


def words(n, seed):
    r = random.Random(seed)
    return [r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(r.randrange(50)) for _ in range(n)]
