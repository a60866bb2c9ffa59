"""Tables that every operator must stand."""

import random

LONG = "alpha beta gamma delta epsilon zeta eta theta " * 4000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names that operators may use inside."""
    texts = [
        (1, None), (2, ""), (3, "   \n\t"), (4, "..."), (5, LONG), (6, LONG), (7, "Grüße aus Köln"), (8, "one two"), (8, "one two"),
        (9, "a\0b \ud7ff \U0001f600 ünï"), (None, "an id is missing here"), (10, "<|endoftext|> </s> ▁▁ \u3000"), (11, "x" * 30_000),
    ]
    rows = [(i, t, None if i == 9 else "en", "s", 7) for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = "'z' AS word, 'z' AS `__id`, 'z' AS key, 'z' AS node, 'z' AS score, 'z' AS labels, 'z' AS unit, 'z' AS part, 0 AS rank"
    return df.selectExpr("*", *extra.split(", ")), [tuple(r[:2]) for r in rows]


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(seed, n, pool=300):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(pool)]
    return [rng.choice(names) for _ in range(n)]
