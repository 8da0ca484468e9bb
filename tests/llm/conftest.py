import pytest
from pyspark.sql import functions as F

TEXTS = (
    None, "", " \t\n", "One two three four five six.", "One two three four five six.", "a" * 200_000, "w " * 30_000, "É\x00 \u2028 \U0001f600 x",
)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, a second row of one identifier, other columns."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 2}" if i % 3 else None, 1, "x", 2.0) for i, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "No identifier here at all, none.", "en", "s1", 1, "y", None), (3, "Another text of the same identifier.", None, None, None, None, 0.0)]
    # Columns with names that operators use inside, or that need quoting.
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, id int, fp string, score double")
    extra = ["__id", "__size", "__copies", "__turn", "a.b", "text`s", "hot", "mark", "times", "key", "size", "copies", "turn", "print"]
    return frame.select("*", *[F.lit(i).alias(n) for i, n in enumerate(extra)]).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter(F.lit(False))


@pytest.fixture(scope="session")
def corpus(spark):
    """A small corpus in two made-up languages, with copies and a hot source."""
    import random

    rng = random.Random(5)
    languages = {"xa": ["the", "ren", "ash", "ing", "tor", "whe"], "xb": ["ung", "sch", "ber", "lich", "ein", "auf"]}
    rows = []
    for i in range(240):
        lang = "xa" if rng.random() < 0.6 else "xb"
        words = ["".join(rng.choices(languages[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 120))]
        rows.append((i, " ".join(words), lang, "hot" if i % 3 else f"s{i % 5}"))
    for i in range(240, 300):
        j = rng.randrange(40)
        words = rows[j][1].split()
        if i % 2 and len(words) > 60:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), rows[j][2], rows[j][3]))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(5).cache()

