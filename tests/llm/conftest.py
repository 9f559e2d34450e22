import random

import pytest

WORDS = ["stone", "river", "Cloud", "maple", "orbit", "ember", "quiet", "harbor", "signal", "velvet", "écho", "größe", "naïve", "a", "the", "of"]
DOC = "doc_id long, text string, lang string, source string, n_chars long, piece int, length long, h1 long, spans string, part int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "\n"]) + str(rng.choice(["", "", "", rng.randint(0, 9)])) for _ in range(n))


def rows(texts):
    """Documents with columns whose names clash with the operators' own."""
    return [(i, t, None if i == 3 else "en", "hot" if k % 3 else f"s{k}", None if t is None else len(t), 9, 9, 9, "x", 9) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    base = prose(rng, 120)
    passage = prose(rng, 60)
    t = [(1, base), (2, base), (3, None), (4, ""), (5, "   \n "), (6, base.replace("stone", "rock", 1)), (7, "one two"), (8, prose(rng, 3000) + passage), (9, prose(rng, 80) + passage + prose(rng, 80)),
         (10, "x" * 900), (11, "ab " * 500), (12, "▁odd \x1c\x85 　 İßΣ 漢字🙂 <|endoftext|> it's"), (13, base.upper()), (14, "tiny"), (14, "tiny"), (None, "no id here at all")]
    return t + [(20 + k, prose(rng, rng.randint(1, 90))) for k in range(40)] + [(100 + k, base + " tail" * k) for k in range(12)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), DOC).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
