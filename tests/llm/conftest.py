import random

import pytest

LONG = " ".join(f"word{k % 977} of line {k}" for k in range(9000)) + " 4111111111111111"


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows and near copies."""
    rng = random.Random(5)
    words = [rng.choice(["alpha", "beta", "Gamma", "delta", "é", "omega"]) + str(rng.randrange(40)) for _ in range(120)]
    near = [*words[:60], "changed", *words[61:]]
    german = "Der Hund und die Katze liegen nicht unter dem alten Baum, weil es regnet und kalt ist. " * 3
    english = "The dog and the cat are not lying under the old tree because it rains and it is cold. " * 3
    return [
        (1, " ".join(words), "en", "b"),
        (2, " ".join(near), "en", "b"),
        (2, " ".join(near), "en", "b"),
        (3, " ".join(words).upper(), "en", "a"),
        (4, None, "en", "a"),
        (5, "", "de", None),
        (6, " \t\n ", None, "a"),
        (7, "...!? 123", "de", "a"),
        (8, german, "de", "a"),
        (9, german, None, "c"),
        (10, english, "en", "c"),
        (11, "one two", "en", None),
        (12, "one two", "en", "c"),
        (None, english + " more", "en", "c"),
        (None, None, None, None),
        (13, LONG, "en", "d"),
        (14, "x", None, "d"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with further columns whose names the operators use themselves."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(*r, None if r[1] is None else len(r[1])) for r in odd_rows()]
    extra = [(f"lit({k})", c) for k, c in enumerate("size key position words node n tokens uses row component cluster kept".split())]
    return spark.createDataFrame(rows, kind).selectExpr("*", *[f"{k.replace('lit', '')} AS {c}" for k, c in extra]).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
